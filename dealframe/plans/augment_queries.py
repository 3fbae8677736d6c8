"""Board results with all that is known of them: scores, par, IMPs, matchpoints, players, tricks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import display as D
from dealframe.functions import hand as H
from dealframe.functions import par
from dealframe.functions import scoring as S
from dealframe.operators import relational, tournament
from dealframe.plans.bridge_queries import HCP, IMP_VALUES, SCORE_SQL, W
from dealframe.plans.deals import VUL_SQL, bids, deals
from dealframe.plans.registry import query
from dealframe.plans.service_queries import PAR_SQL, _tricks, _tricks_of

NS_SQL = f"coalesce(case when decl in ('N', 'S') then ({SCORE_SQL}) else -({SCORE_SQL}) end, 0)::int"
DD_SQL = "((index * ((instr('NESW', decl) - 1) * 5 + strain + 3)) % 14)::int"
MP_SQL = "rank() over (partition by board order by score) + (count(*) over (partition by board, score) - 1) / 2.0 - 1 as mp, count(*) over (partition by board) - 1 as top"


def _for_ns(tricks):
    """North-South's score of the row's contract with these tricks; 0 without a contract."""
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), A.side_vulnerable(F.col("Vul"), F.col("decl")), tricks)
    return F.coalesce(F.when(F.col("decl").isin("N", "S"), sc).otherwise(-sc), F.lit(0))


def _scored(spark, sf_dir):
    d = bids(spark, sf_dir).withColumn("dd", _tricks())
    d = d.withColumn("dd_tricks", _tricks_of(F.col("decl"), F.col("strain")))
    return d.withColumns({"board": F.floor(F.col("index") / 16), "score": _for_ns(F.col("tricks")), "dd_score": _for_ns(F.col("dd_tricks"))})


@query(
    "board_augmented",
    f"""{PAR_SQL}, a as (select index, index // 16 as board, {NS_SQL} as score from (select *, {VUL_SQL} as v from deals) x), b as (select index, {NS_SQL} as dd_score from (select * exclude (tricks), {DD_SQL} as tricks, {VUL_SQL} as v from deals) x),
    m as (select *, {MP_SQL} from a), j as (select m.index, m.board::bigint as board, m.score, dd_score, par, mp::double as mp, round(case when top > 0 then least(mp / top, 1) end, 6)::double as pct, m.score - par as par_diff, m.score - dd_score as dd_diff from m join b using (index) join pr using (index))
    select j.*, (sign(par_diff) * i.imp)::int as par_imp, (sign(dd_diff) * k.imp)::int as dd_imp from j join (values {IMP_VALUES}) i(lo, hi, imp) on abs(par_diff) between i.lo and i.hi join (values {IMP_VALUES}) k(lo, hi, imp) on abs(dd_diff) between k.lo and k.hi""",
)
def board_augmented(spark, sf_dir):
    """Scores, double-dummy scores, par, their IMPs and matchpoints of each result, one step on the other."""
    d = _scored(spark, sf_dir).withColumn("par", par.par(F.col("dd"), F.col("Vul"), F.col("Dealer")))
    d = tournament.matchpoints(d.select("index", "board", "score", "dd_score", "par"), ["board"], "score", "mp", "top")
    d = d.withColumns({"par_diff": F.col("score") - F.col("par"), "dd_diff": F.col("score") - F.col("dd_score")})
    pct = F.round(tournament.percentage(F.col("mp"), F.col("top")), 6).alias("pct")
    return d.select("index", "board", "score", "dd_score", "par", "mp", pct, "par_diff", "dd_diff", S.imp_signed(F.col("par_diff")).alias("par_imp"), S.imp_signed(F.col("dd_diff")).alias("dd_imp"))


@query("declarer_percentages", f"{W}, a as (select index, decl, index // 16 as board, {NS_SQL} as score from (select *, {VUL_SQL} as v from deals) x), m as (select *, {MP_SQL} from a) select decl, count(*) as n, round(avg(least((case when decl in ('N', 'S') then mp else top - mp end) / (top + 1), 1)), 6) as pct, max(case when decl in ('N', 'S') then score else -score end) as best from m where decl is not null group by 1")
def declarer_percentages(spark, sf_dir):
    """Declarers by their share of the matchpoints, over one more than the top."""
    d = tournament.matchpoints(_scored(spark, sf_dir).select("index", "decl", "board", "score"), ["board"], "score", "mp", "top").where("decl is not null")
    ns = F.col("decl").isin("N", "S")
    mine = F.when(ns, F.col("mp")).otherwise(F.col("top") - F.col("mp"))
    return d.groupBy("decl").agg(F.count("*").alias("n"), F.round(F.avg(F.least(mine / (F.col("top") + 1), F.lit(1.0))), 6).alias("pct"), F.max(F.when(ns, F.col("score")).otherwise(-F.col("score"))).alias("best"))


@query("trick_flags", f"{W} select level, strain, count(*) as n, count(*) filter (where tricks > level + 6) as over_tricks, count(*) filter (where tricks = level + 6) as just, count(*) filter (where tricks < level + 6) as under, sum(tricks - {DD_SQL})::bigint as against_dd from deals where level is not null group by 1, 2")
def trick_flags(spark, sf_dir):
    d = _scored(spark, sf_dir).where("level is not null")
    gap = F.col("tricks") - F.col("level") - 6
    return d.groupBy("level", "strain").agg(F.count("*").alias("n"), F.count_if(gap > 0).alias("over_tricks"), F.count_if(gap == 0).alias("just"), F.count_if(gap < 0).alias("under"), F.sum(F.col("tricks") - F.col("dd_tricks")).alias("against_dd"))


@query("trick_probabilities", f"{W}, g as (select decl, strain, count(*) as t from deals where decl is not null group by 1, 2) select g.decl, g.strain, t.v::int as tricks, count(d.index) as n, round(count(d.index) / any_value(g.t), 6) as share from g cross join range(14) t(v) left join deals d on d.decl = g.decl and d.strain = g.strain and d.tricks = t.v group by 1, 2, 3")
def trick_probabilities(spark, sf_dir):
    """Shares of 0 to 13 tricks by declarer and strain, those never taken too."""
    d = bids(spark, sf_dir).where("decl is not null").select("decl", "strain", "tricks")
    s = relational.value_shares(d, ["decl", "strain"], "tricks", list(range(14)))
    return s.select("decl", "strain", "tricks", "n", F.round("share", 6).alias("share"))


def _player(d: str, row: str = "") -> str:
    return f"({row}index * {'NESW'.index(d) + 3}) % 97"


@query(
    "player_roles",
    f"""{W}, p as (select index, decl, instr('NESW', decl) - 1 as z, [{", ".join(_player(d) for d in "NESW")}] as ids from deals), q as (select *, list_transform(range(4), lambda i: ids[((z + i) % 4 + 1)::int]) as r from p)
    select index, case when decl is not null then r[1] end as declarer_id, case when decl is not null then 'P' || r[1] end as declarer_name, case when decl is not null then 'P' || r[2] end as leader_name, case when decl is not null then 'P' || r[3] end as dummy_name,
      least(ids[1], ids[3]) || '_' || greatest(ids[1], ids[3]) as pair_ns, least(ids[2], ids[4]) || '_' || greatest(ids[2], ids[4]) as pair_ew from q""",
)
def player_roles(spark, sf_dir):
    ids = {d: F.expr(_player(d)) for d in "NESW"}
    d = bids(spark, sf_dir).select("index", "decl", *[c.alias(f"id_{x}") for x, c in ids.items()])
    ids = {x: F.col(f"id_{x}") for x in "NESW"}
    names = {x: F.concat(F.lit("P"), c.cast("string")) for x, c in ids.items()}
    who = D.roles(names, F.col("decl"))
    return d.select("index", D.of_direction(ids, F.col("decl")).alias("declarer_id"), *[who[r].alias(f"{r}_name") for r in ("declarer", "leader", "dummy")], D.pair_id(ids["N"], ids["S"]).alias("pair_ns"), D.pair_id(ids["E"], ids["W"]).alias("pair_ew"))


@query("metric_by_suits", f"{W} select index, " + ", ".join(f"length(string_split(Hand_{d}, '.')[{i}])::int as SL_{d}_{s}" for d in "NESW" for i, s in enumerate("SHDC", 1)) + " from deals")
def metric_by_suits(spark, sf_dir):
    """A nested metric (direction, then suit) as one column each."""
    d = deals(spark, sf_dir).select("index", F.array(*[H.lengths(H.suits(F.col(f"Hand_{x}"))) for x in "NESW"]).alias("m"))
    return d.select("index", *[F.get(F.get("m", F.lit(i)), F.lit(j)).alias(f"SL_{x}_{s}") for i, x in enumerate("NESW") for j, s in enumerate("SHDC")])


@query("auctions_at_seats", f"{W}, a as (select auction, count(*) as n from deals group by 1) select repeat('P-', (s.v - 1)::int) || regexp_replace(auction, '^(P-)+', '') as shown, s.v::int as seat, sum(n)::bigint as n from a, range(1, 5) s(v) group by 1, 2")
def auctions_at_seats(spark, sf_dir):
    a = bids(spark, sf_dir).groupBy("auction").agg(F.count("*").alias("n")).withColumn("seat", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return a.groupBy(D.at_seat(F.col("auction"), F.col("seat")).alias("shown"), "seat").agg(F.sum("n").alias("n"))


@query(
    "contract_texts",
    f"""{W}, x as (select index, level || substr('CDHSN', strain + 1, 1) || repeat('X', dbl) || ' ' || case when decl in ('N', 'S') then 'NS' else 'EW' end || ' ' as c, tricks - level - 6 as o, {DD_SQL} - level - 6 as q from deals where level is not null),
    y as (select index, c || case when o = 0 then '=' when o > 0 then '+' || o else o::varchar end as a, c || case when q = 0 then '=' when q > 0 then '+' || q else q::varchar end as b from x) select index, case when a = b then a else a || ', ' || b end as text from y""",
)
def contract_texts(spark, sf_dir):
    """The contract with the tricks taken and with those of best play, named once where they agree."""
    d = _scored(spark, sf_dir).where("level is not null")
    pair = F.when(F.col("decl").isin("N", "S"), "NS").otherwise("EW").alias("pair")
    one = lambda t: F.struct("level", "strain", "dbl", pair, (F.col(t) - F.col("level") - 6).alias("over"))
    return d.select("index", D.contracts_text(F.array(one("tricks"), one("dd_tricks"))).alias("text"))


@query("feature_shards", f"{W} select substr(md5('s|' || index), 1, 1) as shard, count(*) as n, sum(({HCP})::int)::bigint as hcp, sum((contains(string_split(Hand_N, '.')[1], 'A'))::int)::bigint as spade_aces from deals group by 1")
def feature_shards(spark, sf_dir):
    """Sixteen shards of a training frame by seeded hash, the same whatever the partitions."""
    d = deals(spark, sf_dir)
    shard = F.substring(F.md5(F.concat(F.lit("s|"), F.col("index").cast("string"))), 1, 1)
    return d.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sum(H.points(F.col("Hand_N"))).alias("hcp"), F.sum(F.get(H.suits(F.col("Hand_N")), F.lit(0)).contains("A").cast("int")).alias("spade_aces"))
