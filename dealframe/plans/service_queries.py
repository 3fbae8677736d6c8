"""What a bidding service answers: look-ups, samples, statistics of the table, par, club results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import criteria as C
from dealframe.functions import dsl, par
from dealframe.functions import hand as H
from dealframe.functions import scoring as S
from dealframe.operators import bidding
from dealframe.plans.bridge_queries import LEN, SCORE_SQL, SUIT, TOK, W
from dealframe.plans.deals import AUCTIONS, VUL_SQL, bids, contract_of, deals
from dealframe.plans.registry import query
from dealframe.plans.table_queries import BT, FIRST, HOLDS, METRIC_CASE, NODE_SQL, SEAT_HANDS, SEATED, _points, _table, bidding_table
from dealframe.session import table
from dealframe.sources import boards, club
from dealframe.written import Written

#: Auctions of the list that are no whole auction, or no legal one; for the SQL.
ODD = ["1H-1H-P-P-P", "X-P-P-P-P", "1N-P-2C", "1S-P-P-P-P"]
WHOLE = [a for a in AUCTIONS if a not in ODD]
ODD_SQL = ", ".join(f"'{a}'" for a in ODD)


def _dd(direction: int, strain: int):
    """Double-dummy tricks, derived from the key."""
    return ((F.col("index") * (direction * 5 + strain + 3)) % 14).cast("int")


def _tricks():
    return F.array(*[_dd(d, s) for d in range(4) for s in range(5)])


def _tricks_of(decl, strain):
    return F.get(F.col("dd"), (F.instr(F.lit("NESW"), decl) - 1) * 5 + strain)


PAR_SQL = f"""{W.replace("with ", "with recursive ", 1)}, ts as (select index, Vul, d.v::int as di, q.v::int as q, (q.v // 5 + 1)::int as level, (q.v % 5)::int as strain, ((index * (d.v * 5 + q.v % 5 + 3)) % 14)::int as tricks from deals, range(4) d(v), range(35) q(v)),
tv as (select *, (tricks < level + 6)::int as dbl, Vul = 'Both' or (Vul = 'N_S' and di % 2 = 0) or (Vul = 'E_W' and di % 2 = 1) as v from ts),
sc as (select index, q, max(s) filter (where di % 2 = 0) as ns, -max(s) filter (where di % 2 = 1) as ew from (select index, q, di, ({SCORE_SQL})::int as s from tv) x group by 1, 2),
st as (select index, 35 as q, -99999 as a, 99999 as b from deals union all select st.index, sc.q, greatest(a, least(ns, b)), least(b, greatest(ew, a)) from st join sc on sc.index = st.index and sc.q = st.q - 1),
pr as (select index, (case when Dealer in ('N', 'S') then greatest(a, least(0, b)) else least(b, greatest(0, a)) end)::int as par from st join deals using (index) where q = 0)"""


@query("par_scores", f"{PAR_SQL} select index, par from pr")
def par_scores(spark, sf_dir):
    return bids(spark, sf_dir).select("index", par.par(_tricks(), F.col("Vul"), F.col("Dealer")).alias("par"))


@query(
    "dd_score_by_auction",
    f"""{W}, x as (select index, level, strain, dbl, decl, {VUL_SQL} as v, ((index * ((instr('NESW', decl) - 1) * 5 + strain + 3)) % 14)::int as tricks from deals where level is not null)
    select index, tricks as dd_tricks, ({SCORE_SQL})::int as dd_score from x""",
)
def dd_score_by_auction(spark, sf_dir):
    d = bids(spark, sf_dir).where("level is not null").select("index", "level", "strain", "dbl", "decl", "Vul", _tricks().alias("dd"))
    # A column before the score reads it: a score mentions its tricks many times.
    d = d.select("*", _tricks_of(F.col("decl"), F.col("strain")).alias("dd_tricks"))
    return d.select("index", "dd_tricks", S.score(F.col("level"), F.col("strain"), F.col("dbl"), A.side_vulnerable(F.col("Vul"), F.col("decl")), F.col("dd_tricks")).alias("dd_score"))


def _fit_sql(a: str, b: str) -> str:
    at = lambda d, i: f"{LEN.replace(SUIT, f'''string_split(Hand_{d}, '.')''')}[{i}]"
    return "[" + ", ".join(f"{at(a, i)} + {at(b, i)}" for i in (1, 2, 3, 4)) + "]"


@query(
    "total_tricks",
    f"""{W}, x as (select index, {_fit_sql("N", "S")} as ns, {_fit_sql("E", "W")} as ew from deals), y as (select index, list_max(ns) as tn, list_max(ew) as te, 4 - list_position(ns, list_max(ns)) as sn, 4 - list_position(ew, list_max(ew)) as se from x)
    select index, (tn + te)::int as trumps, (greatest((index * (sn + 3)) % 14, (index * (10 + sn + 3)) % 14) + greatest((index * (5 + se + 3)) % 14, (index * (15 + se + 3)) % 14))::int as tricks from y""",
)
def total_tricks(spark, sf_dir):
    """Trumps of both sides' longest fits (ties: the higher suit) and the tricks they take there."""
    d = deals(spark, sf_dir)
    n = {x: H.lengths(H.suits(F.col(f"Hand_{x}"))) for x in "NESW"}
    d = d.select("index", _tricks().alias("dd"), *[F.zip_with(n[a], n[b], lambda x, y: x + y).alias(a + b) for a, b in ("NS", "EW")])
    trumps = {s: F.array_max(F.col(s)) for s in ("NS", "EW")}
    strain = {s: 4 - F.array_position(F.col(s), trumps[s]).cast("int") for s in trumps}
    won = [F.greatest(*[_tricks_of(F.lit(x), strain[s]) for x in s]) for s in trumps]
    return d.select("index", (trumps["NS"] + trumps["EW"]).alias("trumps"), (won[0] + won[1]).alias("tricks"))


@query("random_auctions", f"{W}, s as (select index, {TOK} as t from deals where auction not in ({ODD_SQL}) order by md5('7|' || index), index limit 12) select index, i.v::int as step, array_to_string(t[1:i.v], '-') as node from s, range(1, 20) i(v) where i.v <= len(t)")
def random_auctions(spark, sf_dir):
    """A seeded sample of twelve whole auctions with the nodes that lead to them."""
    t = A.tokens(F.col("auction"))
    d = bids(spark, sf_dir).select("index", t.alias("t")).where(A.complete(F.col("t")))
    s = d.orderBy(F.md5(F.concat(F.lit("7|"), F.col("index").cast("string"))), "index").limit(12)
    e = s.select("index", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("step"))
    return e.select("index", "step", F.array_join(F.slice("t", F.lit(1), F.col("step")), "-").alias("node"))


@query("auctions_by_index", f"{W}, {NODE_SQL} select bt_index, s.v::int as seat, repeat('P-', (s.v - 1)::int) || node as auction from nx, range(1, 5) s(v) where bt_index in (0, 3, 5, 11, 1000000) and not starts_with(node, 'P')")
def auctions_by_index(spark, sf_dir):
    """Rows of the table by index; those that open expanded to the four seats."""
    want = spark.createDataFrame([(i,) for i in (0, 3, 5, 11, 1000000)], "bt_index long")
    t = _table(spark, sf_dir).join(F.broadcast(want), "bt_index", "left_semi").where(~F.col("node").startswith("P"))
    return t.select("bt_index", "node", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seat")).select("bt_index", "seat", F.concat(F.repeat(F.lit("P-"), F.col("seat") - 1), "node").alias("auction"))


@query("bt_dd_mean_tricks", f"{W} select auction, Dealer, count(*) as n, round(avg((index * ((instr('NESW', decl) - 1) * 5 + strain + 3)) % 14), 4) as dd_mean, round(avg(tricks), 4) as mean from deals where level is not null group by 1, 2")
def bt_dd_mean_tricks(spark, sf_dir):
    d = bids(spark, sf_dir).where("level is not null").select("auction", "Dealer", "decl", "strain", "tricks", _tricks().alias("dd"))
    return d.groupBy("auction", "Dealer").agg(F.count("*").alias("n"), F.round(F.avg(_tricks_of(F.col("decl"), F.col("strain"))), 4).alias("dd_mean"), F.round(F.avg("tricks"), 4).alias("mean"))


KEYS_SQL = "(values " + ", ".join(f"('{a}', {lv}, {s}, {d}, {o})" for a in WHOLE for lv, s, d, o in [contract_of(a)] if lv) + ") c(auction, level, strain, dbl, steps)"


def _whole_auctions(spark, sf_dir):
    """The table's whole auctions with a bid: auction, opening, level, strain, dbl, steps from the dealer to the declarer."""
    t = A.tokens(F.col("auction"))
    a = bids(spark, sf_dir).select("auction").distinct().where(A.complete(t) & A.contract(t).isNotNull())
    return a.select(
        "auction",
        F.get(t, F.lit(0)).alias("opening"),
        F.substring(A.contract(t), 1, 1).cast("int").alias("level"),
        (F.instr(F.lit("CDHSN"), F.substring(A.contract(t), 2, 1)) - 1).alias("strain"),
        F.length(A.doubling(t)).alias("dbl"),
        (F.instr(F.lit("NESW"), A.declarer(t, F.lit("N"))) - 1).alias("steps"),
    )


@query("auctions_by_contract", f"{W}, w as (select index, (index // 7 % 7 + 1)::int as level, (index // 3 % 5)::int as strain, (index % 2)::int as dbl from deals) select c.auction, count(*) as n, min(w.index) as first_deal from w join {KEYS_SQL} using (level, strain, dbl) group by 1")
def auctions_by_contract(spark, sf_dir):
    """Whole auctions that end in the contract asked for, by signature."""
    k = F.col("index")
    want = bids(spark, sf_dir).select(k, (F.floor(k / 7) % 7 + 1).cast("int").alias("level"), (F.floor(k / 3) % 5).cast("int").alias("strain"), (k % 2).cast("int").alias("dbl"))
    # Deals are counted by signature before the join.
    want = want.groupBy("level", "strain", "dbl").agg(F.count("*").alias("n"), F.min("index").alias("first_deal"))
    return want.join(_whole_auctions(spark, sf_dir), ["level", "strain", "dbl"]).select("auction", "n", "first_deal")


#: Whole auctions that are broadcast at most.
ENDS_MAX = 100_000


@query(
    "best_auctions",
    f"""{W}, c as (select *, string_split(auction, '-')[1] as opening from {KEYS_SQL}), x as (select d.index, d.Dealer, d.Vul, c.auction, c.level, c.strain, c.dbl, c.steps, substr('NESW', ((instr('NESW', d.Dealer) - 1 + c.steps) % 4 + 1)::int, 1) as decl from deals d join c on c.opening = string_split(d.auction, '-')[1]),
    y as (select *, {VUL_SQL} as v, ((index * ((instr('NESW', decl) - 1) * 5 + strain + 3)) % 14)::int as tricks from x), z as (select index, auction, (case when steps % 2 = 0 then 1 else -1 end * ({SCORE_SQL}))::int as score from y),
    r as (select *, row_number() over (partition by index order by score desc, auction)::int as rank from z) select index, rank, auction, score from r where rank <= 3""",
)
def best_auctions(spark, sf_dir):
    """For each deal the three best ends of its opening for the dealer's side, by double-dummy tricks."""
    # Deals lie in tasks by index, where they meet the ends of their auction's opening and are ranked: by auction they would lie in a few.
    d = bids(spark, sf_dir).select("index", "Dealer", "Vul", F.col("auction").alias("said"), _tricks().alias("dd"))
    said = bids(spark, sf_dir).select(F.col("auction").alias("said")).distinct().withColumn("opening", F.get(A.tokens(F.col("said")), F.lit(0)))
    ends = Written(said.join(_whole_auctions(spark, sf_dir), "opening").drop("opening")).df
    ends = F.broadcast(ends) if ends.count() <= ENDS_MAX else ends
    j = d.join(ends, "said").withColumn("decl", A.next_direction(F.col("Dealer"), F.col("steps")))
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), A.side_vulnerable(F.col("Vul"), F.col("decl")), _tricks_of(F.col("decl"), F.col("strain")))
    j = j.select("index", "auction", F.when(F.col("steps") % 2 == 0, sc).otherwise(-sc).alias("score"))
    best = Window.partitionBy("index").orderBy(F.desc("score"), "auction")
    return j.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("index", "rank", "auction", "score")


@query(
    "greedy_path",
    f"""{W}, {NODE_SQL}, b as (select node from (select node, row_number() over (partition by parent order by complete_below desc, call) as r from nx) x where r = 1), p as (select nx.node, nx.depth, nx.complete_below, count(*) as k from nx join b on nx.node = b.node or starts_with(nx.node, b.node || '-') group by 1, 2, 3)
    select node, depth, complete_below from p where k = depth""",
)
def greedy_path(spark, sf_dir):
    """The path of most followed calls from the root: nodes all of whose ancestors are their parent's best."""
    n = _table(spark, sf_dir)
    best = n.groupBy("parent").agg(F.min_by("node", F.struct((-F.col("complete_below")).alias("k"), "call")).alias("step")).select("step")
    t = F.split("node", "-")
    steps = n.select("node", "depth", "complete_below", F.explode(F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, F.lit(1), i), "-"))).alias("step"))
    kept = steps.join(best, "step", "left_semi").groupBy("node", "depth", "complete_below").agg(F.count("*").alias("k"))
    return kept.where("k = depth").select("node", "depth", "complete_below")


@query(
    "bid_features",
    f"""{W}, {NODE_SQL} select c.bt_index, case c.call when 'P' then 1 when 'X' then 2 when 'XX' then 3 else 3 + (substr(c.call, 1, 1)::int - 1) * 5 + instr('CDHSN', substr(c.call, 2, 1)) end::int as code, ((c.depth - 1) % 4 + 1)::int as seat, round(c.complete_below / coalesce(p.complete_below, (select count(*) from deals)), 6) as share from nx c left join nx p on p.node = c.parent""",
)
def bid_features(spark, sf_dir):
    """Of each node its call's code, its seat, and its share of the auctions that reach its parent."""
    n = _table(spark, sf_dir)
    up = n.select(F.col("node").alias("parent"), F.col("complete_below").alias("above"))
    root = bids(spark, sf_dir).agg(F.count("*").alias("above")).select(F.lit("").alias("parent"), "above")
    j = n.join(up.unionByName(root), "parent")
    return j.select("bt_index", A.bid_code(F.col("call")).cast("int").alias("code"), ((F.col("depth") - 1) % 4 + 1).alias("seat"), F.round(F.col("complete_below") / F.col("above"), 6).alias("share"))


ENDS = [(a, *contract_of(a)) for a in [*WHOLE, "1S-P-P-P"]]
ENDS_SQL = "(values " + ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in e) + ")" for e in ENDS) + ") e(node, level, strain, dbl, steps)"


@query("bt_terminals", f"{W}, {NODE_SQL} select bt_index, level, strain, dbl, steps from nx join {ENDS_SQL} using (node)")
def bt_terminals(spark, sf_dir):
    """Nodes at which the auction is over, with the contract reached."""
    n = _table(spark, sf_dir).select("bt_index", A.tokens(F.col("node")).alias("t")).where(A.complete(F.col("t")))
    t = F.col("t")
    return n.select(
        "bt_index",
        F.substring(A.contract(t), 1, 1).cast("int").alias("level"),
        (F.instr(F.lit("CDHSN"), F.substring(A.contract(t), 2, 1)) - 1).alias("strain"),
        F.length(A.doubling(t)).alias("dbl"),
        (F.instr(F.lit("NESW"), A.declarer(t, F.lit("N"))) - 1).alias("steps"),
    )


@query("seat1_table", f"{W} select regexp_replace(auction, '^(P-)+', '') as auction1, count(*) as n, min(length(regexp_extract(auction, '^(P-)*')) // 2)::int as least_passes, max(length(regexp_extract(auction, '^(P-)*')) // 2)::int as most_passes from deals group by 1")
def seat1_table(spark, sf_dir):
    """One row an auction from its first call that isn't a pass, whatever the seat it opens at."""
    a = F.col("auction")
    g = bids(spark, sf_dir).groupBy(a).agg(F.count("*").alias("n"))
    p = A.leading_passes(a)
    return g.groupBy(A.seat1_view(a).alias("auction1")).agg(F.sum("n").alias("n"), F.min(p).alias("least_passes"), F.max(p).alias("most_passes"))


@query("deals_by_pattern", f"{W}, m as (select auction, index, row_number() over (partition by auction order by md5('3|' || index), index)::int as rank, count(*) over (partition by auction) as n, round(avg(tricks) over (partition by auction), 4) as mean_tricks from deals where regexp_matches(auction, '^1[NS]-P-')) select * from m where rank <= 3")
def deals_by_pattern(spark, sf_dir):
    """Three deals by seeded hash of each auction that matches, beside statistics of all that do."""
    m = bids(spark, sf_dir).where(A.matches(F.col("auction"), "1[NS]-P-")).select("auction", "index", "tricks")
    some = Window.partitionBy("auction").orderBy(F.md5(F.concat(F.lit("3|"), F.col("index").cast("string"))), "index")
    few = m.select("auction", "index", F.row_number().over(some).alias("rank")).where("rank <= 3")
    return few.join(m.groupBy("auction").agg(F.count("*").alias("n"), F.round(F.avg("tricks"), 4).alias("mean_tricks")), "auction")


@query(
    "bidding_table_statistics",
    f"""{W}, {FIRST}, s as (select auction, count(*) as matches, count(*) filter (where v) as matches_v, round(avg(tricks) filter (where v), 4) as tricks_v, round(avg(tricks) filter (where not v), 4) as tricks_nv from (select auction, tricks, coalesce({VUL_SQL}, false) as v from deals) x group by 1)
    select bt.bt_index, bt.Auction, len(e1)::int as n_criteria, matches, matches_v, tricks_v, tricks_nv from bt join s on s.auction = bt.Auction where matches >= 20""",
)
def bidding_table_statistics(spark, sf_dir):
    """Rows of the table with statistics of the deals that had their auction; 20 deals at least."""
    d = bids(spark, sf_dir)
    v = F.coalesce(A.side_vulnerable(F.col("Vul"), F.col("decl")), F.lit(False))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("tricks"))), 4)
    s = d.groupBy(F.col("auction").alias("Auction")).agg(F.count("*").alias("matches"), F.count_if(v).alias("matches_v"), mean(v).alias("tricks_v"), mean(~v).alias("tricks_nv")).where("matches >= 20")
    bt = bidding_table(spark, sf_dir).select("bt_index", "Auction", F.size("Agg_Expr_Seat_1").alias("n_criteria"))
    return bt.join(s, "Auction").select("bt_index", "Auction", "n_criteria", "matches", "matches_v", "tricks_v", "tricks_nv")


STATS_SQL = " union all ".join(f"select auction, {s} as seat, '{n}' as stat, round({f}(HCP_{s}), 4)::double as value from pt group by 1" for s in (1, 2, 3, 4) for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))


@query("seat_stats_pivot", f"{W}, {SEATED} {STATS_SQL}")
def seat_stats_pivot(spark, sf_dir):
    """Points of the four seats by auction, from one wide aggregation to rows."""
    p = _points(spark, sf_dir).join(bids(spark, sf_dir).select("index", "auction"), "index")
    made = {(s, n): f(f"HCP_{s}") for s in (1, 2, 3, 4) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))}
    w = p.groupBy("auction").agg(*[F.round(c, 4).cast("double").alias(f"{n}_{s}") for (s, n), c in made.items()])
    return w.select("auction", F.inline(F.array(*[F.struct(F.lit(s).alias("seat"), F.lit(n).alias("stat"), F.col(f"{n}_{s}").alias("value")) for s, n in made])))


@query(
    "criterion_pass_rates",
    f"""{W}, {FIRST}, {SEAT_HANDS}, c0 as ({" union all ".join(f"select Auction, {s} as seat, unnest(e{s}) as c from fb" for s in (1, 2, 3, 4))}),
    c1 as (select *, regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 1) as name, regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 2) as op, try_cast(regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 3) as int) as v from c0),
    x as (select h.auction, h.seat, c, op, v, f, bal, {METRIC_CASE} as x from hf h join c1 on c1.Auction = h.auction and c1.seat = h.seat)
    select auction, seat, c as criterion, count(*) as n, count(*) filter (where {HOLDS}) as passed from x group by 1, 2, 3""",
)
def criterion_pass_rates(spark, sf_dir):
    """How many of the deals of its auction pass each criterion of the table's first row there."""
    bt = bidding_table(spark, sf_dir).withColumnRenamed("Auction", "auction")
    lists = [f"Agg_Expr_Seat_{s}" for s in (1, 2, 3, 4)]
    first = bt.groupBy("auction").agg(F.min(F.struct("bt_index", *lists)).alias("_f")).select("auction", "_f.*")
    # Parsed once a row of the table and not beside every hand; written, so that it stays so.
    first = Written(first.withColumns({c: C.parsed(F.col(c)) for c in lists})).df
    d = deals(spark, sf_dir).select("auction", "Dealer", *[f"Hand_{x}" for x in "NESW"]).join(first, "auction")
    own = F.map_from_arrays(F.array(*[F.lit(x) for x in "NESW"]), F.array(*[F.col(f"Hand_{x}") for x in "NESW"]))
    cells = [F.struct(F.lit(s).alias("seat"), F.element_at(own, C.seat_direction(F.col("Dealer"), s)).alias("hand"), F.col(f"Agg_Expr_Seat_{s}").alias("cs")) for s in (1, 2, 3, 4)]
    e = d.select("auction", F.inline(F.array(*cells)))
    e = e.select("auction", "seat", C.features(F.col("hand")).alias("known"), F.explode("cs").alias("c"))
    e = e.select("auction", "seat", F.col("c.text").alias("criterion"), C.told(F.col("c"), F.col("known")).alias("told"))
    return e.groupBy("auction", "seat", "criterion").agg(F.count("*").alias("n"), F.count_if("told").alias("passed"))


@query("auction_dd_analysis", f"{W} select auction, substr('NESW', (d.v + 1)::int, 1) as decl, s.v::int as strain, round(avg((index * (d.v * 5 + s.v + 3)) % 14), 4) as tricks, max((index * (d.v * 5 + s.v + 3)) % 14)::int as most from deals, range(4) d(v), range(5) s(v) where starts_with(auction, '1N') group by 1, 2, 3")
def auction_dd_analysis(spark, sf_dir):
    """Double-dummy tricks of every declarer and strain over the deals of an opening's auctions."""
    cells = [(d, s) for d in range(4) for s in range(5)]
    g = bids(spark, sf_dir).where(F.col("auction").startswith("1N")).groupBy("auction").agg(*[x for d, s in cells for x in (F.avg(_dd(d, s)).alias(f"a{d}{s}"), F.max(_dd(d, s)).alias(f"m{d}{s}"))])
    return g.select("auction", F.inline(F.array(*[F.struct(F.lit("NESW"[d]).alias("decl"), F.lit(s).alias("strain"), F.round(f"a{d}{s}", 4).alias("tricks"), F.col(f"m{d}{s}").alias("most")) for d, s in cells])))


@query(
    "contract_ev_cells",
    f"""{W}, x as (select index, l.v::int as level, s.v::int as strain, 0 as dbl, Vul = 'Both' or (Vul = 'N_S' and Dealer in ('N', 'S')) or (Vul = 'E_W' and Dealer in ('E', 'W')) as v, ((index * ((instr('NESW', Dealer) - 1) * 5 + s.v + 3)) % 14)::int as tricks from deals, range(1, 8) l(v), range(5) s(v))
    select level, strain, v, count(*) as n, count(*) filter (where tricks >= level + 6) as made, round(avg({SCORE_SQL}), 4) as ev from x group by 1, 2, 3""",
)
def contract_ev_cells(spark, sf_dir):
    """Expected value of each contract by the dealer, by vulnerability, from counts of tricks."""
    v = A.side_vulnerable(F.col("Vul"), F.col("Dealer"))
    d = bids(spark, sf_dir).select(v.alias("v"), "Dealer", _tricks().alias("dd"))
    e = d.select("v", F.inline(F.array(*[F.struct(F.lit(s).alias("strain"), _tricks_of(F.col("Dealer"), F.lit(s)).alias("tricks")) for s in range(5)])))
    h = e.groupBy("v", "strain", "tricks").agg(F.count("*").alias("k")).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(7))))
    sc = S.score(F.col("level"), F.col("strain"), F.lit(0), F.col("v"), F.col("tricks"))
    g = h.groupBy("level", "strain", "v").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("tricks") >= F.col("level") + 6, F.col("k"))), F.lit(0)).alias("made"), F.sum(sc * F.col("k")).alias("s"))
    return g.select("level", "strain", "v", "n", "made", F.round(F.col("s") / F.col("n"), 4).alias("ev"))


@query("pbn_lookup", f"{W} select index, min(index) over (partition by Hand_N, Hand_E, Hand_S, Hand_W) as found from deals")
def pbn_lookup(spark, sf_dir):
    """Deals found by PBN text that starts at any seat."""
    d = deals(spark, sf_dir)
    asked = d.select("index", boards.pbn_of(F.col("Dealer"), {x: F.col(f"Hand_{x}") for x in "NESW"}).alias("pbn"))
    known = d.groupBy(boards.pbn_of(F.lit("N"), {x: F.col(f"Hand_{x}") for x in "NESW"}).alias("key")).agg(F.min("index").alias("found"))
    return asked.withColumn("key", boards.normal_pbn(F.col("pbn"))).join(known, "key", "left").select("index", "found")


NEXT = [("1N", "HCP >= 15 & HCP <= 17", "HCP_1 >= 15 and HCP_1 <= 17"), ("1S", "HCP >= 12 & SL_S >= 5", "HCP_1 >= 12 and SL_S_1 >= 5"), ("2C", "HCP >= 22", "HCP_1 >= 22"), ("P", "Total_Points < 12", "Total_Points_1 < 12")]


@query("next_bid_criteria_deals", f"{W}, {SEATED} " + " union all ".join(f"select '{b}' as bid, count(*) filter (where {q}) as n, min(md5('5|' || index)) filter (where {q}) as first_key from pt" for b, _, q in NEXT))
def next_bid_criteria_deals(spark, sf_dir):
    """Deals whose first seat passes a next bid's criteria, in one pass for all bids; the seeded first of them."""
    p = _points(spark, sf_dir)
    p = p.select(F.md5(F.concat(F.lit("5|"), F.col("index").cast("string"))).alias("key"), *[F.col(f"{m}_1").alias(m) for m in C.METRICS])
    ok = [dsl.compile_criteria(c, p.columns) for _, c, _ in NEXT]
    one = p.agg(*[x for i, c in enumerate(ok) for x in (F.count_if(c).alias(f"n{i}"), F.min(F.when(c, F.col("key"))).alias(f"k{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(b).alias("bid"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("first_key")) for i, (b, _, _) in enumerate(NEXT)])))


#: A club's line of a board: contract and result texts by arithmetic on lineitem.
LINE_SQL = "l_orderkey as event_id, l_returnflag as section, l_linenumber::int as board, (l_suppkey % 7)::int as ns, (7 + l_partkey % 5)::int as ew, (l_partkey % 7 + 1)::int as level, (l_suppkey % 5)::int as strain, (l_linenumber % 3)::int as dbl, substr('NESW', (l_orderkey % 4 + 1)::int, 1) as declarer, (l_suppkey % 5 - 2)::int as o, l_partkey % 13 = 0 as passed"


def _lines(spark, sf_dir):
    k = {n: F.col(f"l_{n}") for n in ("orderkey", "partkey", "suppkey", "linenumber")}
    o = (k["suppkey"] % 5 - 2).cast("int")
    char = lambda s, i: F.substring(F.lit(s), i.cast("int") + 1, F.lit(1))
    bid = F.concat((k["partkey"] % 7 + 1).cast("string"), F.regexp_replace(char("CDHSN", k["suppkey"] % 5), "N", "NT"), F.repeat(F.lit("x"), (k["linenumber"] % 3).cast("int")), F.lit(" "), char("NESW", k["orderkey"] % 4))
    return table(spark, sf_dir, "lineitem").select(
        k["orderkey"].alias("event_id"),
        F.col("l_returnflag").alias("section"),
        k["linenumber"].cast("int").alias("board"),
        (k["suppkey"] % 7).cast("int").alias("ns"),
        (7 + k["partkey"] % 5).cast("int").alias("ew"),
        F.when(k["partkey"] % 13 == 0, "Pass").otherwise(bid).alias("contract"),
        F.when(o == 0, "=").when(o > 0, F.concat(F.lit("+"), o.cast("string"))).otherwise(o.cast("string")).alias("result"),
        (k["linenumber"] * 20).cast("string").alias("pct"),
    )


@query(
    "club_json_results",
    f"""select event_id, section, board, ns, ew, passed, case when not passed then level end as level, case when not passed then strain end as strain, case when not passed then dbl end as dbl, case when not passed then declarer end as declarer, case when not passed then level + 6 + o end as tricks, least(board * 0.2, 1)::double as pct,
      case when ns % 3 <> 0 then event_id || '-' || section || '-' || ns end as names_ns, case when ew % 3 <> 0 then event_id || '-' || section || '-' || ew end as names_ew from (select {LINE_SQL} from lineitem) x""",
)
def club_json_results(spark, sf_dir):
    """Events written as JSON, read back to tables, joined to their pairs and cleaned."""
    e = _lines(spark, sf_dir).groupBy("event_id").agg(F.collect_list(F.struct("section", "board", "ns", "ew", "contract", "result", "pct")).alias("results"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda p: p % 3 != 0)
    pair = lambda s, p: F.struct(s.alias("section"), p.alias("pair"), F.concat_ws("-", F.col("event_id").cast("string"), s, p.cast("string")).alias("names"))
    pairs = F.flatten(F.transform(F.array(*[F.lit(s) for s in "ANR"]), lambda s: F.transform(numbers, lambda p: pair(s, p))))
    texts = e.select(F.to_json(F.struct("event_id", pairs.alias("pairs"), "results")).alias("text"))
    # Written, so that the texts are read as texts.
    r = club.cleaned(club.named_results(Written(texts).df, "text"))
    return r.select("event_id", "section", "board", "ns", "ew", "passed", "level", "strain", "dbl", "declarer", "tricks", F.round("pct", 6).alias("pct"), "names_ns", "names_ew")


@query("xml_board_results", "select l_orderkey as event_id, (l_orderkey % 36 + 1)::int as board, (l_suppkey % 7)::int as ns, count(*) as n, sum(l_linenumber)::bigint as tricks from lineitem group by 1, 2, 3")
def xml_board_results(spark, sf_dir):
    """Boards written as XML and read back to lines."""
    cell = lambda n, c: F.concat(F.lit(f' {n}="'), c.cast("string"), F.lit('"'))
    lines = _lines(spark, sf_dir).select("event_id", F.concat(F.lit("<line"), cell("ns", F.col("ns")), cell("ew", F.col("ew")), cell("contract", F.col("contract")), cell("tricks", F.col("board")), F.lit("/>")).alias("x"))
    texts = lines.groupBy("event_id").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    texts = texts.select("event_id", F.concat(F.lit("<board"), cell("number", F.col("event_id") % 36 + 1), F.lit(">"), "x", F.lit("</board>")).alias("text"))
    return club.xml_lines(texts, "text").groupBy("event_id", "board", "ns").agg(F.count("*").alias("n"), F.sum("tricks").alias("tricks"))


@query("file_formats", " union all ".join(f"select '{f}' as format, c_custkey, c_name, c_acctbal from customer" for f in ("csv", "json", "xml")))
def file_formats(spark, sf_dir):
    """Customers written as CSV, JSON and XML, and read back by their schema."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    kinds = {"csv": {"header": True}, "json": {}, "xml": {"rowTag": "customer"}}
    back = [Written(c, kind, **options).df.select(F.lit(kind).alias("format"), "*") for kind, options in kinds.items()]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("glob_scan", "select 'nation.parquet' as file, count(*) as n, max(n_name) as last_name from nation")
def glob_scan(spark, sf_dir):
    """Files by a pattern, each row with the file that it comes from."""
    n = spark.read.parquet(f"{sf_dir}/nati*.parquet").select(F.regexp_extract("_metadata.file_path", r"([^/]*\.parquet)", 1).alias("file"), "n_name")
    return n.groupBy("file").agg(F.count("*").alias("n"), F.max("n_name").alias("last_name"))


@query(
    "criteria_validate",
    f"""with {BT}, t as (select case when bt_index % 10 = 0 then '(' || c when bt_index % 10 = 1 then replace(c, 'HCP', 'Points') else c end as text from (select bt_index, unnest(e1) as c from bt) x)
    select text, count(*) as n, not starts_with(text, '(') and not contains(text, 'Points >') and not contains(text, 'Points <') and not contains(text, 'Points =') or starts_with(text, 'Total_Points') as ok from t group by 1""",
)
def criteria_validate(spark, sf_dir):
    """Which of the table's criteria, some of them broken by key, are criteria over the known metrics.

    Distinct texts are a dictionary; each is compiled once.
    """
    k = F.col("bt_index") % 10
    c = bidding_table(spark, sf_dir).select("bt_index", F.explode("Agg_Expr_Seat_1").alias("c"))
    text = F.when(k == 0, F.concat(F.lit("("), "c")).when(k == 1, F.replace("c", F.lit("HCP"), F.lit("Points"))).otherwise(F.col("c"))
    texts = c.groupBy(text.alias("text")).agg(F.count("*").alias("n"))
    known = [*C.METRICS, "Balanced"]
    told = spark.createDataFrame([(r["text"], dsl.fault(r["text"], known) is None) for r in texts.select("text").collect()], "text string, ok boolean")
    return texts.join(told, "text")
