"""Board-result shaped queries: dynamic picks, best contracts, roles, the scoring pipeline, explanations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dealframe import sqlapi
from dealframe.functions import auction as A
from dealframe.functions import hand as H
from dealframe.functions import scoring as S
from dealframe.operators import tournament
from dealframe.plans.bridge_queries import AUC, DECL, HCP, LEN, SCORE_SQL, SUIT, W
from dealframe.plans.deals import VUL_SQL, bids, deals, hands
from dealframe.plans.registry import query
from dealframe.session import table
from dealframe.sources import boards
from dealframe.sources.ledger import LinStore
from dealframe.written import shared_dir

DD = [(d, s) for d in "NESW" for s in "CDHSN"]


def _dd(k):
    """Double-dummy tricks by declarer and strain as a map; derived from the key."""
    return F.map_from_arrays(F.array(*[F.lit(d + s) for d, s in DD]), F.array(*[((k * (i + 3)) % 14).cast("int") for i in range(len(DD))]))


@query(
    "dd_tricks_pick",
    f"""{AUC}, x as (select index, case when len(bids) > 0 then {DECL} end as decl, case when len(bids) > 0 then substr(last.t, 2, 1) end as strain from au2)
    select index, decl, strain, ((index * ((instr('NESW', decl) - 1) * 5 + instr('CDHSN', strain) - 1 + 3)) % 14)::int as tricks from x""",
)
def dd_tricks_pick(spark, sf_dir):
    t = A.tokens(F.col("auction"))
    d = bids(spark, sf_dir).select("index", A.declarer(t, F.col("Dealer")).alias("decl"), F.substring(A.contract(t), 2, 1).alias("strain"))
    return d.select("index", "decl", "strain", F.element_at(_dd(F.col("index")), F.concat("decl", "strain")).alias("tricks"))


GRID = "select l.v::int as level, s.v::int as strain from range(1, 8) l(v), range(5) s(v)"


@query(
    "best_contract",
    f"""{W}, x as (select d.index, g.level, g.strain, 0 as dbl, {VUL_SQL} as v, ((d.index * (g.strain + 3)) % 14)::int as tricks from deals d, ({GRID}) g),
      s as (select index, level, strain, ({SCORE_SQL})::int as sc from x), r as (select *, row_number() over (partition by index order by sc desc, level, strain) as r from s)
    select index, sc as best_score, level::varchar || substr('CDHSN', strain + 1, 1) as best_contract from r where r = 1""",
)
def best_contract(spark, sf_dir):
    d = bids(spark, sf_dir)
    v = A.side_vulnerable(F.col("Vul"), F.col("decl"))
    # The best of all 35 contracts within the row: an array's maximum, not a join and a sort.
    cells = [
        F.struct(S.score(F.lit(lv), F.lit(s), F.lit(0), v, ((F.col("index") * (s + 3)) % 14).cast("int")).alias("sc"), F.lit(-lv).alias("l"), F.lit(-s).alias("s"), F.lit(f"{lv}{'CDHSN'[s]}").alias("name"))
        for lv in range(1, 8)
        for s in range(5)
    ]
    return d.select("index", F.array_max(F.array(*cells)).alias("b")).select("index", F.col("b.sc").alias("best_score"), F.col("b.name").alias("best_contract"))


@query(
    "role_columns",
    f"""{AUC}, x as (select index, {DECL} as decl from au2 where len(bids) > 0)
    select index, decl, substr('NESW', instr('NESW', decl) % 4 + 1, 1) as leader, substr('NESW', (instr('NESW', decl) + 1) % 4 + 1, 1) as dummy, substr('NESW', (instr('NESW', decl) + 2) % 4 + 1, 1) as other, case when decl in ('N', 'S') then 'NS' else 'EW' end as pair from x""",
)
def role_columns(spark, sf_dir):
    d = bids(spark, sf_dir).select("index", A.declarer(A.tokens(F.col("auction")), F.col("Dealer")).alias("decl")).where("decl is not null")
    turn = lambda n: F.substring(F.lit("NESW"), (F.instr(F.lit("NESW"), F.col("decl")) - 1 + n) % 4 + 1, F.lit(1))
    return d.select("index", "decl", turn(1).alias("leader"), turn(2).alias("dummy"), turn(3).alias("other"), F.when(F.col("decl").isin("N", "S"), "NS").otherwise("EW").alias("pair"))


@query(
    "suit_quality",
    f"""{W}, s as (select dir, i.v::int as i, string_split(hand, '.')[i.v::int] as s from hands, range(1, 5) i(v)), q as (select *, length(s) as n, 4 * contains(s, 'A')::int + 3 * contains(s, 'K')::int + 2 * contains(s, 'Q')::int + contains(s, 'J')::int as h from s)
    select dir, i, count(*) filter (where n >= 5 or (n = 4 and h >= 3)) as biddable, count(*) filter (where n >= 6 or (n = 5 and h >= 3)) as rebiddable, count(*) filter (where contains(s, 'A') or (contains(s, 'K') and n >= 2) or (contains(s, 'Q') and n >= 3)) as stopped from q group by 1, 2""",
)
def suit_quality(spark, sf_dir):
    d = hands(spark, sf_dir).select("dir", F.posexplode(H.suits(F.col("hand"))).alias("p", "s"))
    quality = H.suit_qualities(F.col("s"))
    return d.groupBy("dir", (F.col("p") + 1).alias("i")).agg(*[F.count_if(quality[q]).alias(q) for q in ("biddable", "rebiddable", "stopped")])


@query(
    "board_results",
    f"""{W}, x as (select *, {VUL_SQL} as v from deals), s as (select index, (index // 16)::bigint as board, coalesce(case when decl in ('N', 'S') then ({SCORE_SQL}) else -({SCORE_SQL}) end, 0)::int as score from x),
      m as (select *, rank() over (partition by board order by score) + (count(*) over (partition by board, score) - 1) / 2.0 - 1 as mp, count(*) over (partition by board) - 1 as top from s)
    select index, board, score, mp::double as mp, round(case when top > 0 then least(mp / top, 1) end, 6)::double as pct from m""",
)
def board_results(spark, sf_dir):
    v = A.side_vulnerable(F.col("Vul"), F.col("decl"))
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), v, F.col("tricks"))
    ns = F.coalesce(F.when(F.col("decl").isin("N", "S"), sc).otherwise(-sc), F.lit(0))
    d = bids(spark, sf_dir).select("index", F.floor(F.col("index") / 16).alias("board"), ns.alias("score"))
    d = tournament.matchpoints(d, ["board"], "score", "mp", "top")
    return d.select("index", "board", "score", "mp", F.round(tournament.percentage(F.col("mp"), F.col("top")), 6).alias("pct"))


@query("critical_mistakes", "select l_orderkey, max(l_extendedprice) - min(l_extendedprice) as loss, count(*) as steps from lineitem group by 1 order by loss desc, 1 limit 20")
def critical_mistakes(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("loss"), F.count("*").alias("steps"))
    return g.orderBy(F.desc("loss"), "l_orderkey").limit(20)


@query("explain_text", f"{W} select index, 'North holds ' || ({HCP})::int || ' points and ' || (({LEN})[1])::int || ' spades' as text from deals")
def explain_text(spark, sf_dir):
    s = H.suits(F.col("Hand_N"))
    return deals(spark, sf_dir).select("index", F.format_string("North holds %d points and %d spades", H.points(F.col("Hand_N")).cast("int"), F.element_at(H.lengths(s), 1)).alias("text"))


@query("belief_trace", f"{W}, a as (select i.v::int as step, array_to_string(string_split(auction, '-')[1:i.v::int], '-') as node, ({HCP})::int as hcp from deals, range(1, 16) i(v) where len(string_split(auction, '-')) >= i.v) select step, node, count(*) as n, round(avg(hcp), 4) as hcp_mean, min(hcp) as lo, max(hcp) as hi from a group by 1, 2")
def belief_trace(spark, sf_dir):
    s = H.suits(F.col("Hand_N"))
    d = deals(spark, sf_dir).select(A.tokens(F.col("auction")).alias("t"), H.points(F.col("Hand_N")).cast("int").alias("hcp"))
    # Hands are counted by auction and value before the steps are expanded.
    d = d.groupBy("t", "hcp").agg(F.count("*").alias("n"))
    e = d.select("t", "hcp", "n", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("step"))
    e = e.select("step", F.array_join(F.slice("t", F.lit(1), F.col("step")), "-").alias("node"), "hcp", "n")
    return e.groupBy("step", "node").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("hcp") * F.col("n")) / F.sum("n"), 4).alias("hcp_mean"), F.min("hcp").alias("lo"), F.max("hcp").alias("hi"))


@query("sql_facade", "select o_orderstatus, count(*) as n from orders where o_totalprice > 100000 group by 1 order by n desc, 1 limit 5")
def sql_facade(spark, sf_dir):
    sqlapi.register(spark, facade_orders=table(spark, sf_dir, "orders"))
    return sqlapi.execute(spark, "select o_orderstatus, count(*) as n from facade_orders where o_totalprice > 100000 group by 1 order by n desc, 1;", 5)


@query("lin_round_trip", f"{W} select index, Hand_N, Hand_E, Hand_S, Hand_W, auction from deals")
def lin_round_trip(spark, sf_dir):
    d = deals(spark, sf_dir)
    hand = lambda x: F.concat(*[F.concat(F.lit(s), F.get(F.split(F.col(f"Hand_{x}"), r"\.", -1), F.lit(i))) for i, s in enumerate("SHDC")])
    calls = F.array_join(F.transform(F.split("auction", "-"), lambda t: F.concat(F.lit("mb|"), t, F.lit("|"))), "")
    lin = F.concat(F.lit("st||md|3"), hand("S"), F.lit(","), hand("W"), F.lit(","), hand("N"), F.lit("|sv|o|ah|Board 1|"), calls, F.lit("pg||"))
    return boards.parse_lin(d.select("index", lin.alias("value"))).select("index", "Hand_N", "Hand_E", "Hand_S", "Hand_W", "auction")


@query("wrong_seat_first", f"{W}, h as (select index, list_transform([Hand_N, Hand_E, Hand_S, Hand_W], lambda h: list_sum(list_transform(string_split(h, '.'), lambda s: 4 * contains(s, 'A')::int + 3 * contains(s, 'K')::int + 2 * contains(s, 'Q')::int + contains(s, 'J')::int))::int) as p from deals) select case when p[1] < 8 then 1 when p[2] > 14 then 2 when p[3] < 5 then 3 when p[4] > 16 then 4 end as seat, count(*) as n from h group by 1")
def wrong_seat_first(spark, sf_dir):
    p = [H.points(F.col(f"Hand_{d}")) for d in "NESW"]
    wrong = [p[0] < 8, p[1] > 14, p[2] < 5, p[3] > 16]
    first = F.coalesce(*[F.when(w, F.lit(i + 1)) for i, w in enumerate(wrong)])
    return deals(spark, sf_dir).groupBy(first.alias("seat")).agg(F.count("*").alias("n"))


# Files of LIN records: some boards lack their vulnerability or their dealer; a board has up to ten cards played.
FILE_SQL = "fi as (select index, index // 400 as file, index % 37 = 0 or index % 41 = 0 as bad, (index % 11)::int as played, auction from deals)"

_STORES: dict[tuple[str, str], LinStore] = {}


def _lin_files(d):
    """(file, value): a LIN text for every 400 keys."""
    k = F.col("index")
    hand = lambda x: F.concat(*[F.concat(F.lit(s), F.get(F.split(F.col(f"Hand_{x}"), r"\.", -1), F.lit(i))) for i, s in enumerate("SHDC")])
    calls = F.array_join(F.transform(F.split("auction", "-"), lambda t: F.concat(F.lit("mb|"), t, F.lit("|"))), "")
    plays = F.array_join(F.array_repeat(F.lit("pc|SA|"), (k % 11).cast("int")), "")
    dealer = F.when(k % 41 == 0, "").otherwise(F.instr(F.lit("SWNE"), F.col("Dealer")).cast("string"))
    vul = F.when(k % 37 == 0, "").otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("None", "o", "N_S", "n", "E_W", "e", "Both", "b")]), F.col("Vul")))
    text = F.concat(F.lit("qx|o1|md|"), dealer, hand("S"), F.lit(","), hand("W"), F.lit(","), hand("N"), F.lit("|sv|"), vul, F.lit("|ah|Board "), k.cast("string"), F.lit("|"), calls, F.lit("pg||"), plays)
    return d.select(F.floor(k / 400).alias("file"), "index", text.alias("t")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "t"))), lambda x: x["t"]), "\n").alias("value"))


def lin_store(spark, sf_dir) -> LinStore:
    """Two of three files, then all of them, then nothing new: three runs into one store, once a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        at = f"{shared_dir(spark)}/dealframe/{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        files, store = _lin_files(deals(spark, sf_dir)), LinStore(spark, f"{at}/store")
        for part in (F.col("file") % 3 != 0, F.col("file") % 3 == 0, None):
            if part is not None:
                # One file a row, all in one folder; each is in place once its task is done, not renamed one by one by the driver.
                once = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
                files.where(part).select("value").write.mode("append").options(**once).text(f"{at}/files")
            store.ingest(f"{at}/files", "*.txt")
        _STORES[key] = store
    return _STORES[key]


@query(
    "lin_ingestion",
    f"""{W}, {FILE_SQL}, r as (select * from range(1, 4) t(run)), c as (select run, count(distinct file) filter (where run > 1 or file % 3 <> 0) as files, count(distinct file) filter (where (run = 1 and file % 3 <> 0) or (run = 2 and file % 3 = 0)) as new_files,
    count(*) filter (where not bad and ((run = 1 and file % 3 <> 0) or (run = 2 and file % 3 = 0))) as boards, count(*) filter (where bad and ((run = 1 and file % 3 <> 0) or (run = 2 and file % 3 = 0))) as rejected from r, fi group by 1)
    select run, files, new_files, files - new_files as skipped_files, boards, rejected from c""",
)
def lin_ingestion(spark, sf_dir):
    """What each of three runs over a growing folder of LIN files saw, read, skipped and rejected."""
    return lin_store(spark, sf_dir).runs()


@query(
    "lin_boards",
    f"""{W}, {FILE_SQL} select d.index::int as board, Dealer as dealer, Vul as vul, Hand_N, Hand_E, Hand_S, Hand_W, d.auction, len(string_split(d.auction, '-'))::int as n_calls, played as n_plays, (case when played > 0 then (played - 1) // 4 + 1 end)::int as last_trick
    from deals d join fi using (index) where not bad""",
)
def lin_boards(spark, sf_dir):
    """Every board of the store, with its nested calls and plays."""
    b = lin_store(spark, sf_dir).boards()
    return b.select("board", "dealer", "vul", *[f"Hand_{d}" for d in "NESW"], "auction", F.size("calls").alias("n_calls"), F.size("plays").alias("n_plays"), F.array_max(F.transform("plays", lambda p: p["trick"])).alias("last_trick"))


@query("lin_rejects", f"{W}, {FILE_SQL} select case when index % 41 = 0 then 'no dealer' else 'no vulnerability' end as reason, count(*) as n from fi where bad group by 1")
def lin_rejects(spark, sf_dir):
    """Records that are no boards, by reason."""
    return lin_store(spark, sf_dir).rejects().groupBy("reason").agg(F.count("*").alias("n"))
