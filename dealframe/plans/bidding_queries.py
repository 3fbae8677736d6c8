"""Bidding-table shaped queries over derived deals: ranges, next calls, categories, openings, posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import categories as C
from dealframe.functions import hand as H
from dealframe.functions import meanings as M
from dealframe.functions import scoring as S
from dealframe.functions.shape import shape_filter, sorted_shape_filter
from dealframe.operators import matching
from dealframe.plans.bridge_queries import DP, HCP, IMP_VALUES, LEN, LTC, SCORE_SQL, TOK, W
from dealframe.plans.deals import VUL_SQL, bids, deals
from dealframe.plans.registry import query
from dealframe.session import table

NODES = f"nodes as (select distinct array_to_string({TOK}[1:i], '-') as node, i::int as depth, {TOK}[i] as call, case when i > 1 then array_to_string({TOK}[1:i - 1], '-') else '' end as parent from deals, range(1, 16) r(i) where i <= len({TOK}))"


def _nodes(spark, sf_dir):
    auctions = bids(spark, sf_dir).select("auction").distinct().select(A.tokens(F.col("auction")).alias("t"))
    e = auctions.select("t", F.posexplode("t").alias("i", "call"))
    join = lambda n: F.array_join(F.slice("t", 1, n), "-")
    return e.select(join(F.col("i") + 1).alias("node"), (F.col("i") + 1).alias("depth"), "call", join(F.col("i")).alias("parent")).distinct()


@query("bidding_nodes", f"{W}, {NODES} select node, depth, call, parent from nodes")
def bidding_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


@query(
    "list_next_bids",
    f"""{W}, {NODES} select parent, call, (case when call = 'P' then 3 when call in ('X', 'XX') then 2 else 1 end)::int as class, (case when call = 'P' then 1 when call = 'X' then 2 when call = 'XX' then 3 else 3 + (substr(call, 1, 1)::int - 1) * 5 + instr('CDHSN', substr(call, 2, 1)) end)::int as code from nodes""",
)
def list_next_bids(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    kind = F.when(F.col("call") == "P", 3).when(F.col("call").isin("X", "XX"), 2).otherwise(1)
    return n.select("parent", "call", kind.alias("class"), A.bid_code(F.col("call")).cast("int").alias("code")).orderBy("parent", "class", "code")


@query("resolve_auction_path", f"{W}, {NODES}, c as (select array_to_string({TOK}[1:i], '-') as node, count(*) as reached from deals, range(1, 16) r(i) where i <= len({TOK}) group by 1) select n.depth, n.node, n.call, c.reached from nodes n join c using (node) where starts_with('1S-P-2S-P-4S-P-P-P', n.node) and (n.node || '-' = substr('1S-P-2S-P-4S-P-P-P-', 1, length(n.node) + 1))")
def resolve_auction_path(spark, sf_dir):
    path = "1S-P-2S-P-4S-P-P-P".split("-")
    steps = ["-".join(path[: i + 1]) for i in range(len(path))]
    # Auctions are counted first: every later step has one row an auction.
    auctions = bids(spark, sf_dir).groupBy("auction").agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("depth"), F.lit(s).alias("node"), F.lit(path[i]).alias("call")) for i, s in enumerate(steps)])).alias("s")
    j = auctions.select("auction", "n", cells).where(F.concat("auction", F.lit("-")).startswith(F.concat("s.node", F.lit("-"))))
    return j.groupBy("s.depth", "s.node", "s.call").agg(F.sum("n").alias("reached"))


@query(
    "bid_categories",
    f"""{W}, a as (select auction, {TOK} as t, count(*) as n from deals group by 1, 2), b as (select *, t[len(t) - 3] as last_call, list_filter(t, lambda x: regexp_matches(x, '^[1-7]')) as bids from a)
    select sum(n) filter (where len(bids) = 0)::bigint as passed_out, sum(n) filter (where list_contains(t, 'X'))::bigint as doubled, sum(n) filter (where bids[1] = '1N')::bigint as notrump_opened from b""",
)
def bid_categories(spark, sf_dir):
    a = bids(spark, sf_dir).groupBy("auction").agg(F.count("*").alias("n")).withColumn("t", A.tokens(F.col("auction")))
    steps = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: C.names(F.slice("t", 1, i)))
    a = a.select("n", F.flatten(steps).alias("c"), F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: C.flags(F.slice("t", 1, i))["is_notrump_opening"] & (F.element_at("t", i) == "1N")).alias("o"))
    return a.agg(
        F.sum(F.when(~F.array_contains("c", "is_bid"), F.col("n"))).alias("passed_out"),
        F.sum(F.when(F.array_contains("c", "is_double"), F.col("n"))).alias("doubled"),
        F.sum(F.when(F.array_contains("o", True), F.col("n"))).alias("notrump_opened"),
    )


@query("shape_patterns", f"{W}, l as (select {LEN} as l from deals) select count(*) filter (where l[1] >= 4 and l[2] between 2 and 5 and l[4] <= 3) as ordered, count(*) filter (where list_sort(l) = [2, 3, 4, 4]) as any_order, count(*) filter (where l[1] = 5 and l[2] = 4 and l[3] = 3 and l[4] = 1) as exact from l")
def shape_patterns(spark, sf_dir):
    n = H.lengths(H.suits(F.col("Hand_N")))
    return deals(spark, sf_dir).agg(F.count_if(shape_filter(n, "4+,2:5,x,3-")).alias("ordered"), F.count_if(sorted_shape_filter(n, "4432")).alias("any_order"), F.count_if(shape_filter(n, "5431")).alias("exact"))


@query(
    "hand_range_match",
    f"""{W}, d as (select index, ({HCP})::int as hcp, (({LEN})[1])::int as sl from deals), r as (select p_partkey as bt, p_size % 20 as hcp_min, p_size % 20 + 4 as hcp_max, p_partkey % 5 as sl_min, p_partkey % 5 + 3 as sl_max from part)
    select bt, count(*) as matching_deal_count, min(index) as first_deal from d join r on hcp between hcp_min and hcp_max and sl between sl_min and sl_max group by 1""",
)
def hand_range_match(spark, sf_dir):
    s = H.suits(F.col("Hand_N"))
    d = deals(spark, sf_dir).select("index", H.points(F.col("Hand_N")).cast("int").alias("hcp"), F.element_at(H.lengths(s), 1).cast("int").alias("sl"))
    k, z = F.col("p_partkey"), F.col("p_size")
    r = table(spark, sf_dir, "part").select(k.alias("bt"), (z % 20).alias("hcp_min"), (z % 20 + 4).alias("hcp_max"), (k % 5).alias("sl_min"), (k % 5 + 3).alias("sl_max"))
    return matching.bucket_range_summary(d, r, ["hcp", "sl"], "index", "bt").select("bt", F.col("n").alias("matching_deal_count"), F.col("first").alias("first_deal"))


RULES = [("1N", "HCP >= 15 & HCP <= 17 & Balanced"), ("1S", "HCP >= 11 & SL_S >= 5"), ("1H", "HCP >= 11 & SL_H >= 5 & SL_S < 5"), ("2C", "HCP >= 20")]
BAL = f"(array_to_string(list_reverse_sort({LEN}), '') in ('4333', '4432') or (array_to_string(list_reverse_sort({LEN}), '') in ('5332', '5422') and (({LEN})[3] = 5 or ({LEN})[4] = 5)))"


@query(
    "opening_bids_by_seat",
    f"""{W}, h as (select index, {HCP} as hcp, {LEN} as l, {BAL} as bal from deals)
    select array_to_string(list_filter([case when hcp between 15 and 17 and bal then '1N' end, case when hcp >= 11 and l[1] >= 5 then '1S' end, case when hcp >= 11 and l[2] >= 5 and l[1] < 5 then '1H' end, case when hcp >= 20 then '2C' end], lambda x: x is not null), ',') as openings, count(*) as n from h group by 1""",
)
def opening_bids_by_seat(spark, sf_dir):
    from dealframe.functions.dsl import compile_criteria

    s = H.suits(F.col("Hand_N"))
    n = H.lengths(s)
    h = deals(spark, sf_dir).select(H.points(F.col("Hand_N")).alias("HCP"), F.element_at(n, 1).alias("SL_S"), F.element_at(n, 2).alias("SL_H"), H.balanced(s).alias("Balanced"))
    bids = F.array_compact(F.array(*[F.when(compile_criteria(rule, h.columns), F.lit(b)) for b, rule in RULES]))
    return h.groupBy(F.array_join(bids, ",").alias("openings")).agg(F.count("*").alias("n"))


@query("custom_criteria_impact", f"{W}, h as (select {HCP} as hcp, {LEN} as l from deals) select count(*) as n, count(*) filter (where hcp >= 12) as before, count(*) filter (where hcp >= 12 and l[1] >= 4) as after from h")
def custom_criteria_impact(spark, sf_dir):
    s = H.suits(F.col("Hand_N"))
    h = deals(spark, sf_dir).select(H.points(F.col("Hand_N")).alias("hcp"), F.element_at(H.lengths(s), 1).alias("sl"))
    return h.agg(F.count("*").alias("n"), F.count_if(F.col("hcp") >= 12).alias("before"), F.count_if((F.col("hcp") >= 12) & (F.col("sl") >= 4)).alias("after"))


@query(
    "imp_vs_par",
    f"""{W}, x as (select *, {VUL_SQL} as v from deals), s as (select index, decl, ({SCORE_SQL})::int as sc, (index * 37) % 1200 - 600 as par from x), d as (select index, coalesce(case when decl in ('N', 'S') then sc else -sc end, 0) - par as diff from s)
    select index, diff::bigint as diff, (sign(diff) * imp)::int as imps from d join (values {IMP_VALUES}) t(lo, hi, imp) on abs(diff) between lo and hi""",
)
def imp_vs_par(spark, sf_dir):
    d = bids(spark, sf_dir)
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), A.side_vulnerable(F.col("Vul"), F.col("decl")), F.col("tricks"))
    ns = F.coalesce(F.when(F.col("decl").isin("N", "S"), sc).otherwise(-sc), F.lit(0))
    d = d.select("index", (ns - ((F.col("index") * 37) % 1200 - 600)).cast("long").alias("diff"))
    return d.select("index", "diff", S.imp_signed(F.col("diff")).alias("imps"))


@query(
    "seat_rotation",
    f"""{W} select index, p.v::int as passes, (((s.v - 1 - p.v + 8) % 4) + 1)::int as orig, s.v::int as display, ([Hand_N, Hand_E, Hand_S, Hand_W])[(((s.v - 1 - p.v + 8) % 4) + 1)::int] as hand from deals, range(4) p(v), range(1, 5) s(v)""",
)
def seat_rotation(spark, sf_dir):
    d = deals(spark, sf_dir).withColumn("h", F.array(*[F.col(f"Hand_{x}") for x in "NESW"]))
    e = d.select("index", "h", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("passes")).withColumn("display", F.explode(F.sequence(F.lit(1), F.lit(4))))
    orig = F.pmod(F.col("display") - 1 - F.col("passes"), F.lit(4)) + 1
    return e.select("index", "passes", orig.alias("orig"), "display", F.element_at("h", orig).alias("hand"))


@query("posterior_histograms", f"{W}, h as (select Dealer, ({HCP})::int as hcp from deals) select Dealer, hcp, count(*) as n, round(count(*) / sum(count(*)) over (partition by Dealer), 6) as p from h group by 1, 2")
def posterior_histograms(spark, sf_dir):
    h = deals(spark, sf_dir).select("Dealer", H.points(F.col("Hand_N")).cast("int").alias("hcp")).groupBy("Dealer", "hcp").agg(F.count("*").alias("n"))
    t = h.groupBy("Dealer").agg(F.sum("n").alias("t"))
    return h.join(t, "Dealer").select("Dealer", "hcp", "n", F.round(F.col("n") / F.col("t"), 6).alias("p"))


@query("hand_conservation", f"{W}, s as (select index, string_split(Hand_N || '.' || Hand_E || '.' || Hand_S || '.' || Hand_W, '.') as s from deals) select count(*) as n, count(*) filter (where length(array_to_string(s, '')) = 52) as cards_ok from s")
def hand_conservation(spark, sf_dir):
    s = F.concat(*[H.suits(F.col(f"Hand_{d}")) for d in "NESW"])
    return deals(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.length(F.array_join(s, "")) == 52).alias("cards_ok"))


@query("loser_profile", f"{W} select ({LTC})::int as losers, count(*) as n, round(avg({HCP}), 4) as avg_hcp, max({DP})::int as max_dp from deals group by 1")
def loser_profile(spark, sf_dir):
    s = H.suits(F.col("Hand_N"))
    h = deals(spark, sf_dir).select(H.losers(s).cast("int").alias("losers"), H.points(F.col("Hand_N")).alias("hcp"), H.distribution_points(s).alias("dp"))
    return h.groupBy("losers").agg(F.count("*").alias("n"), F.round(F.avg("hcp"), 4).alias("avg_hcp"), F.max("dp").cast("int").alias("max_dp"))


@query(
    "contract_score_summary",
    f"""{W}, x as (select *, {VUL_SQL} as v from deals), s as (select level, strain, tricks, ({SCORE_SQL})::int as sc from x)
    select level, strain, count(*) as n, count(*) filter (where tricks >= level + 6) as made, round(avg(sc), 4) as avg_score, max(sc) as best from s group by 1, 2""",
)
def contract_score_summary(spark, sf_dir):
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), A.side_vulnerable(F.col("Vul"), F.col("decl")), F.col("tricks"))
    d = bids(spark, sf_dir).select("level", "strain", "tricks", sc.alias("sc"))
    return d.groupBy("level", "strain").agg(F.count("*").alias("n"), F.count_if(F.col("tricks") >= F.col("level") + 6).alias("made"), F.round(F.avg("sc"), 4).alias("avg_score"), F.max("sc").alias("best"))


def _last(side: str, what: str = "t[j]") -> str:
    """SQL: of the earlier calls j for which ``side`` holds, the latest, by positions in the list of calls."""
    return f"(select {what} from (select list_max(list_filter(range(1, depth), lambda j: {side})) as j))"


_IS_BID = "t[j] similar to '[1-7].*'"
_STRAINS = "list_distinct(list_transform(list_filter(range(1, depth), lambda j: {}), lambda j: t[j][2]))"
_MINE, _PARTNER, _THEIRS = "(depth - j) % 4 = 0", "(depth - j) % 4 = 2", "(depth - j) % 2 = 1"
FACT_SQL = {
    "call": "call", "lv": "case when call similar to '[1-7].*' then call[1]::int end", "st": "case when call similar to '[1-7].*' then call[2] end", "turn": "depth - 1",
    "prev": "t[depth - 1]", "prev2": "case when depth > 2 then t[depth - 2] end", "pcall": "case when depth > 2 then t[depth - 2] end",
    "pl": _last(f"{_IS_BID} and {_PARTNER}", "t[j][1]::int"), "ps": _last(f"{_IS_BID} and {_PARTNER}", "t[j][2]"), "p_turns": "depth // 4 + (case when depth % 4 = 3 then 1 else 0 end)",
    "p_strains": f"len({_STRAINS.format(f'{_IS_BID} and {_PARTNER}')})", "p_named": f"list_contains({_STRAINS.format(f'{_IS_BID} and {_PARTNER}')}, call[2])",
    "own_call": "case when depth > 4 then t[depth - 4] end", "own_s": _last(f"{_IS_BID} and {_MINE}", "t[j][2]"), "one_s": _last(f"t[j] similar to '1.*' and {_MINE}", "t[j][2]"),
    "own_passed": f"len(list_filter(range(1, depth), lambda j: t[j] = 'P' and {_MINE})) > 0", "ours": f"len(list_filter(range(1, depth), lambda j: {_IS_BID} and (depth - j) % 2 = 0)) > 0",
    "ol": _last(f"{_IS_BID} and {_THEIRS}", "t[j][1]::int"), "os": _last(f"{_IS_BID} and {_THEIRS}", "t[j][2]"), "strains": f"len({_STRAINS.format(_IS_BID)})", "named": f"list_contains({_STRAINS.format(_IS_BID)}, call[2])",
    "ll": _last(_IS_BID, "t[j][1]::int"), "ls": _last(_IS_BID, "t[j][2]"),
}


def _meanings_sql() -> str:
    # The facts are SQL of their own; the rules, plain conditions, are those of the library and tested by cases.
    facts = ", ".join(f'{v} as "{k}"' for k, v in FACT_SQL.items())
    steps = [f"f0 as (select node, {facts} from (select *, string_split(node, '-') as t from nodes))"]
    for i, layer in enumerate([*M.LAYERS, M.SAME]):
        steps.append(f"f{i + 1} as (select *, " + ", ".join(f"coalesce({v}, false) as {k}" for k, v in layer.items()) + f" from f{i})")
    names = ", ".join(f"'{n}'" for n in M.NAMES)
    counts = ", ".join(f"count(*) filter (where {n})" for n in M.NAMES)
    return f"{W}, {NODES}, {', '.join(steps)} select unnest([{names}]) as meaning, unnest([{counts}]) as calls from f{len(M.LAYERS) + 1}"


@query("call_meanings", _meanings_sql())
def call_meanings(spark, sf_dir):
    """How many calls of the derived bidding tree have each meaning."""
    calls = M.with_meanings(_nodes(spark, sf_dir).select("node"), A.tokens(F.col("node")))
    counted = calls.agg(*[F.count_if(n).alias(n) for n in M.NAMES])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("meaning"), F.col(n).alias("calls")) for n in M.NAMES])).alias("r")).select("r.*")
