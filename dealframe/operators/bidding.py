"""The bidding table: its nodes, joins of deals to it, checks by seat, and rules compiled into it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealframe.functions import criteria as C
from dealframe.functions import dsl
from dealframe.functions.hand import balanced, suits
from dealframe.operators.relational import with_row_index


def nodes(auctions: DataFrame, tokens: str) -> DataFrame:
    """(bt_index, node, parent, call, depth, complete_below): every prefix of every auction once, numbered in order of node.

    complete_below: the number of auctions at or below the node.
    """
    said = auctions.groupBy(tokens).agg(F.count("*").alias("_n"))
    step = said.select("_n", tokens, F.posexplode(tokens).alias("_i", "call"))
    join = lambda n: F.array_join(F.slice(tokens, F.lit(1), n), "-")
    step = step.select(join(F.col("_i") + 1).alias("node"), join(F.col("_i")).alias("parent"), "call", (F.col("_i") + 1).alias("depth"), "_n")
    every = step.groupBy("node", "parent", "call", "depth").agg(F.sum("_n").alias("complete_below"))
    return with_row_index(every, ["node"], "bt_index")


def once_each(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """rows with columns that depend on the keys alone, worked out once for each distinct combination of keys and joined back; null keys too."""
    known = rows.select(*keys).distinct().withColumns(columns).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(known, reduce(Column.__and__, same), "left").drop(*[f"_k_{k}" for k in keys])


def edges(table: DataFrame) -> DataFrame:
    """(parent_index, bt_index, call): the table joined to itself by node; the root's parent is null."""
    up = table.select(F.col("bt_index").alias("parent_index"), F.col("node").alias("parent"))
    return table.select("bt_index", "parent", "call").join(up, "parent", "left").select("parent_index", "bt_index", "call")


def join_by_auction(deals: DataFrame, table: DataFrame, auction: str, index: str, carry: list[str] = ()) -> DataFrame:
    """Deals with the table's first row (least index) of their auction, and how many rows it has there; null without one."""
    first = table.groupBy(auction).agg(F.count("*").alias("n_rows"), F.min(F.struct(index, *carry)).alias("_f"))
    return deals.join(first.select(auction, "n_rows", "_f.*"), auction, "left")


def overlaid(table: DataFrame, auction: str, criteria: str, rules: DataFrame) -> DataFrame:
    """The table's criteria with an overlay's (partial, added array) appended on every node that begins with the partial; loosest bounds kept."""
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split(auction, "-"))), lambda n: F.array_join(F.slice(F.split(auction, "-"), F.lit(1), n), "-"))
    keys = table.select(auction).distinct().select(auction, F.explode(steps).alias("partial"))
    more = keys.join(rules, "partial").groupBy(auction).agg(F.array_distinct(F.flatten(F.collect_list("added"))).alias("_more"))
    j = table.join(more, auction, "left")
    return j.withColumn(criteria, C.loosest(F.concat(criteria, F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def wrong_bids(joined: DataFrame, hands: dict[int, Column], criteria: dict[int, Column], compounds: list[str] = (), as_json: bool = True) -> DataFrame:
    """The rows with Wrong_Bid_S1..4, Invalid_Criteria_S1..4 (JSON arrays, or lists) and first_wrong_seat (null: none).

    hands: the hand of each seat; criteria: its ``parsed`` list. A seat without criteria
    isn't wrong. compounds: the texts among them that are compound; each is compiled
    once. What can't be told (a name that no hand has) isn't held against a seat.
    """
    metric = {s: {k: v.cast("double") for k, v in [*C.metrics(h).items(), ("Balanced", balanced(suits(h)).cast("int"))]} for s, h in hands.items()}
    known = joined.withColumns({f"_{k}_{s}": v for s, m in metric.items() for k, v in m.items()})

    def of(s: int) -> Column:
        cells = {k: F.col(f"_{k}_{s}") for k in metric[s]}
        cells |= {c.strip(): dsl.compile_criteria(c, known.columns, rename=lambda n: f"_{n}_{s}" if n in metric[s] else n).cast("int").cast("double") for c in compounds}
        return F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])

    known = known.withColumns({f"_known{s}": of(s) for s in hands})
    bad = known.withColumns({f"_bad{s}": F.coalesce(C.failing_parsed(criteria[s], F.col(f"_known{s}"), missing=True), F.array().cast("array<string>")) for s in hands})
    wrong = {s: F.size(f"_bad{s}") > 0 for s in hands}
    out = bad.withColumns({f"Wrong_Bid_S{s}": w for s, w in wrong.items()} | {f"Invalid_Criteria_S{s}": F.to_json(f"_bad{s}") if as_json else F.col(f"_bad{s}") for s in hands})
    first = F.coalesce(*[F.when(wrong[s], F.lit(s)) for s in sorted(hands)])
    return out.withColumn("first_wrong_seat", first).drop(*[f"_{k}{s}" for s in hands for k in ("known", "bad")], *[f"_{k}_{s}" for s in hands for k in metric[s]])


def compile_rules(table: DataFrame, rules: DataFrame, node: str, criteria: str) -> DataFrame:
    """The table's criteria merged with the learned rules of every prefix of its node, in one join.

    rules: (prefix, criterion). A learned bound on a name and side that the base bounds is dropped.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split(node, "-"))), lambda n: F.array_join(F.slice(F.split(node, "-"), F.lit(1), n), "-"))
    keys = table.select(node).distinct().select(node, F.explode(steps).alias("prefix"))
    learned = keys.join(rules.select("prefix", "criterion").distinct(), "prefix").groupBy(node).agg(F.array_sort(F.collect_set("criterion")).alias("_learned"))
    side = lambda p: F.concat(p["name"], F.substring(p["op"], 1, 1))
    base = F.transform(F.filter(criteria, lambda c: C.parts(c)["value"].isNotNull()), lambda c: side(C.parts(c)))
    j = table.join(learned, node, "left").withColumn("_base", base)
    fresh = F.filter(F.coalesce("_learned", F.array().cast("array<string>")), lambda c: ~F.coalesce(F.array_contains("_base", side(C.parts(c))), F.lit(False)))
    return j.withColumn("merged", F.array_distinct(F.concat(criteria, C.loosest(fresh)))).drop("_learned", "_base")


def audit(table: DataFrame, criteria: str, call: str) -> DataFrame:
    """(…, flag, severity): what is doubtful about a row's criteria; passes are exempt."""
    table = table.withColumn("_parsed", C.parsed(F.col(criteria)))
    lo, hi = {}, {}
    for m in ("HCP", "Total_Points"):
        lo[m], hi[m] = C.bounds_of("_parsed", m)
    named = F.transform(criteria, lambda c: C.parts(c)["name"])
    has = lambda pattern: F.exists(named, lambda n: F.coalesce(n.rlike(pattern), F.lit(False)))
    bounded = lambda m: F.exists(criteria, lambda c: (C.parts(c)["name"] == m) & C.parts(c)["op"].isin("<=", "<", "=="))
    none = F.size(criteria) == 0
    flags = [
        ("EMPTY_CRITERIA", "high", none),
        ("NO_STRENGTH", "high", ~none & ~has("^(HCP|Total_Points)$")),
        ("UNBOUNDED_HCP", "low", has("^HCP$") & ~F.coalesce(bounded("HCP"), F.lit(False))),
        ("UNBOUNDED_TOTAL_POINTS", "low", has("^Total_Points$") & ~F.coalesce(bounded("Total_Points"), F.lit(False))),
        ("WIDE_HCP_RANGE", "low", has("^HCP$") & F.coalesce(bounded("HCP"), F.lit(False)) & (hi["HCP"] - lo["HCP"] > 10)),
        ("WIDE_TP_RANGE", "low", has("^Total_Points$") & F.coalesce(bounded("Total_Points"), F.lit(False)) & (hi["Total_Points"] - lo["Total_Points"] > 10)),
        ("NO_SUIT_LENGTH", "medium", ~none & ~has("^SL_")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("flag"), F.lit(s).alias("severity"))) for n, s, c in flags]))
    keep = [c for c in table.columns if c not in ("flag", "severity", "_parsed")]
    return table.where(F.col(call) != "P").select(*keep, F.inline(found))


def contradictions(table: DataFrame, criteria: str) -> DataFrame:
    """(…, kind): how a row's bounds contradict each other or the 13 cards; rows without a fault are left out."""
    table = table.withColumn("_parsed", C.parsed(F.col(criteria)))
    b = {m: C.bounds_of("_parsed", m) for m in C.METRICS}
    least = sum((b[f"SL_{s}"][0] for s in "HDC"), b["SL_S"][0])
    most = sum((F.least(b[f"SL_{s}"][1], F.lit(13)) for s in "HDC"), F.least(b["SL_S"][1], F.lit(13)))
    empty = F.lit(False)
    for lo, hi in b.values():
        empty = empty | (lo > hi)
    extreme = F.lit(False)
    for s in "SHDC":
        extreme = extreme | (b[f"SL_{s}"][0] >= 8)
    tests = [("IMPOSSIBLE_RANGE", empty), ("HCP_EXCEEDS_TP", b["HCP"][0] > b["Total_Points"][1]), ("SUIT_LENGTHS_EXCEED_13", least > 13), ("SUIT_LENGTHS_BELOW_13", most < 13), ("EXTREME_SUIT_LENGTH", extreme)]
    return table.select(*table.columns, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))).alias("kind"))
