"""Deals against bidding-table ranges, and the indexes built from the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealframe.written import Written

#: Range rows that may be broadcast; beyond that the range join runs on a coarse grid.
BROADCAST_ROWS = 500_000


def bucket_range_match(deals: DataFrame, ranges: DataFrame, dims: list[str], key: str, range_key: str, count: int | None = None) -> DataFrame:
    """(key, range_key) of every deal within every box.

    Deals collapse to distinct value tuples and boxes to distinct bounds; only these
    meet in a range join, and the pairs are expanded by equality joins. ranges has
    ``{dim}_min`` and ``{dim}_max`` for each dim. With more boxes than may be
    broadcast, both sides are cut by the first dim into unit cells and joined on them.
    """
    hit, bounds = _hits(deals.select(*dims).distinct(), ranges, dims, count)
    return deals.select(key, *dims).join(hit, dims).join(ranges.select(range_key, *bounds), bounds).select(key, range_key)


def bucket_range_summary(deals: DataFrame, ranges: DataFrame, dims: list[str], key: str, range_key: str) -> DataFrame:
    """(range_key, n, first, last): how many deals each box holds, and their least and greatest key.

    The same match with its pairs left unexpanded: deals are counted by value tuple,
    and the counts are added up by distinct box. Boxes without a deal are left out.
    """
    buckets = deals.groupBy(*dims).agg(F.count("*").alias("_n"), F.min(key).alias("_first"), F.max(key).alias("_last"))
    hit, bounds = _hits(buckets, ranges, dims, None)
    sums = hit.groupBy(*bounds).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    both = ranges.select(range_key, *bounds).join(sums, bounds)
    return both.groupBy(range_key).agg(F.sum("_n").alias("n"), F.min("_first").alias("first"), F.max("_last").alias("last"))


def _hits(buckets: DataFrame, ranges: DataFrame, dims: list[str], count: int | None) -> tuple[DataFrame, list[str]]:
    """Buckets (one row a value tuple) beside every distinct box around them, and the names of the bounds."""
    bounds = [f"{d}_{e}" for d in dims for e in ("min", "max")]
    boxes = ranges.select(*bounds).distinct()
    inside = [F.col(d).between(F.col(f"{d}_min"), F.col(f"{d}_max")) for d in dims]
    cond = inside[0]
    for c in inside[1:]:
        cond = cond & c
    if (boxes.count() if count is None else count) <= BROADCAST_ROWS:
        hit = buckets.join(F.broadcast(boxes), cond)
    else:
        d = dims[0]
        cells = boxes.withColumn("_cell", F.explode(F.sequence(F.floor(f"{d}_min").cast("long"), F.floor(f"{d}_max").cast("long"))))
        hit = buckets.withColumn("_cell", F.floor(d).cast("long")).join(cells, "_cell").where(cond).drop("_cell")
    return hit, bounds


def seat_boxes(deals: DataFrame, boxes: DataFrame, first: list[str], rest: list[str], key: str, box: str) -> DataFrame:
    """(key, box) of every deal within every box of many dims.

    Equal boxes are one. The dims of ``first`` (one seat's) name the candidates, by
    distinct values against distinct bounds as in ``bucket_range_match``; the ``rest``
    are then compared pair by pair, on candidates alone.
    """
    bounds = [f"{d}_{e}" for d in (*first, *rest) for e in ("min", "max")]
    group = boxes.groupBy(*bounds).agg(F.collect_set(box).alias("_boxes"))
    hit, near = _hits(deals.select(*first).distinct(), group, first, None)
    inside = F.lit(True)
    for d in rest:
        inside = inside & F.col(d).between(F.col(f"{d}_min"), F.col(f"{d}_max"))
    pairs = deals.select(key, *first, *rest).join(hit, first).join(group, near).where(inside)
    return pairs.select(key, F.explode("_boxes").alias(box))


def template_division(pairs: DataFrame, required: DataFrame, item: str, template: str, prop: str) -> DataFrame:
    """(item, template) of the items that have every property that a template asks for.

    Relational division: count the properties they share and compare with the number asked.
    """
    need = required.select(template, prop).distinct()
    size = need.groupBy(template).agg(F.count("*").alias("_need"))
    have = pairs.select(item, prop).distinct().join(need, prop).groupBy(item, template).agg(F.count("*").alias("_have"))
    return have.join(size, template).where("_have = _need").select(item, template)


def invert_capped(matches: DataFrame, deal: str, node: str, cap: int) -> DataFrame:
    """node -> its first ``cap`` deals in order, as an array."""
    w = Window.partitionBy(node).orderBy(deal)
    top = matches.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    return top.groupBy(node).agg(F.sort_array(F.collect_list(deal)).alias("deals"))


def reachable(edges: DataFrame, goals: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes from which a goal can be reached: goals and all their ancestors, by semi-joins up the edges.

    Each round's front and the nodes found so far are written to the shared folder, so
    no plan grows with the rounds; rounds go on until a front is empty. Null ends lead nowhere.
    """
    up = edges.select(F.col(parent).alias("node"), F.col(child).alias("_below")).where("node is not null").distinct()
    start = goals.select(F.col(goals.columns[0]).alias("node")).where("node is not null").distinct()
    found = front = Written(start)
    while front.df.take(1):
        new = up.join(front.df.withColumnRenamed("node", "_below"), "_below", "left_semi").select("node").distinct()
        last, front = front, Written(new.join(found.df, "node", "left_anti"))
        grown = Written(found.df.unionByName(front.df))
        for old in {found, last}:
            old.drop()
        found = grown
    if front is not found:
        front.drop()
    return found.df
