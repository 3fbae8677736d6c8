"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealframe.written import Written


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the least of its neighbourhood."""
    s = _both(e)
    low = s.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
    return s.join(low, s.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of these."""
    s = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = s.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    moved = s.join(low, s.a == low.k).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> Written:
    """(node, component) of every node with an edge; component: the least node reachable.

    edges: long columns a and b. Rounds grow with the logarithm of the longest
    path and go on until a round changes no edge. Each round is written to the
    shared folder; a round reads nothing older.
    """
    e = Written(edges.where("a <> b").select("a", "b").distinct())
    while True:
        n = Written(_small(_large(e.df)))
        # Edges are distinct, so equal numbers and nothing new mean equal sets.
        same = n.df.count() == e.df.count() and not n.df.join(e.df, ["a", "b"], "left_anti").take(1)
        e.drop()
        e = n
        if same:
            break
    out = Written(e.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    e.drop()
    return out
