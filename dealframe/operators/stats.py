"""Histograms, cubes, weighted statistics and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 500_000


def cube(df: DataFrame, dims: list[str], sums: list[str] = ()) -> DataFrame:
    """Count (and sums) by the dims."""
    return df.groupBy(*dims).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def weighted_stats(cube_df: DataFrame, ranges: DataFrame, key: str, dim: str, lo: str, hi: str) -> DataFrame:
    """Count, mean, population deviation, min and max of ``dim`` over a cube's buckets within each range.

    Equal ranges are answered once. The cube's side has one row a value; it is broadcast
    where it has at most BROADCAST_ROWS, beyond that Spark chooses.
    """
    values, every = cube_df.groupBy(dim).agg(F.sum("n").alias("n")), ranges.select(lo, hi).distinct()
    side = F.broadcast(values) if values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else values
    j = every.join(side, F.col(dim).between(F.col(lo), F.col(hi)), "left")
    n = F.sum("n")
    mean = F.sum(F.col(dim) * F.col("n")) / n
    var = F.sum(F.col(dim) * F.col(dim) * F.col("n")) / n - mean * mean
    found = j.groupBy(lo, hi).agg(F.coalesce(n, F.lit(0)).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.min(dim).alias("min"), F.max(dim).alias("max"))
    return ranges.select(key, lo, hi).join(found, (ranges[lo].eqNullSafe(found[lo])) & (ranges[hi].eqNullSafe(found[hi]))).select(key, "n", "mean", "std", "min", "max")


def histogram_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Inverted-CDF quantiles of integer values: the least value whose count below or at it reaches ceil(q n).

    The histogram is aggregated before values are put in order, so a group's list is as long as its distinct values.
    """
    hist = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    lists = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_h"), F.sum("_n").alias("n"))

    def at(q: float) -> Column:
        need = F.ceil(F.col("n") * q)
        start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast(dict(hist.dtypes)["_v"]).alias("v"))
        return F.aggregate("_h", start, lambda s, x: F.struct((s["c"] + x["_n"]).alias("c"), F.when(s["c"] >= need, s["v"]).otherwise(x["_v"]).alias("v")))["v"]

    return lists.select(*keys, "n", *[at(q).alias(f"p{round(q * 100)}") for q in qs])


def entropy_nats(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return counts.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.log(p))).alias("entropy"), F.count("*").alias("n_items"))


def midrank_percentile(df: DataFrame, keys: list[str], value: str, pinned: Column, out: str) -> DataFrame:
    """100 (count below + half the ties) / n of a pinned value in each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg((100.0 * (F.count_if(v < pinned) + 0.5 * F.count_if(v == pinned)) / F.count(v)).alias(out))


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, std) of numeric columns; a deviation of 0 becomes 1. One scan."""
    aggs = [f for c in columns for f in (F.avg(c).alias(f"{c}|m"), F.stddev_samp(c).alias(f"{c}|s"))]
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}|m`").alias("mean"), F.when(F.col(f"`{c}|s`") == 0, 1.0).otherwise(F.col(f"`{c}|s`")).alias("std")) for c in columns]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles from counts of distinct values: a group's buffer is two numbers a quantile, not its rows."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_v")
    cum = hist.withColumn("_c", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.join(hist.groupBy(*keys).agg(F.sum("_n").alias("_t")), keys)
    at = [F.lit(q) * (F.col("_t") - 1) for q in qs]
    ends = [f(F.when(F.col("_c") > g(p), F.col("_v"))).alias(f"_{n}{i}") for i, p in enumerate(at) for n, f, g in (("lo", F.min, F.floor), ("hi", F.min, F.ceil))]
    out = cum.groupBy(*keys, "_t").agg(*ends)
    part = lambda p: p - F.floor(p)
    return out.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(p)).alias(f"q{round(q * 100)}") for i, (q, p) in enumerate(zip(qs, at, strict=True))])


def scaled(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their means, divided by their deviations (``scaling``); NaN counts as 0, infinities as plus or minus a million."""
    one = params.groupBy().pivot("name", columns).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    clean = lambda c: F.when(F.isnan(c), 0.0).when(c == float("inf"), 1e6).when(c == float("-inf"), -1e6).otherwise(c)
    # One row of parameters.
    j = df.join(F.broadcast(one))
    return j.select(*[((clean(F.col(c).cast("double")) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) if c in columns else F.col(c) for c in df.columns])
