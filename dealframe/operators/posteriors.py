"""What a partnership holds given an auction: histograms of two partners, convolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(value: Column, most: int) -> Column:
    """Aggregate: counts of 0 to ``most`` as an array."""
    return F.array(*[F.count_if(value == i) for i in range(most + 1)])


def convolved(first: str, second: str, most: int) -> Column:
    """The counts of all pairs by their sum, 0 to 2 most: columns of counts of 0 to most."""
    pairs = f"aggregate(sequence(greatest(0, k - {most}), least({most}, k)), 0L, (s, i) -> s + {first}[i] * {second}[k - i])"
    return F.expr(f"transform(sequence(0, {2 * most}), k -> {pairs})")


def share_at_least(counts: Column, least: int) -> Column:
    """The share of a histogram at or above a value."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    high = F.aggregate(F.slice(counts, least + 1, 10_000), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.try_divide(high.cast("double"), total)


def mean_of(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    weighed = F.aggregate(F.transform(counts, lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.try_divide(weighed.cast("double"), total)


def partner_fit(rows: DataFrame, keys: list[str], own: str, partner: str, most: int, fit: int) -> DataFrame:
    """(keys, n, p_fit, p_fit_seen, mean_fit): the chance that two partners hold ``fit`` together.

    p_fit comes from the convolution of their histograms, as one who sees neither hand
    reckons; p_fit_seen from the hands themselves; mean_fit is the mean of the sum.
    """
    h = rows.groupBy(*keys).agg(F.count("*").alias("n"), histogram(F.col(own), most).alias("_a"), histogram(F.col(partner), most).alias("_b"), F.count_if(F.col(own) + F.col(partner) >= fit).alias("_seen"))
    both = h.withColumn("_sum", convolved("_a", "_b", most))
    return both.select(*keys, "n", share_at_least(F.col("_sum"), fit).alias("p_fit"), (F.col("_seen") / F.col("n")).alias("p_fit_seen"), mean_of(F.col("_sum")).alias("mean_fit"))
