"""Relational shapes that frames have and SQL lacks, as distributed plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealframe.written import Written


def with_row_index(df: DataFrame, order: list[str], name: str = "index", start: int = 0) -> DataFrame:
    """Rows numbered in ``order``: a sort by ranges, then each range's rows and the number of rows before it.

    No task sees more than a range; ties are numbered in any order.
    """
    ranged = Written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())).df
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row a range: the window over counts and the broadcast are as small as the number of partitions.
    j = ranged.withColumn("_at", place).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return j.withColumn(name, (F.col("_before") + F.col("_at") - 1 + start).cast("long")).drop("_part", "_at", "_before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over a row and all before it in ``order``, a range of rows at a time as in ``with_row_index``."""
    ranged = Written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())).df
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    j = ranged.withColumn("_at", own).join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return j.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def hstack(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their places in two orders; the shorter side is padded with nulls."""
    a, b = with_row_index(left, left_order, "_i"), with_row_index(right, right_order, "_i")
    return a.join(b, "_i", "full_outer").withColumnRenamed("_i", "index")


def select_matching(df: DataFrame, pattern: str, *more: str) -> DataFrame:
    """``more`` and the columns whose whole name matches a regular expression, in the frame's order."""
    return df.select(*more, *[c for c in df.columns if re.fullmatch(pattern, c) and c not in more])


def implies(when: Column, then: Column) -> Column:
    """Kept where ``when`` doesn't hold (or is null) or ``then`` does."""
    return ~F.coalesce(when, F.lit(False)) | F.coalesce(then, F.lit(False))


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in the order of a seeded hash of the key; seed 0 draws anew each time."""
    order = F.rand() if seed == 0 else F.xxhash64(F.col(key), F.lit(seed))
    return df.orderBy(order, key).limit(n)


def common_items(lists: DataFrame, group: str, item: str) -> DataFrame:
    """(item) that every group of (group, item) holds: counts of distinct groups, compared with their number."""
    pairs = lists.select(group, item).distinct()
    need = pairs.agg(F.count_distinct(group).alias("_need"))
    have = pairs.groupBy(item).agg(F.count("*").alias("_have"))
    return have.join(F.broadcast(need), F.col("_have") == F.col("_need")).select(item)


def lookup(value: Column, mapping: dict, default=None, strict: bool = False) -> Column:
    """A dictionary as an expression. strict: a value that it lacks is an error; else ``default``."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.try_element_at(table, value)
    missing = F.raise_error(F.concat(F.lit("no entry for "), value.cast("string"))) if strict else F.lit(default)
    return F.when(value.isNull(), F.lit(default)).when(F.array_contains(F.map_keys(table), value), got).otherwise(missing)


def horizontal_sum(*columns: Column) -> Column:
    """Sum of a row's columns; nulls count as 0."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0))
    return out


def value_shares(df: DataFrame, keys: list[str], value: str, domain: list) -> DataFrame:
    """(keys, value, n, share) for every value of a stated domain, 0 where a group lacks it; values outside count in the shares' base."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("_t"), *[F.count_if(F.col(value) == v).alias(f"_{i}") for i, v in enumerate(domain)])
    cells = F.array(*[F.struct(F.lit(v).alias(value), F.col(f"_{i}").alias("n")) for i, v in enumerate(domain)])
    return counts.select(*keys, "_t", F.inline(cells)).select(*keys, value, "n", F.try_divide(F.col("n"), F.col("_t")).alias("share"))
