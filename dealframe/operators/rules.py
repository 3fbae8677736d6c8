"""Rule learning from auctions: steps, lift, filtering and merging of bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def auction_steps(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, step, prefix, next_bid) for every call of every auction."""
    e = df.select(key, tokens, F.posexplode(tokens).alias("step", "next_bid"))
    prefix = F.array_join(F.slice(tokens, 1, F.col("step")), "-")
    return e.select(key, "step", prefix.alias("prefix"), "next_bid")


def lift(pos: Column, neg: Column) -> Column:
    """P(c | chosen) / P(c | not chosen); null where the latter is 0."""
    return F.when(neg > 0, pos / neg)


def score_criteria(steps: DataFrame, facts: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """(prefix, next_bid, criterion, pos_count, neg_count, pos_rate, neg_rate, lift).

    Every auction that reached a prefix is positive for the call it made and negative
    for the others made there. Counts by prefix and call give both sides, so no
    negative rows are built.
    """
    flags = [F.col(c).cast("int").alias(c) for c in criteria]
    j = steps.join(facts.select(key, *flags), key)
    own = j.groupBy("prefix", "next_bid").agg(F.count("*").alias("pos_count"), *[F.sum(c).alias(c) for c in criteria])
    every = own.groupBy("prefix").agg(F.sum("pos_count").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in criteria])
    both = own.join(every, "prefix")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("p"), (F.col(f"_{c}") - F.col(c)).alias("n")) for c in criteria])).alias("x")
    out = both.select("prefix", "next_bid", "pos_count", (F.col("_n") - F.col("pos_count")).alias("neg_count"), cells)
    pos, neg = F.col("x.p") / F.col("pos_count"), F.try_divide(F.col("x.n"), F.col("neg_count"))
    return out.select("prefix", "next_bid", F.col("x.criterion").alias("criterion"), "pos_count", "neg_count", pos.alias("pos_rate"), neg.alias("neg_rate"), lift(pos, neg).alias("lift"))


def accept(metrics: DataFrame, min_lift: float = 1.5, min_pos: float = 0.5, min_count: int = 50, max_neg: float = 0.8) -> DataFrame:
    """Criteria that are frequent and telling enough; a null lift counts as unbounded."""
    return metrics.where(
        (F.col("lift").isNull() | (F.col("lift") >= min_lift))
        & (F.col("pos_rate") >= min_pos)
        & (F.floor(F.col("pos_rate") * F.col("pos_count")) >= min_count)
        & (F.coalesce("neg_rate", F.lit(0.0)) <= max_neg)
    )


def dedupe_bounds(rows: DataFrame, keys: list[str], name: str, op: str, value: str) -> DataFrame:
    """One bound for each name and operator, the loosest; names whose range is empty go."""
    loosest = rows.groupBy(*keys, name, op).agg(F.when(F.col(op).isin(">=", ">"), F.min(value)).otherwise(F.max(value)).alias(value))
    span = loosest.groupBy(*keys, name).agg(
        F.max(F.when(F.col(op) == ">=", F.col(value)).when(F.col(op) == ">", F.col(value) + 1)).alias("_lo"),
        F.min(F.when(F.col(op) == "<=", F.col(value)).when(F.col(op) == "<", F.col(value) - 1)).alias("_hi"),
    )
    good = span.where("_lo is null or _hi is null or _lo <= _hi")
    return loosest.join(good.select(*keys, name), [*keys, name], "left_semi")


def merge_bounds(base: DataFrame, learned: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds by keys: the base's where it has one, else the learned."""
    j = base.withColumnRenamed("value", "_base").join(learned.withColumnRenamed("value", "_new"), keys, "full_outer")
    return j.select(*keys, F.coalesce("_base", "_new").alias("value"), F.col("_base").isNull().alias("learned"))


#: Two counters of 32 bits in a long: one of each half's lowest bit.
LANES = (1 << 32) + 1


def packed(candidates: list[Column]) -> Column:
    """Candidates' truth as bits: an array of one long for each 64 of them, the first in the lowest bit."""
    word = lambda cs: sum((F.shiftleft(F.coalesce(c, F.lit(False)).cast("long"), i) for i, c in enumerate(cs)), F.lit(0).cast("long"))
    # The highest bit is a sign: bits are joined and not added there.
    parts = [candidates[i : i + 64] for i in range(0, len(candidates), 64)]
    return F.array(*[word(p[:63]).bitwiseOR(F.shiftleft(F.coalesce(p[63], F.lit(False)).cast("long"), 63)) if len(p) == 64 else word(p) for p in parts])


def counted_bits(rows: DataFrame, keys: list[str], bits: str, n: int) -> DataFrame:
    """(keys, rows, counts): how often each of the n bits is set in each group, as an array.

    Vertical counters: a word shifted by k and masked adds to two 32-bit counters at
    once, bits k and k + 32, so 64 candidates cost 32 sums and no row is expanded. A
    partition's counters can't overflow; they are taken apart before partitions are added.
    """
    words = -(-n // 64)
    sums = {f"_{w}_{k}": F.sum(F.shiftrightunsigned(F.get(bits, F.lit(w)), k).bitwiseAND(F.lit(LANES))) for w in range(words) for k in range(min(32, n - 64 * w))}
    part = rows.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(F.count("*").alias("rows"), *[s.alias(c) for c, s in sums.items()])
    lane = lambda j: (F.shiftrightunsigned(f"_{j // 64}_{j % 32}", 32) if j % 64 >= 32 else F.col(f"_{j // 64}_{j % 32}").bitwiseAND(F.lit((1 << 32) - 1))) if j % 64 < 64 else None
    flat = part.select(*keys, "rows", *[lane(j).alias(f"c{j}") for j in range(n)])
    total = flat.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(f"c{j}").alias(f"c{j}") for j in range(n)])
    return total.select(*keys, "rows", F.array(*[F.col(f"c{j}") for j in range(n)]).alias("counts"))


def learned(counts: DataFrame, prefix: str, call: str, candidates: DataFrame) -> DataFrame:
    """(prefix, call, criterion, name, op, pos_count, neg_count, pos_rate, neg_rate, lift) of every candidate at every call, from ``counted_bits``.

    candidates: (place, criterion, name, op). The calls not made at a prefix are what its
    other groups hold.
    """
    cells = counts.select(prefix, call, "rows", F.posexplode("counts").alias("place", "p"))
    every = cells.groupBy(prefix, "place").agg(F.sum("rows").alias("_n"), F.sum("p").alias("_p"))
    both = cells.join(every, [prefix, "place"]).join(candidates, "place")
    pos, neg = F.col("p") / F.col("rows"), F.try_divide(F.col("_p") - F.col("p"), F.col("_n") - F.col("rows"))
    return both.select(prefix, call, "criterion", "name", "op", F.col("rows").alias("pos_count"), (F.col("_n") - F.col("rows")).alias("neg_count"), pos.alias("pos_rate"), neg.alias("neg_rate"), lift(pos, neg).alias("lift"))


def best_by_side(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Of the criteria on one name and operator the one of highest lift (null is above all), then the first by text: a greedy cover of what a call says."""
    order = F.struct((-F.coalesce("lift", F.lit(float("inf")))).alias("l"), "criterion")
    best = rules.groupBy(*keys, "name", "op").agg(F.min_by(F.struct("criterion", "pos_count", "neg_count", "pos_rate", "neg_rate", "lift"), order).alias("_b"))
    return best.select(*keys, "_b.*")
