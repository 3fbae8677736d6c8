"""Boxes of many dims over points: an inverted bitmap index, and sums over boxes from a summed-area table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealframe.written import Written

#: Boxes of an index, and points, that meet in one task.
BOXES, POINTS = 1 << 14, 1 << 17


class Bitmaps:
    """For each dim and value the set of boxes around it, as packed bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        """low, high: boxes x dims, both included."""
        self.base, self.n = low.min(0), len(low)
        self.bits = []
        for d in range(low.shape[1]):
            values = np.arange(self.base[d], high[:, d].max() + 1)
            held = (low[:, d] <= values[:, None]) & (values[:, None] <= high[:, d])
            # The last row is for values that no box holds.
            self.bits.append(np.concatenate([np.packbits(held, axis=1), np.zeros((1, -(-self.n // 8)), np.uint8)]))

    def around(self, x: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(bits, place): the boxes around each distinct row of x, and the distinct row of each row.

        Dims are met group by group (a seat's): once for each distinct tuple of a group,
        then once for each distinct combination of tuples.
        """
        out, place = None, np.zeros(len(x), np.int64)
        for g in groups:
            tuples, of = np.unique(x[:, g], axis=0, return_inverse=True)
            own = np.full((len(tuples), -(-self.n // 8)), 255, np.uint8)
            for j, d in enumerate(g):
                at = tuples[:, j] - self.base[d]
                at = np.where((at >= 0) & (at < len(self.bits[d]) - 1), at, len(self.bits[d]) - 1)
                own &= self.bits[d][at]
            if out is None:
                out, place = own, of.ravel()
                continue
            both, again = np.unique(np.stack([place, of.ravel()], 1), axis=0, return_inverse=True)
            out, place = out[both[:, 0]] & own[both[:, 1]], again.ravel()
        return out, place


def _met(points: DataFrame, boxes: DataFrame, dims: list[list[str]], key: str, box: str, schema: str, answer, more: tuple[str, ...] = ()) -> DataFrame:
    """``answer(Bitmaps, box ids, keys, values, groups, more)`` -> arrays, for every block of points beside every block of boxes.

    Both sides are dealt into blocks by hash, and each side goes to all blocks of the
    other: points x blocks of boxes and boxes x blocks of points rows are shuffled, and
    only bits are compared. Null values are in no box. more: columns of whole numbers that
    a point brings along.
    """
    flat = [d for g in dims for d in g]
    groups, at = [], 0
    for g in dims:
        groups.append(list(range(at, at + len(g))))
        at += len(g)
    nb, np_ = -(-boxes.count() // BOXES), -(-points.count() // POINTS)
    cells = lambda cols: F.array(*[F.col(c).cast("int") for c in cols])
    ok = lambda df, cols: df.dropna(subset=cols)
    none = F.lit(None).cast("array<int>")
    block = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    lo, hi = [f"{d}_min" for d in flat], [f"{d}_max" for d in flat]
    b = ok(boxes, lo + hi).select(block(box, nb).alias("b"), F.lit(0).alias("kind"), F.col(box).cast("long").alias("id"), cells(lo).alias("x"), cells(hi).alias("y"), F.array().cast("array<long>").alias("w")).withColumn("p", every(np_))
    p = ok(points, flat).select(block(key, np_).alias("p"), F.lit(1).alias("kind"), F.col(key).cast("long").alias("id"), cells(flat).alias("x"), none.alias("y"), F.array(*[F.col(c).cast("long") for c in more]).cast("array<long>").alias("w")).withColumn("b", every(nb))
    units = b.unionByName(p).repartition(max(1, nb * np_), "b", "p").sortWithinPartitions("b", "p", "kind", "id")
    wide = lambda col: col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)

    def run(batches):
        at, ids, low, high, index = None, [], [], [], None
        for batch in batches:
            bs, ps, kind = (batch.column(i).to_numpy() for i in (0, 1, 2))
            cut = np.flatnonzero((np.diff(bs) != 0) | (np.diff(ps) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(bs)], strict=True):
                part = batch.slice(i, j - i)
                if (bs[i], ps[i]) != at:
                    at, ids, low, high, index = (bs[i], ps[i]), [], [], [], None
                if not kind[i]:
                    ids.append(part.column(3).to_numpy())
                    low.append(wide(part.column(4)))
                    high.append(wide(part.column(5)))
                    index = None
                elif ids:
                    if index is None:
                        index = Bitmaps(np.concatenate(low), np.concatenate(high)), np.concatenate(ids)
                    yield from answer(index[0], index[1], part.column(3).to_numpy(), wide(part.column(4)), groups, wide(part.column(6)))

    return units.select("b", "p", "kind", "id", "x", "y", "w").mapInArrow(run, schema)


def matches(points: DataFrame, boxes: DataFrame, dims: list[list[str]], key: str, box: str) -> DataFrame:
    """(key, box) of every point within every box; boxes have ``{dim}_min`` and ``{dim}_max``; dims: by group (seat)."""

    def answer(index, ids, keys, x, groups, _):
        bits, place = index.around(x, groups)
        for i in range(0, len(keys), 512):
            row, col = np.nonzero(np.unpackbits(bits[place[i : i + 512]], axis=1, count=index.n))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 512][row]), pa.array(ids[col])], names=[key, box])

    return _met(points, boxes, dims, key, box, f"`{key}` long, `{box}` long", answer)


def summary(points: DataFrame, boxes: DataFrame, dims: list[list[str]], key: str, box: str) -> DataFrame:
    """(box, n, first, last): how many points each box holds, and their least and greatest key; boxes without any are left out.

    The same match, counted by box where the bits are, so that no pair is made. Points
    with the same values are in the same boxes: each distinct one goes to the blocks of
    boxes once, with how many they are and the greatest key.
    """
    flat = [d for g in dims for d in g]
    points = points.dropna(subset=flat).groupBy(*flat).agg(F.min(key).alias(key), F.max(key).alias("_last"), F.count("*").alias("_n"))
    points = Written(points).df

    def answer(index, ids, keys, x, groups, more):
        bits, place = index.around(x, groups)
        n = np.zeros(index.n, np.int64)
        first, last = np.full(index.n, np.iinfo(np.int64).max), np.full(index.n, np.iinfo(np.int64).min)
        for i in range(0, len(keys), 512):
            held = np.unpackbits(bits[place[i : i + 512]], axis=1, count=index.n).view(bool)
            hit, k, (top, many) = held.any(0), keys[i : i + 512], more[i : i + 512].T
            n[hit] += many @ held[:, hit]
            # Least keys of a unit come in order; the greatest are put in order.
            first[hit] = np.minimum(first[hit], k[held[:, hit].argmax(0)])
            down = np.argsort(-top)
            last[hit] = np.maximum(last[hit], top[down][held[down][:, hit].argmax(0)])
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (ids, n, first, last)], names=[box, "n", "first", "last"])

    part = _met(points, boxes, dims, key, box, f"`{box}` long, n long, first long, last long", answer, ("_last", "_n"))
    return part.groupBy(box).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def summed_area(points: DataFrame, dims: list[str], keys: list[str], value: str, boxes: DataFrame, box: str) -> DataFrame:
    """(box, keys, n, mean, deviation) of the points' integer value within each box, by keys; population deviation; no row for none.

    Sums are kept at the bounds that boxes have, for all combinations of dims: the grid
    of distinct bounds (a list a dim, bounded by the metrics' domains) is filled with
    counts, sums and squares and summed along each dim in turn. A box is then the
    signed sum of its 2^dims corners, each met by one equality join on its place.
    Boxes that are empty in some dim hold nothing.
    """
    for d in dims:
        boxes = boxes.where(F.col(f"{d}_min") <= F.col(f"{d}_max"))
    ends = boxes.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(F.col(f"{d}_min") - 1, F.col(f"{d}_max")))))).alias(d) for d in dims]).first()
    cuts = {d: [int(c) for c in ends[d]] or [0] for d in dims}
    strides, step = {}, 1
    for d in dims:
        strides[d] = step
        step *= len(cuts[d])

    def place(d: str):
        """The first bound at or above the value; null above all of them."""
        table = np.searchsorted(cuts[d], np.arange(cuts[d][0], cuts[d][-1] + 1)).tolist()
        v = F.col(d).cast("int")
        return F.when(v <= cuts[d][0], 0).otherwise(F.get(F.lit(table), v - cuts[d][0]))

    at = [f"_{d}" for d in dims]
    got = points.select(*keys, F.col(value).cast("decimal(20,0)").alias("_v"), *[place(d).alias(f"_{d}") for d in dims]).dropna(subset=at)
    sums = got.groupBy(*keys, *at).agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
    grid = points.select(*keys).distinct()
    for d in dims:
        grid = grid.withColumn(f"_{d}", F.explode(F.sequence(F.lit(0), F.lit(len(cuts[d]) - 1))))
    grid = grid.join(sums, [*keys, *at], "left").fillna(0, ["n", "s", "q"])
    for d in at:
        w = Window.partitionBy(*keys, *[x for x in at if x != d]).orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumns({c: F.sum(c).over(w) for c in ("n", "s", "q")})
    code = sum((F.col(f"_{d}") * strides[d] for d in dims), F.lit(0)).cast("long")
    grid = Written(grid.select(*keys, code.alias("_code"), "n", "s", "q")).df

    def corner(m):
        low = lambda i: F.shiftright(m, i).bitwiseAND(F.lit(1)) == 1
        where = sum((F.when(low(i), F.col(f"_l{i}")).otherwise(F.col(f"_h{i}")) for i in range(len(dims))), F.lit(0).cast("long"))
        return F.struct(where.alias("_code"), (1 - 2 * (F.bit_count(m) % 2)).alias("_sign"))

    # A box's bounds are looked up once each, not once a corner.
    spot = lambda c, d: (F.array_position(F.lit(cuts[d]), c) - 1) * strides[d]
    spots = boxes.select(box, *[x for i, d in enumerate(dims) for x in (spot(F.col(f"{d}_min") - 1, d).alias(f"_l{i}"), spot(F.col(f"{d}_max"), d).alias(f"_h{i}"))])
    corners = spots.select(box, F.inline(F.transform(F.lit(list(range(1 << len(dims)))), corner)))
    # Merged: sorted cells compress to a small file, which Spark would take for a side to send whole through the driver.
    total = corners.join(grid.hint("merge"), "_code").groupBy(box, *keys).agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in ("n", "s", "q")]).where("n > 0")
    mean = F.col("s").cast("double") / F.col("n")
    # n q - s^2 is exact.
    spread = (F.col("n").cast("decimal(38,0)") * F.col("q").cast("decimal(38,0)") - F.col("s").cast("decimal(38,0)") * F.col("s").cast("decimal(38,0)")).cast("double")
    return total.select(box, *keys, "n", mean.alias("mean"), (F.sqrt(spread) / F.col("n")).alias("deviation"))
