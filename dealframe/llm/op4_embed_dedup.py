"""Embedding near-deduplication: spherical k-means cells, blocked cosine products.

Equal vectors are one class with a count. Cells come from spherical k-means on a
bounded sample (at most SAMPLE vectors); centroids closer than the link threshold
are merged, so that a dense cluster isn't cut up. Every class is assigned to its
nearest cell and also visits every cell that may hold a link which would otherwise
be missed. Let x in cell c and y in cell d be linked: the amounts by which each lies
nearer to its own centroid than to the other's sum to (c - d)(x - y), so for one of
the two it is at most half of that, and that one visits. The sum is |c - d| |x - y|
times the cosine of the angle between the two differences: 1 at most, and for
directions that don't know of the cells a number with mean 0 and deviation
1 / sqrt(d), d being the effective dimension of the vectors about their centroids
(the participation ratio of their covariance, from the sample). Vectors visit up to
SIGMAS such deviations, or up to the exact bound where that is less, so the chance
to miss a link is below 0.0001 whatever the number of cells. Cells are cut into
blocks of about BLOCK_ROWS, and blocks meet in tasks of bounded size as matrix
products in double precision. A pair is judged in one cell only. The tests compare
with brute force.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of each length are compared among themselves
only; rows that repeat a vec_id are one vector, the least in order; a null
vec_id links with nothing and has a null component_id and kept false; labels and
other columns are ignored; an empty table gives no rows; ties in the nearest cell
go to the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealframe.llm._common import Scratch, parts, table
from dealframe.llm._graph import components

COSINE = 0.9
#: Vectors that the index is fitted on at most (the first by hash of id), and cells at most.
SAMPLE, CELLS_MAX, CELL_ROWS = 16_384, 4096, 400
BLOCK_ROWS = 1024
#: Deviations of a link's share that a vector visits.
SIGMAS = 4.0
#: A class of more rows is joined to its rows by broadcast; there are at most rows / HOT of them.
HOT = 10_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, cosine: float = COSINE) -> np.ndarray:
    """Unit centroids of unit rows; those within ``cosine`` of an earlier one are merged into it."""
    k = min(k, len(x))
    c = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    keep: list[int] = []
    for i in range(k):
        if not keep or (c[keep] @ c[i]).max() < cosine:
            keep.append(i)
    return c[keep]


def effective_dimension(x: np.ndarray, c: np.ndarray) -> float:
    """The participation ratio of the covariance of unit rows about their nearest centroids; of the rows where these have no spread."""
    near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
    d = x - c[near]
    spread = np.linalg.eigvalsh(d.T @ d)
    return float(spread.sum() ** 2 / (spread * spread).sum()) if spread.sum() > 1e-9 else 1.0


def _digested(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, key): key is a 128-bit digest of a valid vector's components, null for others."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = F.col("vec_id").isNotNull() & ok & F.exists("embedding", lambda v: v != 0)
    # -0.0 and 0.0 are the same component.
    v = F.transform("embedding", lambda v: v + F.lit(0.0))
    return vectors.select("vec_id", "embedding", F.when(valid, F.struct(F.xxhash64(v).alias("a"), F.xxhash64(v, F.lit(1)).alias("b"))).alias("key"))


def _assign(classes: DataFrame, cells: np.ndarray, cosine: float, share: float) -> DataFrame:
    """(vec, n, v, home, visits): components as bytes of doubles, nearest cell, other cells to visit."""
    gaps = np.sqrt(np.maximum(2 - 2 * (cells @ cells.T), 0))
    held = classes.sparkSession.sparkContext.broadcast((cells, gaps * share * np.sqrt(max(0.0, (1 - cosine) / 2)) + 1e-6))

    def run(batches):
        c, reach = held.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                col = part.column(0)
                x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                u = unit_rows(x)
                cos = u @ c.T
                home = cos.argmax(1)
                near = cos[np.arange(len(x)), home][:, None] - cos <= reach[home]
                near[np.arange(len(x)), home] = False
                visits = [np.flatnonzero(r).tolist() for r in near]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))],
                    names=["vec", "n", "v", "home", "visits"],
                )

    return classes.select("embedding", "vec", "n").mapInArrow(run, "vec long, n long, v binary, home int, visits array<int>")


def _units(rows: DataFrame) -> DataFrame:
    """Rows in the units (cell, mb, qb) where they are compared.

    side 0 and 1: home rows of blocks mb <= qb; 2: home rows, 3: visitors.
    """
    seen = rows.select(F.col("home").alias("cell"), F.lit(1).alias("own"), F.lit(0).alias("guest"))
    seen = seen.unionByName(rows.select(F.explode("visits").alias("cell"), F.lit(0).alias("own"), F.lit(1).alias("guest")))
    plan = seen.groupBy("cell").agg(F.sum("own").alias("own"), F.sum("guest").alias("guest")).where("own > 1 or (own > 0 and guest > 0)")
    plan = plan.select("cell", "own", F.ceil(F.col("own") / BLOCK_ROWS).cast("int").alias("nb"), F.ceil(F.col("guest") / BLOCK_ROWS).cast("int").alias("nq"))
    data = ["vec", "n", "v", "home", "visits"]
    own = rows.withColumn("cell", F.col("home")).join(F.broadcast(plan), "cell").withColumn("b", F.pmod(F.xxhash64("vec"), F.col("nb")).cast("int"))
    inner = own.where("own > 1").withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    inner = inner.select("cell", F.least("b", "o").alias("mb"), F.greatest("b", "o").alias("qb"), (F.col("b") > F.col("o")).cast("int").alias("side"), *data)
    member = own.where("nq > 0").select("cell", F.col("b").alias("mb"), F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"), F.lit(2).alias("side"), *data)
    guest = rows.withColumn("cell", F.explode("visits")).join(F.broadcast(plan), "cell")
    guest = guest.select("cell", F.explode(F.expr("sequence(0, nb - 1)")).alias("mb"), F.pmod(F.xxhash64("vec"), F.col("nq")).cast("int").alias("qb"), F.lit(3).alias("side"), *data)
    return inner.unionByName(member).unionByName(guest)


def _compare(cosine: float):
    """mapInArrow over sorted units: (a, b, n): b null: n more links of a; else a link of a spanning forest."""
    from dealframe.llm.op3_ngram_join import forest

    def unit(key, held: dict[int, list]) -> list[tuple[int, int | None, int]]:
        out: list[tuple[int, int | None, int]] = []
        for left, right in ((0, 1), (2, 3)):
            x = held.get(left)
            y = held.get(right)
            if left == 0 and x and key[1] == key[2]:
                y = x
            if not x or not y:
                continue
            a, b = np.stack([r[2] for r in x]), np.stack([r[2] for r in y])
            ok = a @ b.T >= cosine
            if x is y:
                np.fill_diagonal(ok, False)
            if left == 2:
                # A pair that also meets in the visitor's own cell is judged in the lesser cell.
                homes = np.array([r[3] for r in y])
                for h in np.unique(homes):
                    if h < key[0]:
                        also = np.array([h in r[4] for r in x])
                        ok &= ~(also[:, None] & (homes == h)[None])
            nx, ny = np.array([r[1] for r in x]), np.array([r[1] for r in y])
            for r, n in zip(x, ok @ ny, strict=True):
                if n:
                    out.append((r[0], None, int(n)))
            if x is not y:
                for r, n in zip(y, nx @ ok, strict=True):
                    if n:
                        out.append((r[0], None, int(n)))
            i, j = np.nonzero(ok)
            ids = [r[0] for r in x] + [r[0] for r in y]
            pairs = np.stack([i, j], 1) if x is y else np.stack([i, j + len(x)], 1)
            out += [(ids[p], ids[q], 0) for p, q in forest(len(ids), pairs)]
        return out

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "n"])

    def run(batches):
        key, held = None, {}
        for b in batches:
            found = []
            cols = [b.column(i).to_pylist() for i in range(9)]
            for cell, mb, qb, side, vec, n, v, home, visits in zip(*cols, strict=True):
                if (cell, mb, qb) != key:
                    if held:
                        found += unit(key, held)
                    key, held = (cell, mb, qb), {}
                held.setdefault(side, []).append((vec, n, np.frombuffer(v, np.float64), home, set(visits)))
            if found:
                yield batch(found)
        if held and (found := unit(key, held)):
            yield batch(found)

    return run


def neighbours(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of vectors (vec_id, embedding)."""
    spark, tmp = vectors.sparkSession, Scratch()
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    named = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = tmp.keep(_digested(named.unionByName(vectors.where("vec_id is null"))))
    by_key = rows.where("key is not null").groupBy("key")
    classes = tmp.keep(by_key.agg(F.min("vec_id").alias("vec"), F.count("*").alias("n"), F.min_by("embedding", "vec_id").alias("embedding")))
    links = spark.createDataFrame([], "a long, b long, n long")
    for d, total in classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        same = classes.where(F.size("embedding") == d)
        sample = same.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("embedding").collect()
        x = unit_rows(np.array([r[0] for r in sample], np.float64))
        cells = spherical_kmeans(x, max(1, min(CELLS_MAX, -(-total // CELL_ROWS))), cosine=cosine)
        share = min(1.0, SIGMAS / np.sqrt(effective_dimension(x, cells)))
        placed = tmp.keep(_assign(same, cells, cosine, share))
        units = _units(placed).repartition(parts(spark), "cell", "mb", "qb").sortWithinPartitions("cell", "mb", "qb")
        links = links.unionByName(tmp.keep(units.mapInArrow(_compare(cosine), "a long, b long, n long")))
    found = tmp.keep(components(links.where("b is not null").select("a", "b")))
    counts = links.where("b is null").groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("more"))
    reps = classes.select("key", "vec", "n").join(counts, "vec", "left").join(found.withColumnRenamed("node", "vec"), "vec", "left")
    reps = tmp.keep(reps.select("key", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "vec").alias("component")))
    # Rows meet their class by its digest; classes of many copies are few and are broadcast.
    few = reps.where(F.col("n") > HOT).drop("n")
    hot = F.broadcast(few.select(F.col("key").alias("_key"), F.struct("links", "component").alias("_hot")))
    ids = rows.select("vec_id", "key").join(hot, F.col("key") == F.col("_key"), "left")
    cold = ids.where("_hot is null and key is not null").drop("_hot", "_key").join(reps.where(F.col("n") <= HOT).drop("n"), "key").select("vec_id", "links", "component")
    rest = ids.where("_hot is not null").select("vec_id", "_hot.links", "_hot.component")
    lone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = cold.unionByName(rest).unionByName(lone)
    return tmp.result(
        out.select(
            "vec_id",
            F.col("links").cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.col("component")).alias("component_id"),
            F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
