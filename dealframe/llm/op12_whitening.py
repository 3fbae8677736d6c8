"""Embedding whitening: matrix-free block Lanczos with full reorthogonalisation.

An entry c becomes the integer x = floor(1024 c) + 100000. One Spark pass counts the
vectors and sums each dimension exactly; with r the rounded mean, x - S/n is
(x - r) - (S - n r)/n, whose first part is exact, so centring costs no digits
whatever the offset. The covariance is never formed: each round of the iteration is
one Spark pass that returns its product with a block of at most BLOCK vectors (rows
by dimension are summed by Spark; the driver holds dimension x basis numbers and
nothing that grows with the rows). The basis is orthogonalised twice against all of
itself. A direction that breaks down is replaced by a random one orthogonal to the
basis; a basis of BASIS vectors is cut down to its best Ritz vectors. Rounds go on
until the residuals of all wanted pairs are TOLERANCE of the largest eigenvalue, the
basis is complete, or rounding lets no residual fall further.

Defined cases: a vector that is null, holds null or non-finite entries, or entries
whose x is beyond 2^53, is dropped; vectors of other lengths than the commonest (the
longer one of two as common) are dropped; null and repeated vec_ids stay, a row each;
a component without variance (below 1e-12 of the largest) has a null whitened value;
where there is no variance at all, explained is null; a deviation that doesn't fit a
long is null; an empty table, or one of empty vectors, gives no rows; other columns
are ignored. Equal eigenvalues may turn their vectors within their plane.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealframe.llm._common import Scratch, table

COMPONENTS = 8
#: Vectors of a block; of the basis before it is cut down; residual, as a share of the largest eigenvalue.
BLOCK, BASIS, TOLERANCE = COMPONENTS + 4, 256, 1e-14
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the integer entries of vectors that can be used."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + F.lit(100_000).cast("double"))
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * 1024) < 2.0**52))
    good = vectors.where(ok).where(F.size("embedding") > 0).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("x"))
    return good


def _rows(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class Centred:
    """n vectors with sums ``total``: rows less their mean, and their exact deviations."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n = n
        self.near = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
        self.rest = np.array([s - n * int(r) for s, r in zip(total, self.near, strict=True)], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2."""
        y = x - self.near
        if self.n * (float(np.abs(y).max(initial=0)) + 1) * np.sqrt(x.shape[1]) < 2.0**31:
            d = self.n * y - self.rest
            return (d * d).sum(1).tolist()
        d = y.astype(object) * self.n - self.rest.astype(object)
        return [int(s) if s < 2**63 else None for s in (d * d).sum(1)]


def product(x: DataFrame, centre: Centred) -> Callable[[np.ndarray], np.ndarray]:
    """block of vectors -> covariance times block, by one pass over x."""

    def times(v: np.ndarray) -> np.ndarray:
        wide = v.shape[1]

        def run(batches):
            out = np.zeros(v.shape)
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    z = centre.rows(_rows(b.column(0).slice(at, 4096)))
                    out += z.T @ (z @ v)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *(pa.array(c) for c in out.T)], names=["i", *(f"v{j}" for j in range(wide))])

        found = x.select("x").mapInArrow(run, "i int, " + ", ".join(f"v{j} double" for j in range(wide)))
        out = np.zeros(v.shape)
        for r in found.groupBy("i").agg(*(F.sum(f"v{j}") for j in range(wide))).collect():
            out[r[0]] = r[1:]
        return out / centre.n

    return times


def _fresh(q: np.ndarray, p: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block orthogonal to q: the directions of p, random ones in place of those that broke down."""
    d, m = q.shape
    want = min(p.shape[1], d - m)
    for _ in range(2):
        p = p - q @ (q.T @ p)
    u, s, _ = np.linalg.svd(p, full_matrices=False)
    u = u[:, s > 1e-14 * scale][:, :want]
    for _ in range(8):
        u = np.concatenate([u, rng.normal(size=(d, want - u.shape[1]))], 1)
        for _ in range(2):
            u = u - q @ (q.T @ u)
            u, r = np.linalg.qr(u)
        whole = np.abs(np.diag(r)) > 0.5
        if whole.all():
            break
        u = u[:, whole]
    return u


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, basis: int = BASIS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a symmetric operator on d dimensions, falling, their unit vectors, and the largest residual."""
    rng, k = np.random.default_rng(12), min(k, d)
    q = w = np.zeros((d, 0))
    p, scale, best, stuck = rng.normal(size=(d, min(block, d))), 1.0, np.inf, 0
    while True:
        p = _fresh(q, p, scale, rng)
        a = times(p)
        q, w = np.concatenate([q, p], 1), np.concatenate([w, a], 1)
        t = q.T @ w
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        y, ay = q @ s[:, :k], w @ s[:, :k]
        scale = max(abs(e[0]), np.finfo(float).tiny)
        worst = np.linalg.norm(ay - y * e[:k], axis=0).max() if len(e) >= k else np.inf
        stuck = 0 if worst < 0.5 * best else stuck + 1
        best = min(best, worst)
        if q.shape[1] >= d or worst <= tolerance * scale or (stuck > 4 and worst < 1e-12 * scale) or stuck > 60:
            break
        p = a
        if q.shape[1] + block > max(basis, 4 * block):
            q, w = q @ s[:, : k + block], w @ s[:, : k + block]
            # The block that goes on is what the kept vectors lack: their residuals.
            p = (w - q * e[: k + block])[:, :block]
    y = y / np.linalg.norm(y, axis=0)
    y = y * np.where(y[np.abs(y).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return np.maximum(e[:k], 0.0), y, float(worst)


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of vectors (vec_id, embedding) and component; the columns of SCHEMA."""
    spark, tmp = vectors.sparkSession, Scratch()
    good = grid(vectors)
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], SCHEMA)
    d, n = common[0]
    x = tmp.keep(good.where(F.size("x") == d))
    sums = x.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect()
    centre = Centred(n, [int(r["s"]) for r in sorted(sums)])
    e, v, _ = lanczos(product(x, centre), d, k)
    live = e > 1e-12 * e[0] if e[0] > 0 else np.zeros(len(e), bool)
    turn = v[:, live] / np.sqrt(e[live])

    def squares(batches):
        total, gram = 0.0, np.zeros((int(live.sum()),) * 2)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                z = centre.rows(_rows(b.column(0).slice(at, 4096)))
                total += float((z * z).sum())
                u = z @ turn
                gram += u.T @ u
        g = gram.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(g)), pa.int32()), pa.array([total, *g], pa.float64())], names=["i", "s"])

    found = {r["i"]: r["s"] / n for r in x.select("x").mapInArrow(squares, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    trace, m = found[-1], int(live.sum())
    error = float(np.abs(np.array([found[i] for i in range(m * m)]).reshape(m, m) - np.eye(m)).max()) if m else None
    share = [float(a / trace) if trace > 0 else None for a in e]

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                xs = _rows(part.column(1))
                w = np.full((len(xs), len(e)), np.nan)
                w[:, live] = centre.rows(xs) @ turn
                again = np.repeat(np.arange(len(xs)), len(e))
                values = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(again)),
                        pa.array(np.tile(np.arange(1, len(e) + 1), len(xs)), pa.int32()),
                        pa.array(np.full(len(again), n), pa.int64()),
                        pa.array(centre.deviations(xs), pa.int64()).take(pa.array(again)),
                        values,
                        pa.array(share * len(xs), pa.float64()),
                        pa.array([error] * len(again), pa.float64()),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return tmp.result(x.mapInArrow(rows, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
