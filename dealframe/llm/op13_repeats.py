"""Repeated passages: a suffix array of sampled positions, by bucket-pointer refinement.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.
Equal texts are one class: all of a repeated text of at least LENGTH bytes repeats, and
one text of each class goes on.

*Pointers.* Each window of LENGTH bytes has one pointer: of its first WINDOW positions
the one whose q-gram (Q bytes) has the least identifier, the leftmost of equals. Equal
windows have their pointer at the same offset, so it suffices to compare windows that
have the same offset to pointers in one bucket; a pointer owns the run of windows
that it serves. Bucket identifiers of q-grams come by doubling: that of 2h bytes at i
is the mix of those of h bytes at i and at the later offset i + h.

*Refinement.* A pointer's bucket is its q-gram; buckets with one pointer are done, as
nothing of theirs repeats. The rest is sorted by the identifiers at later offsets: a
block of windows is one row with two identifiers, each folded from the q-gram
identifiers at every Q-th offset (and the last): of its core, the bytes that all its
windows share, and of its hull, the bytes that any of them has. A row alone in its core's bucket
is done: none of its windows repeats. Rows with an equal hull repeat in all their
windows. The others are refined: their windows are cut into smaller blocks, whose
cores are longer, until a block is one window, where core and hull are the same.
First blocks are whole runs, which settles the inside of copies at once; what is
refined further are the ends of passages, and one row of each settled class in a
bucket that has unsettled rows, so that later rows meet it. Identifiers are folded
twice, to 128 bits, from 64-bit ones of q-grams.

A bucket may hold a third of all rows: it is counted by partial aggregation and met by
equality joins on (bucket, hull) or on one-row-a-bucket counts, never collected. Texts go
through numpy in blocks; a text longer than a block is read in pieces whose runs are
merged.

Defined cases: a null text is empty; texts shorter than LENGTH keep all; null and
repeated doc_ids stay, a row each, and rows that repeat count as places elsewhere;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealframe.llm._common import Scratch, bound_batches, table
from dealframe.llm._text import U64, blocks, mix

LENGTH = 400
#: Bytes of a q-gram (a power of two), positions of which a window takes its pointer, sizes of blocks of windows.
Q, WINDOW, SIZES = 32, 256, (64, 8, 1)
#: Window starts that are worked on at once.
PIECE = 1 << 19
_LOW = (1 << 20) - 1
_SALTS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Identifier of the q bytes at each position, by doubling from single bytes."""
    h = data.astype(np.uint64)
    step = 1
    while step < q:
        if len(h) <= step:
            return h[:0]
        if step < 8:
            h = h[:-step] | (h[step:] << U64(8 * step))
        else:
            h = mix(h[:-step] * U64(_SALTS[0]) + h[step:])
        step *= 2
    return h if q > 8 else mix(h)


def pointers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each run of ``window`` identifiers, the position of the least, the leftmost of equals. At most 2^20 of h."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (h & U64(~_LOW & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % window
    k = np.concatenate([key, np.full(pad, U64(2**64 - 1))]).reshape(-1, window)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    back = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[window - 1 : window - 1 + n]) & U64(_LOW)).astype(np.int64)


def runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, q: int = Q, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pointers of whole texts in data (offs: their bounds): (pointer, first, last window, q-gram identifier), positions in data."""
    out: list[tuple[np.ndarray, ...]] = []
    total = int(offs[-1])
    for at in range(0, max(total - length + 1, 0), PIECE):
        end = min(total, at + PIECE + length - 1)
        h = qgrams(data[at:end], q)
        p = pointers(h, window)[: min(PIECE, end - at - length + 1)]
        i = np.arange(len(p)) + at
        # Windows within one text only.
        ok = offs[np.searchsorted(offs, i, "right").clip(max=len(offs) - 1)] - i >= length
        p, i = p[ok], i[ok]
        if not len(p):
            continue
        cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(i) != 1)) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(p)] - 1
        out.append((p[first] + at, i[first], i[last], h[p[first]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    p, a, b, g = (np.concatenate(c) for c in zip(*out, strict=True))
    # A run that was cut where pieces meet.
    new = np.r_[True, (np.diff(p) != 0) | (a[1:] != b[:-1] + 1)]
    at = np.flatnonzero(new)
    return p[at], a[at], b[np.r_[at[1:], len(p)] - 1], g[at]


def folds(h: np.ndarray, start: np.ndarray, size: np.ndarray, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of each string [start, start + size), size >= q, from q-gram identifiers at every q-th offset and the last."""
    a, b = size.astype(np.uint64), size.astype(np.uint64) + U64(1)
    for off in range(0, int(size.max(initial=0)), q):
        live = off < size
        g = h[start + np.minimum(off, size - q)]
        a = np.where(live, mix((a ^ g) * U64(_SALTS[0])), a)
        b = np.where(live, mix((b + g) * U64(_SALTS[1])), b)
    return a.view(np.int64), b.view(np.int64)


class Sizes:
    """What is removed, and how it is looked for."""

    def __init__(self, length: int = LENGTH, q: int = Q, window: int = WINDOW, blocks: tuple[int, ...] = SIZES) -> None:
        if q & (q - 1) or window + q - 1 > length or length - blocks[0] < q or blocks[-1] != 1:
            raise ValueError("a window must hold its q-grams, a core one q-gram, and the last blocks one window")
        self.length, self.q, self.window, self.blocks = length, q, window, blocks


_ROW = "tid long, p int, blk int, lo int, hi int, c1 long, c2 long, h1 long, h2 long, need boolean"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _batch(*cols) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 4, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)


def _whole_runs(texts: DataFrame, size: Sizes) -> DataFrame:
    """A row for each pointer of texts (tid, text): its run of windows as offsets lo to hi before it."""

    def run(batches):
        for b in batches:
            tid = b.column(0).to_numpy()
            for i, j, data, offs in blocks(b.column(1), PIECE):
                p, first, last, g = runs(data, offs, size.length, size.q, size.window)
                if not len(p):
                    continue
                row = np.searchsorted(offs, first, "right") - 1
                h1, h2 = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
                # Identifiers of a piece at a time: runs are in order.
                for at in range(0, len(p), 1 << 14):
                    s = slice(at, at + (1 << 14))
                    lo = int(first[s][0])
                    h = qgrams(data[lo : int(last[s].max()) + size.length], size.q)
                    h1[s], h2[s] = folds(h, first[s] - lo, last[s] - first[s] + size.length, size.q)
                none = np.zeros(len(p), np.int64)
                yield _batch(tid[i:j][row], p - offs[row], none - 1, p - last, p - first, g.view(np.int64), none, h1, h2, np.ones(len(p), bool))

    return texts.select("tid", "text").mapInArrow(run, _ROW)


def _contexts(rows: DataFrame, texts: DataFrame, size: Sizes) -> DataFrame:
    """(tid, p, at, ctx): the bytes that any window of pointer p can have, p being the at-th of them."""
    wanted = rows.groupBy("tid").agg(F.collect_set("p").alias("ps"))

    def run(batches):
        for b in batches:
            for tid, ps, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                for i in range(0, len(ps), 4096):
                    some = ps[i : i + 4096]
                    first = [max(0, p - size.window + 1) for p in some]
                    ctx = [raw[f : p + size.length] for f, p in zip(first, some, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tid] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([p - f for p, f in zip(some, first, strict=True)], pa.int32()), pa.array(ctx, pa.binary())],
                        names=["tid", "p", "at", "ctx"],
                    )

    return wanted.join(texts.select("tid", "text"), "tid").mapInArrow(run, "tid long, p int, at int, ctx binary")


def _smaller(rows: DataFrame, contexts: DataFrame, block: int, size: Sizes) -> DataFrame:
    """Rows cut into blocks of ``block`` windows, with identifiers of their cores and hulls."""

    def run(batches):
        for b in batches:
            tid, p, lo, hi, need, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            ctx = b.column(6)
            ends = np.cumsum([len(x) for x in ctx.to_pylist()])
            data = np.frombuffer(b"".join(ctx.to_pylist()), np.uint8)
            mid = np.r_[0, ends[:-1]] + at
            n = hi // block - lo // block + 1
            row = np.repeat(np.arange(len(n)), n)
            k = lo[row] // block + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            d0, d1 = k * block, np.minimum(k * block + block, size.window) - 1
            a, z = np.maximum(lo[row], d0), np.minimum(hi[row], d1)
            h, at = qgrams(data, size.q), mid[row].astype(np.int64)
            c1, c2 = folds(h, at - d0, (size.length - d1 + d0).astype(np.int64), size.q)
            h1, h2 = folds(h, at - z, (size.length + z - a).astype(np.int64), size.q)
            yield _batch(tid[row], p[row], k, a, z, c1, c2, h1, h2, need[row])

    bound_batches(rows.sparkSession)
    joined = rows.select("tid", "p", "lo", "hi", "need").join(contexts, ["tid", "p"])
    return joined.select("tid", "p", "lo", "hi", "need", "at", "ctx").mapInArrow(run, _ROW)


_CORE, _HULL = ["c1", "c2", "blk"], ["lo", "hi", "h1", "h2"]


def _refined(rows: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(settled, open): windows first to last that repeat, and the rows to be cut further."""
    classes = tmp.keep(rows.groupBy(*_CORE, *_HULL).agg(F.count("*").alias("n"), F.max("need").alias("need"), F.min(F.struct("tid", "p")).alias("one")))
    many = classes.where("n > 1 and need").select(*_CORE, *_HULL)
    settled = rows.where("need").join(many, _CORE + _HULL).select("tid", (F.col("p") - F.col("hi")).alias("first"), (F.col("p") - F.col("lo")).alias("last"))
    left = F.col("need") & (F.col("n") == 1)
    buckets = tmp.keep(classes.groupBy(*_CORE).agg(F.sum("n").alias("rows"), F.max(left).alias("left")).where("rows > 1 and left").select(*_CORE))
    down = classes.join(buckets, _CORE).select("one.tid", "one.p", "lo", "hi", left.alias("need"))
    return settled, down


def repeated(texts: DataFrame, tmp: Scratch, size: Sizes) -> DataFrame:
    """(tid, first, last): runs of windows of distinct texts (tid, text) whose bytes also start elsewhere."""
    spark = texts.sparkSession
    rows = tmp.keep(_whole_runs(texts, size))
    # Counts are written first: a join of two plain exchanges is what Spark can split at a hot bucket.
    buckets = tmp.keep(rows.groupBy("c1").count().where("count > 1").select("c1"))
    rows = tmp.keep(rows.join(buckets, "c1").select(*_NAMES))
    settled, down = _refined(rows, tmp)
    found, down = [tmp.keep(settled)], tmp.keep(down)
    contexts = tmp.keep(_contexts(down, texts, size), compression="zstd")
    tmp.settle(spark)
    for block in size.blocks:
        rows = tmp.keep(_smaller(down, contexts, block, size))
        settled, down = _refined(rows, tmp)
        found.append(tmp.keep(settled))
        if block > 1:
            down = tmp.keep(down)
    tmp.settle(spark)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _cut(texts: DataFrame, size: Sizes) -> DataFrame:
    """texts (k1, k2, text, windows): what is removed of each and the digest of what is left."""

    def run(batches):
        for b in batches:
            k1, k2, text, windows = (b.column(i) for i in range(4))
            removed, spans, digest = [], [], []
            for t, w in zip(text, windows, strict=True):
                raw, w = t.as_py().encode(), w.values
                first, last = np.sort(w.field(0).to_numpy()), np.sort(w.field(1).to_numpy()) + size.length
                # Runs of a text with a pointer each are in order by either end.
                new = np.r_[True, first[1:] > np.maximum.accumulate(last)[:-1]]
                at = np.flatnonzero(new)
                begin, end = first[at], last[np.r_[at[1:], len(first)] - 1]
                removed.append(int((end - begin).sum()))
                spans.append(len(at))
                kept = hashlib.sha256()
                for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True):
                    kept.update(raw[i:j])
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([k1, k2, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names=["k1", "k2", "n_removed", "n_spans", "kept"])

    bound_batches(texts.sparkSession)
    return texts.mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept string")


def without_repeats(docs: DataFrame, size: Sizes | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text)."""
    spark, tmp, size = docs.sparkSession, Scratch(), size or Sizes()
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(13), text).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes"))
    long = docs.where(F.col("n_bytes") >= size.length).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    # Ids are settled by being written.
    texts = tmp.keep(long.select(F.monotonically_increasing_id().alias("tid"), "*"), compression="zstd")
    tmp.settle(spark)
    found = repeated(texts, tmp, size)
    of = found.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    cut = _cut(texts.where("n = 1").join(of, "tid").select("k1", "k2", "text", "windows"), size)
    whole = texts.where("n > 1").select("k1", "k2", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept"))
    cut = tmp.keep(cut.unionByName(whole))
    tmp.settle(spark)
    out = docs.select("doc_id", "n_bytes", "k1", "k2", F.sha2("text", 256).alias("sha")).join(cut, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return tmp.result(
        out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: Every string of LENGTH bytes by its digest, over pieces of hexadecimal texts; islands of those that come twice.
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
z as (select r, b, substr(h, 2 * b + 1, 2 * (512 + {LENGTH - 1})) as h from (select r, h, unnest(range(0, greatest(len(h) // 2 - {LENGTH - 1}, 0), 512)) as b from d)),
w as (select r, b + i as i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) as k from (select r, b, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) as i from z)),
m as (select k from w group by k having count(*) > 1),
c as (select r, i, i - lag(i) over (partition by r order by i) as gap from w semi join m using (k)),
g as (select r, i, sum(case when gap <= {LENGTH} then 0 else 1 end) over (partition by r order by i) as g from c),
s as (select r, g, min(i) as b, max(i) + {LENGTH} as e from g group by r, g),
k as (select r, e as f, lead(b) over (partition by r order by b) as t, b, e from s),
p as (select k.r, sum(e - b) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, len(h) // 2) - f)), '' order by b) as kept, 2 * min(b) as lead from k join d using (r) group by k.r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when p.r is null then h else substr(h, 1, p.lead) || p.kept end)) as kept_sha256 from d left join p using (r)
"""
