"""N-gram Jaccard join by a token-group matrix, exact.

Texts with equal shingle sets are one class, represented by the least doc_id.
Representatives are partitioned into groups of similar texts by a min-hash. The
token-group matrix holds each group's union of prefix tokens: under one global
order of tokens, two sets with 100 * intersection >= t * union share at least
1 + e tokens of their prefixes. A query text opens another group only if at
least that many of its prefix tokens are in the group's union and the sizes
allow a link; its own group is always opened. An opened group is compared in
blocks of about BLOCK_ROWS x BLOCK_ROWS sets, so a hot group is spread over many
tasks and never becomes rows of pairs; each block gives a spanning forest of its
links, and the components of all forests are the answer.

The order puts tokens that many texts share last. Which tokens those are is
counted over all texts; the table of them is cut to HEAVY_MAX entries before it
is broadcast. Any order gives the same links.

Defined cases: text that is null, empty or white space has n_shingles 0 and links
with nothing; a null doc_id links with nothing and has a null component_id;
rows that repeat a doc_id are returned each and count as one document in the
components; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealframe.llm._common import Scratch, append_columns, bound_batches, parts, table
from dealframe.llm._graph import components
from dealframe.llm._text import Words, blocks, mix, shingles

SHINGLE = 4
PERCENT = 85
#: Entries of the broadcast table of widely shared tokens at most (8 bytes each).
HEAVY_MAX = 200_000
#: Texts that make a token widely shared, and those within a chunk that make it a candidate.
HEAVY_TEXTS, HEAVY_LOCAL, HEAVY_CHUNK = 32, 5, 2_000_000
EXTRA = 2
#: Rows (a text in a block of comparisons) that may be broadcast, some 40 bytes each; the count is checked.
UNITS_MAX = 1_000_000
BLOCK_ROWS = 512
#: Keys of more rows are joined by broadcast, so that none lands in one task; there are at most rows / HOT of them, each some 40 bytes.
HOT = 2000
SEED = np.uint64(0x5851F42D4C957F2D)


class Sets:
    """Distinct shingle hashes, ascending, of each text of a column."""

    def __init__(self, k: int) -> None:
        self.words, self.k = Words(), k

    def __call__(self, col: pa.Array):
        for _, _, data, offs in blocks(col):
            st, en, first = self.words.spans(data, offs)
            h = self.words.hashes(data, st, en)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield np.unique(shingles(h[a:b], self.k))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(s ^ SEED).sum(dtype=np.uint64).view(np.int64)), int(mix(s + SEED).sum(dtype=np.uint64).view(np.int64))


def _heavy(docs: DataFrame, k: int) -> np.ndarray:
    """Tokens of HEAVY_TEXTS distinct texts or more, the most frequent HEAVY_MAX of them; counted over all texts in chunks."""

    def count(batches):
        sets, held, size, seen = Sets(k), [], 0, set()

        def flush():
            tok, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= HEAVY_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(tok[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        for b in batches:
            for s in sets(b.column(0)):
                if len(s):
                    d = digest(s)
                    if d not in seen:
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                        if size >= HEAVY_CHUNK:
                            yield flush()
                            held, size, seen = [], 0, set()
        if held:
            yield flush()

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= HEAVY_TEXTS).orderBy(F.desc("n"), "token").limit(HEAVY_MAX).select("token")
    return np.sort(top.toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, g, prefix) of every text: set size, set digest, group and prefix tokens."""
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(docs, k))

    def make():
        sets, hot = Sets(k), heavy.value

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            cols: list[list] = [[], [], [], []]
            pre, lens = [], []
            for s in sets(b.column("text")):
                n = len(s)
                if not n:
                    for c in cols:
                        c.append(0)
                    lens.append(0)
                    continue
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    cold = s[~is_hot]
                    order = np.concatenate([cold, s[is_hot]])
                else:
                    cold = order = s
                need = (percent * n + 99) // 100
                e = min(EXTRA, need - 1)
                pre.append(order[: n - need + 1 + e])
                lens.append(len(pre[-1]))
                group = mix((cold if 2 * len(cold) >= n else s) ^ SEED).min()
                for c, v in zip(cols, (n, *digest(s), int(group.view(np.int64))), strict=True):
                    c.append(v)
            flat = np.concatenate(pre).view(np.int64) if pre else np.zeros(0, np.int64)
            offs = np.zeros(len(lens) + 1, np.int32)
            np.cumsum(lens, out=offs[1:])
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] + [pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))]

        return batch

    new = [("n", T.IntegerType()), ("d1", T.LongType()), ("d2", T.LongType()), ("g", T.LongType()), ("prefix", T.ArrayType(T.LongType()))]
    return append_columns(docs.select("doc_id", "text"), ["doc_id"], new, make)


def _pack(shards: int):
    """mapInArrow over (doc_id, g, prefix): tokens, documents and groups dealt to shards, a packed row a shard and batch."""

    def run(batches):
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lens = np.diff(b.column(2).offsets.to_numpy()) if len(b) else []
            doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lens)
            g = np.repeat(b.column(1).to_numpy(zero_copy_only=False), lens)
            to = (mix(flat) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            flat, doc, g, to = flat[order], doc[order], g[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1, append=shards))
            runs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            # Differences of ids compress to little.
            load = [flat[i:j].tobytes() + np.diff(doc[i:j], prepend=0).tobytes() + g[i:j].tobytes() for i, j in runs]
            yield pa.RecordBatch.from_arrays([pa.array([int(to[i]) for i, _ in runs], pa.int32()), pa.array(load, pa.binary())], names=["shard", "load"])

    return run


def _live(batches):
    """mapInArrow over packed rows sorted by shard: (token, doc, g) of the tokens that two groups share."""

    def flush(held):
        tok, doc, g = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(tok, kind="stable")
        tok, doc, g = tok[order], doc[order], g[order]
        at = np.flatnonzero(np.diff(tok, prepend=tok[0] ^ np.uint64(1)))
        live = np.minimum.reduceat(g, at) != np.maximum.reduceat(g, at)
        keep = np.repeat(live, np.diff(at, append=len(tok)))
        return pa.RecordBatch.from_arrays([pa.array(tok[keep].view(np.int64)), pa.array(doc[keep]), pa.array(g[keep])], names=["token", "doc", "g"])

    key, held = None, []
    for b in batches:
        for shard, load in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if shard != key:
                if held:
                    yield flush(held)
                key, held = shard, []
            x = np.frombuffer(load.as_buffer(), np.int64)
            m = len(x) // 3
            held.append((x[:m].view(np.uint64), np.cumsum(x[m : 2 * m]), x[2 * m :]))
    if held:
        yield flush(held)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """An inner join on keys that one row of ``table`` each has; ``weight``: how many rows a key stands for, about.

    Keys of more than HOT rows are broadcast and leave the shuffle.
    """
    data = [c for c in table.columns if c not in keys]
    big = table.where(F.col(weight) > HOT).select(*keys, F.struct(*data).alias("_hot"))
    flagged = rows.join(F.broadcast(big), keys, "left")
    cold = flagged.where("_hot is null").drop("_hot").join(table.where(F.col(weight) <= HOT), keys)
    return cold.unionByName(flagged.where("_hot is not null").select(*rows.columns, "_hot.*").select(cold.columns))


def qualify(seen: DataFrame, reps: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """(doc, g): representatives and the other groups that they must open, by the token-group matrix.

    Tokens of all rows are dealt out once, packed; copies change nothing in which
    tokens two groups share, and leave before the matrix is asked.
    """
    spark = seen.sparkSession
    shards = 4 * parts(spark)
    post = seen.where("doc_id is not null and n > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "g", "prefix")
    post = post.mapInArrow(_pack(shards), "shard int, load binary").repartition(parts(spark), "shard").sortWithinPartitions("shard")
    live = post.mapInArrow(_live, "token long, doc long, g long")
    sizes = reps.groupBy("g").agg(F.count("*").alias("members"))
    extra = F.expr(f"least({EXTRA}, ({percent} * n + 99) div 100 - 1)").cast("int")
    rows = live.join(reps.select(F.col("doc_id").alias("doc"), "g", "n"), ["doc", "g"])
    rows = tmp.keep(spread_join(rows, sizes, ["g"], "members").withColumn("e", extra).distinct())
    matrix = rows.groupBy("token", "g", "members").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("e").alias("ge"))
    q, m = rows.alias("q"), matrix.alias("m")
    hit = q.join(m, "token").where("(q.members, q.g) < (m.members, m.g)")
    hit = hit.where(f"100 * m.hi >= {percent} * q.n and 100 * q.n >= {percent} * m.lo")
    hit = hit.groupBy("q.doc", "m.g").agg(F.count("*").alias("shared"), F.min(F.least("q.e", "m.ge")).alias("least"))
    return hit.where("shared >= 1 + least").select("doc", "g")


def _units(reps: DataFrame, opened: DataFrame) -> DataFrame:
    """(g, mb, qb, side, doc): which texts meet in which block of comparisons.

    side 0 and 1: members of blocks mb <= qb of one group; 2: members, 3: queries of other groups.
    """
    size = reps.groupBy("g").agg(F.count("*").alias("members"))
    asked = opened.groupBy("g").agg(F.count("*").alias("asked"))
    plan = size.join(asked, "g", "left").where("members > 1 or asked > 0")
    plan = plan.select("g", F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("nb"), F.ceil(F.coalesce("asked", F.lit(0)) / BLOCK_ROWS).cast("int").alias("nq"), "members", F.coalesce("asked", F.lit(0)).alias("queries"))
    at = F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int")
    own = spread_join(reps.select("g", F.col("doc_id").alias("doc")), plan, ["g"], "members").withColumn("b", at)
    inner = own.where("members > 1").withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    inner = inner.select("g", F.least("b", "o").alias("mb"), F.greatest("b", "o").alias("qb"), (F.col("b") > F.col("o")).cast("int").alias("side"), "doc")
    member = own.where("nq > 0").select("g", F.col("b").alias("mb"), F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"), F.lit(2).alias("side"), "doc")
    asks = spread_join(opened, plan, ["g"], "queries")
    asks = asks.select("g", F.explode(F.expr("sequence(0, nb - 1)")).alias("mb"), F.pmod(F.xxhash64("doc"), F.col("nq")).cast("int").alias("qb"), F.lit(3).alias("side"), "doc")
    return inner.unionByName(member).unionByName(asks)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of a with all of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    if len(a) * len(b) <= 8:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    ta, tb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ta, tb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ia, ib = np.searchsorted(both, ta), np.searchsorted(both, tb)
    oa = both[np.minimum(ia, len(both) - 1)] == ta if len(both) else np.zeros(len(ta), bool)
    ob = both[np.minimum(ib, len(both) - 1)] == tb if len(both) else np.zeros(len(tb), bool)
    ra, ia, rb, ib = ra[oa], ia[oa], rb[ob], ib[ob]
    step = 4096
    for lo in range(0, len(both), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        ka, kb = (ia >= lo) & (ia < lo + step), (ib >= lo) & (ib < lo + step)
        x[ra[ka], ia[ka] - lo] = 1
        y[rb[kb], ib[kb] - lo] = 1
        out += x @ y.T
    return out


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of n nodes with the given pairs."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _links(k: int, percent: int):
    """mapInArrow over rows sorted by (g, mb, qb): spanning forests of the links of each unit."""

    def unit(held: dict[int, list]) -> tuple[list[int], list[int]]:
        kinds = [(held.get(0, []), held.get(1) or held.get(0, []))] if 0 in held or 1 in held else []
        if held.get(2) and held.get(3):
            kinds.append((held[2], held[3]))
        a, b = [], []
        for x, y in kinds:
            if not x or not y:
                continue
            o = overlaps([s for _, s in x], [s for _, s in y])
            nx, ny = np.array([len(s) for _, s in x]), np.array([len(s) for _, s in y])
            ok = 100 * o >= percent * (nx[:, None] + ny[None] - o)
            i, j = np.nonzero(ok)
            ids = [d for d, _ in x] + [d for d, _ in y]
            for p, q in forest(len(ids), np.stack([i, j + len(x)], 1)):
                if ids[p] != ids[q]:
                    a.append(ids[p])
                    b.append(ids[q])
        return a, b

    def run(batches):
        key, held, sets = None, {}, Sets(k)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            a, b = [], []
            for g, mb, qb, side, doc, tokens in zip(*cols, sets(batch.column(5)), strict=True):
                if (g, mb, qb) != key:
                    if held:
                        x, y = unit(held)
                        a += x
                        b += y
                    key, held = (g, mb, qb), {}
                held.setdefault(side, []).append((doc, tokens))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held:
            a, b = unit(held)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(docs: DataFrame, seen: DataFrame, reps: DataFrame, k: int, percent: int, tmp: Scratch) -> DataFrame:
    """(a, b): links between representatives that span every component."""
    where = tmp.keep(_units(reps, qualify(seen, reps, percent, tmp)))
    texts = docs.withColumnRenamed("doc_id", "doc")
    if where.count() <= UNITS_MAX:
        # Few texts are compared: they go straight to their units. With more rows texts and units meet by a shuffle.
        where = F.broadcast(where)
    rows = texts.join(where, "doc").select("g", "mb", "qb", "side", "doc", "text")
    rows = rows.repartition(parts(docs.sparkSession), "g", "mb", "qb").sortWithinPartitions("g", "mb", "qb")
    return rows.mapInArrow(_links(k, percent), "a long, b long")


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    tmp, docs = Scratch(), docs.select("doc_id", "text")
    seen = tmp.keep(describe(docs, k, percent))
    valid = seen.where("n > 0 and doc_id is not null")
    rep = tmp.keep(valid.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("g").alias("g"), F.count("*").alias("copies")))
    reps = rep.select(F.col("rep").alias("doc_id"), "n", "g")
    many = rep.where("copies > 1").select("d1", "d2", "n", "rep", "copies")
    same = spread_join(valid.select("doc_id", "d1", "d2", "n"), many, ["d1", "d2", "n"], "copies").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = tmp.keep(components(links(docs, seen, reps, k, percent, tmp).unionByName(same)))
    out = seen.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    out = out.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return tmp.result(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
