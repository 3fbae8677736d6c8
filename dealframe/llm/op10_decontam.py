"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

For every distinct item length (in words) a window of that many words slides over
each text. A window's fingerprint is a 128-bit SimHash of its five-word shingles, where
the n-th occurrence of a shingle is a token of its own: the weighted Jaccard
similarity of shingles is the plain one of such tokens, and no repeated shingle
outweighs the rest. The 128 bits are cut into 4 blocks of 32; a
fingerprint within RADIUS of an item differs from it by at most RADIUS // 4 bits in
one block at least, so the blocks find all items within the radius, and let by 0.4 %
of the pairs of a window and an item that have nothing in common. Candidates are
verified by the exact weighted Jaccard similarity of the shingles, max(a, b) and
min(a, b) summed over shingles.

RADIUS is the expected Hamming distance at the threshold plus three standard
deviations: of windows with a similarity of exactly 0.8 about one in 700 lies beyond
it, and next to none above 0.82. A window that shares no shingle with an item of its
length has similarity 0 to all of them; such windows need no fingerprint and get
none, which changes no result (``every`` of Index.search gives them one, and the
tests compare).

Case and ASCII punctuation don't count: words are what stands between these and
white space, in lower case.

Defined cases: null and empty texts and items match nothing; an item of
fewer than five words is one shingle, and texts are read in shingles of its length
for it; a text of fewer is one shingle; a text shorter than an item is one window;
a null id is carried; repeated rows are reported each; ties go to the first
window; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealframe.llm._common import append_columns, bound_batches, table
from dealframe.llm._text import Words, blocks, mix, shingles

SHINGLE = 5
THRESHOLD = 0.8
BITS, CUTS, RADIUS = 128, 4, 31
#: Items, and bytes of their texts, that a task holds at most; a larger benchmark is searched in several passes over the texts.
ITEMS_MAX, ITEMS_BYTES = 50_000, 50_000_000
#: Pairs of windows and items that are looked at at once.
PAIRS_AT_ONCE = 4_000_000
FILTER_BITS = 20


def signs(tokens: np.ndarray) -> np.ndarray:
    """BITS signs (+1 or -1) of each shingle hash."""
    raw = np.stack([mix(tokens), mix(tokens ^ np.uint64(0x1234567))], 1).view(np.uint8).reshape(len(tokens), BITS // 8)
    return 2 * np.unpackbits(raw, axis=1).astype(np.int32) - 1


def numbered(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token of the n-th occurrence (from 1) of a shingle."""
    return np.where(n == 1, tokens, mix(tokens + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def fingerprint(tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BITS bits, packed, of shingle hashes that occur ``weights`` times."""
    w = weights.astype(np.int64)
    n = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + 1
    return np.packbits(signs(numbered(np.repeat(tokens, w), n)).sum(0) > 0)


def fingerprints(s: np.ndarray, width: int) -> np.ndarray:
    """Those of all windows of ``width`` shingles of s."""
    size = len(s)
    of = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(of, kind="stable")
    keys = of[order] * (size + 1) + order
    close = np.diff(keys) < width
    if not close.any():
        run = np.zeros((size + 1, BITS), np.int32)
        np.cumsum(signs(s), axis=0, out=run[1:])
        return np.packbits(run[width:] - run[:-width] > 0, axis=1)
    # A window's first shingle goes as the last of its occurrences there; the next one comes as one more.
    at = np.empty(size, np.int64)
    at[order] = np.arange(size)
    here = np.arange(size)
    behind = at - np.searchsorted(keys, of * (size + 1) + np.maximum(here - width + 1, 0)) + 1
    ahead = np.searchsorted(keys, of * (size + 1) + np.minimum(here + width, size)) - at
    run = np.empty((size - width + 1, BITS), np.int32)
    run[0] = signs(numbered(s[:width], behind[:width])).sum(0)
    run[1:] = signs(numbered(s[width:], behind[width:])) - signs(numbered(s[: size - width], ahead[: size - width]))
    return np.packbits(np.cumsum(run, axis=0) > 0, axis=1)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (shingles ascending, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(i) else 0.0


def bag(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tok, n = np.unique(s, return_counts=True)
    return tok, n.astype(np.float64)


def normal(col: pa.Array) -> pa.Array:
    """Lower case, by Unicode's rules."""
    return pc.utf8_lower(pc.fill_null(col, ""))


def word_reader() -> Words:
    """Words between white space and ASCII punctuation."""
    words = Words()
    words.isword[[c for c in range(33, 127) if not chr(c).isalnum()]] = False
    return words


class Group:
    """The items of one length in words, and the tables of their multi-index search.

    A fingerprint is CUTS blocks of 32 bits. One within RADIUS of an item differs from it
    by RADIUS // CUTS bits at most in one block at least, and in one 16-bit half of that
    block by half as many at most. ``table`` says for each value of each half whether an
    item is that near; windows that it lets by are held against the items block by block,
    then as a whole.
    """

    def __init__(self, items: np.ndarray, prints: np.ndarray) -> None:
        own = np.ascontiguousarray(prints[items])
        self.items, self.blocks, self.wide = items, own.view(np.uint32), own.view(np.uint64)
        around = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= RADIUS // CUTS // 2).astype(np.uint16)
        halves = own.view(np.uint16)
        self.table = np.zeros((2 * CUTS, 1 << 16), bool)
        for c in range(2 * CUTS):
            for v in np.unique(halves[:, c]):
                self.table[c, around ^ v] = True

    def survivors(self, prints: np.ndarray):
        """(windows, items) that agree in a block, as indexes; a bounded number of pairs is looked at at once."""
        halves = prints.view(np.uint16)
        maybe = self.table[0][halves[:, 0]]
        for c in range(1, 2 * CUTS):
            maybe |= self.table[c][halves[:, c]]
        rows = np.flatnonzero(maybe)
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.items)))
        for lo in range(0, len(rows), step):
            r = rows[lo : lo + step]
            b = np.ascontiguousarray(prints[r]).view(np.uint32)
            hit = np.zeros((len(r), len(self.items)), bool)
            for c in range(CUTS):
                hit |= np.bitwise_count(b[:, c, None] ^ self.blocks[None, :, c]) <= RADIUS // CUTS
            w, i = np.nonzero(hit)
            yield r[w], i

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within RADIUS."""
        ws, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, i in self.survivors(prints):
            ok = np.bitwise_count(np.ascontiguousarray(prints[w]).view(np.uint64) ^ self.wide[i]).sum(1, dtype=np.int64) <= RADIUS
            ws.append(w[ok])
            items.append(self.items[i[ok]])
        return np.concatenate(ws), np.concatenate(items)


class Index:
    """The items, their shingles, and a search group for each length."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, threshold: float) -> None:
        self.k, self.threshold = k, threshold
        self.words = word_reader()
        self.ids, self.bags, self.sizes, prints = [], [], [], []
        for _, _, data, offs in blocks(normal(pa.array(texts, pa.large_string()))):
            st, en, first = self.words.spans(data, offs)
            h = self.words.hashes(data, st, en)
            for a, b in zip(first[:-1], first[1:], strict=True):
                self.sizes.append(int(b - a))
                self.bags.append(bag(shingles(h[a:b], k)))
        keep = [i for i, n in enumerate(self.sizes) if n]
        self.ids = [ids[i] for i in keep]
        self.bags = [self.bags[i] for i in keep]
        self.sizes = [self.sizes[i] for i in keep]
        prints = np.array([fingerprint(*b) for b in self.bags], np.uint8).reshape(len(self.bags), BITS // 8)
        lengths = np.asarray(self.sizes, np.int64)
        self.groups = {int(n): Group(np.flatnonzero(lengths == n), prints) for n in np.unique(lengths)}
        tokens = np.unique(np.concatenate([b[0] for b in self.bags])) if self.bags else np.zeros(0, np.uint64)
        self.tokens = tokens
        self.lengths_of: list[set[int]] = [set() for _ in tokens]
        for own, n in zip(self.bags, self.sizes, strict=True):
            for t in np.searchsorted(tokens, own[0]).tolist():
                self.lengths_of[t].add(n)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(tokens & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    @classmethod
    def by_length(cls, ids: list[int], texts: list[str | None], k: int, threshold: float) -> list[Index]:
        """An index of the items of k words or more, and one for each shorter length, shingled by that length."""
        words, kinds = word_reader(), []
        for _, _, data, offs in blocks(normal(pa.array(texts, pa.large_string()))):
            kinds += np.minimum(np.diff(words.spans(data, offs)[2]), k).tolist()
        held = {n: [i for i, x in enumerate(kinds) if x == n] for n in sorted(set(kinds) - {0})}
        return [cls([ids[i] for i in at], [texts[i] for i in at], n, threshold) for n, at in held.items()]

    def anchors(self, s: np.ndarray) -> np.ndarray:
        """Positions of s that hold a shingle of some item."""
        at = np.flatnonzero(self.seen[(s & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if not len(at):
            return at
        i = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
        return at[self.tokens[i] == s[at]]

    def search(self, h: np.ndarray, every: bool = False) -> dict[int, tuple[float, int, int]]:
        """item position -> (similarity, first word, words) of its best window in a text of word hashes h.

        every: fingerprint also the windows that share no shingle with an item of their
        length. Their similarity is 0, so the result is the same.
        """
        s = shingles(h, self.k)
        best: dict[int, tuple[float, int, int]] = {}
        at = self.anchors(s)
        holds: dict[int, list[int]] = {}
        for p, t in zip(at.tolist(), np.searchsorted(self.tokens, s[at]).tolist(), strict=True):
            for n in self.lengths_of[t]:
                holds.setdefault(n, []).append(p)
        for n in sorted(self.groups if every and len(s) else holds):
            words = min(n, len(h))
            width, m = max(1, words - self.k + 1), len(s)
            around = [(0, m - width)] if every else [(max(0, p - width + 1), min(p, m - width)) for p in holds[n]]
            for lo, hi in _ranges(around, 4096):
                w, i = self.groups[n].near(fingerprints(s[lo : hi + width], width))
                bags: dict[int, tuple] = {}
                for a, item in zip((w + lo).tolist(), i.tolist(), strict=True):
                    if a not in bags:
                        bags[a] = bag(s[a : a + width])
                    sim = similarity(bags[a], self.bags[item])
                    if sim >= self.threshold and sim > best.get(item, (0.0, 0, 0))[0]:
                        best[item] = (sim, a, words)
        return best


def _ranges(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ascending spans, ends included, merged where they touch and cut to ``most`` starts."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return [(a, min(a + most - 1, hi)) for lo, hi in out for a in range(lo, hi + 1, most)]


SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])


def _portions(benchmark: DataFrame, items_max: int, items_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items (id, text) in portions that a task can hold; one portion as a rule, and one, empty, of an empty benchmark."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size["n"] // items_max), -(-size["b"] // items_bytes))
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def hits(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, items_max: int = ITEMS_MAX, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of every contaminated pair."""
    schema = T.StructType([docs.schema["doc_id"], *SCHEMA.fields])
    out = None
    for rows in _portions(benchmark, items_max, items_bytes):
        found = _pass(docs, rows, k, threshold, schema)
        out = found if out is None else out.unionByName(found)
    return out


#: The indexes that this worker built last, by what they were built from; tasks of one pass share them.
_BUILT: dict[tuple, list[Index]] = {}


def _indexes(name: str, rows: list[tuple[int, str]], k: int, threshold: float) -> list[Index]:
    key = (name, k, threshold)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index.by_length([r[0] for r in rows], [r[1] for r in rows], k, threshold)
    return _BUILT[key]


def _finder(docs: DataFrame, rows: list[tuple[int, str]], k: int, threshold: float):
    """Makes, once a task, the function from an array of texts to (row, item_id, similarity, first word, words) of their hits."""
    bound_batches(docs.sparkSession)
    name, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        indexes = _indexes(name, held.value, k, threshold)
        words = word_reader()

        def find(texts: pa.Array):
            for i, _, data, offs in blocks(normal(texts)) if indexes else ():
                st, en, first = words.spans(data, offs)
                h = words.hashes(data, st, en)
                for index in indexes:
                    # One look at the whole block: texts without an item's shingle are left at once.
                    maybe = index.anchors(shingles(h, index.k)) if len(h) >= index.k else np.zeros(0, np.int64)
                    short = np.flatnonzero(np.diff(first) < index.k)
                    own = np.searchsorted(first, maybe, "right") - 1
                    for d in np.unique(np.concatenate([own, short])).tolist():
                        for item, (sim, w, n) in sorted(index.search(h[first[d] : first[d + 1]]).items()):
                            yield i + d, index.ids[item], sim, w, n

        return find

    return make


def _pass(docs: DataFrame, rows: list[tuple[int, str]], k: int, threshold: float, schema: T.StructType) -> DataFrame:
    make = _finder(docs, rows, k, threshold)

    def run(batches):
        find = make()
        for b in batches:
            found = list(find(b.column(1)))
            if found:
                at, item, sim, w, n = zip(*found, strict=True)
                ids = b.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(w, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, items_max: int = ITEMS_MAX, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """The rows of docs whose own text holds no benchmark passage; rows are judged where they are, without a shuffle."""
    columns, flag, out = docs.columns, "_contaminated", docs
    while flag in columns:
        flag += "_"

    def marks(rows):
        make = _finder(docs, rows, k, threshold)

        def begin():
            find = make()

            def batch(b: pa.RecordBatch) -> list[pa.Array]:
                bad = np.zeros(b.num_rows, bool)
                bad[sorted({hit[0] for hit in find(b.column("text"))})] = True
                return [pa.array(bad)]

            return batch

        return begin

    for rows in _portions(benchmark, items_max, items_bytes):
        out = append_columns(out, columns, [(flag, T.BooleanType())], marks(rows)).where(~F.col(flag)).select(*columns)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
