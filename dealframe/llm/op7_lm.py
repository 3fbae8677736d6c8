"""LM scoring by a weighted backoff automaton over smoothed word n-grams.

Counts of all n-grams of the training fold are gathered from the whole corpus by a
sharded count service: each block of texts sends its distinct n-grams once, packed
and pre-summed, to the shard of their hash; the shard adds up the blocks and sends
every block what the others have of what it asked for. So no n-gram is sent more
than once a block, no shard holds a key of another, and nothing but two totals
(tokens, distinct tokens) comes to the driver. Blocks are written once, under ids of
their own, and every later step reads those. Orders above 2 are asked one by one: an
n-gram whose first or last n - 1 tokens no other block has can't be in another block
either, and isn't asked for.

A block then builds its part of the automaton: a state for every context that the
training fold has, the root, an arc for every n-gram that it has, with probability
(c(hw) + K p(w | h')) / (c(h) + K), and from every state a failure arc to the next
shorter context h' with weight K / (c(h) + K) (Dirichlet smoothing, a proper
distribution). The root's arcs are the add-one unigrams (c(w) + 1) / (N + V + 1), with
one for all unknown tokens. One traversal from left to right carries each text's state:
it takes the arc of the next token, or failure arcs until there is one, and adds up
log10 weights. Texts of a block advance together while there are many; the last few
(the longest) one by one.

Defined cases: null and empty texts are the end token alone; a text is as many
tokens as words plus one; rows with a null doc_id are in the training fold; repeated
rows train and are scored each; an empty training fold gives N = V = 0; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealframe.llm._common import Scratch, bound_batches, parts, remainder, table
from dealframe.llm._text import Words, blocks, mix, raw

#: Longest n-gram.
ORDER = 3
#: Pseudo-count of the shorter context.
K = 4.0
#: Bytes of text of a block (or one longer text).
BLOCK_BYTES = 4_000_000
#: Texts that still advance together; fewer are walked one by one.
TOGETHER = 24
END = np.uint64(0x5E5E5E5E5E5E5E5E)
BEGIN = np.uint64(0xB0B0B0B0B0B0B0B0)
BEGIN_KEY = mix(np.array([BEGIN]))[0]


def tokens(words: Words, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, an END after each, and the first token of each text (one more at the end)."""
    st, en, first = words.spans(data, offs)
    h = words.hashes(data, st, en)
    n = len(offs) - 1
    out = np.full(len(h) + n, END)
    keep = np.ones(len(out), bool)
    starts = first + np.arange(n + 1)
    keep[starts[1:] - 1] = False
    out[keep] = h
    return out, starts


def grams(tok: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each token; texts begin with BEGIN, n-grams that reach further back are 0."""
    if n == 1:
        return mix(tok)
    pos = np.arange(len(tok)) - np.repeat(starts[:-1], np.diff(starts))
    h = np.zeros(len(tok), np.uint64)
    for k in range(n - 1, -1, -1):
        t = np.full(len(tok), BEGIN)
        t[k:] = tok[: len(tok) - k]
        t[pos < k] = BEGIN
        h = mix((h ^ t) * np.uint64(0x9FB21C651E98DF25) + np.uint64(n))
    h[pos < n - 2] = 0
    return h


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0, as few bytes each as the largest needs, lowest bytes of all first (these compress)."""
    x = np.ascontiguousarray(x, np.uint64)
    wide = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([wide]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unplanes(buf: np.ndarray, at: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers of ``planes`` at a place of a byte array, and the place after them."""
    wide, at = int(buf[at]), at + 1
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = buf[at : at + wide * n].reshape(wide, n).T
    return out.reshape(-1).view(np.uint64), at + wide * n


def squeeze(load: bytes) -> bytes:
    """zstd behind the length."""
    return len(load).to_bytes(8, "little") + pa.compress(load, codec="zstd", asbytes=True)


def unsqueeze(load: pa.Scalar) -> np.ndarray:
    buf = load.as_buffer()
    return np.frombuffer(pa.decompress(buf[8:], int.from_bytes(buf[:8].to_pybytes(), "little"), codec="zstd"), np.uint8)


class Keys:
    """Distinct keys of a block in the order in which shards are asked: by shard, then ascending."""

    def __init__(self, keys: np.ndarray, shards: int) -> None:
        self.shards = np.uint64(shards)
        to = keys % self.shards
        self.order = np.lexsort((keys, to)).astype(np.int32)
        self.cuts = np.searchsorted(to[self.order], np.arange(shards + 1, dtype=np.uint64))
        self.asked = keys[self.order]

    def of(self, shard: int) -> bytes:
        """The shard's keys: differences of the quotients by the number of shards."""
        q = self.asked[self.cuts[shard] : self.cuts[shard + 1]] // self.shards
        return planes(np.diff(q, prepend=np.uint64(0)))

    def size(self, shard: int) -> int:
        return int(self.cuts[shard + 1] - self.cuts[shard])


class Block:
    """The tokens of a block of texts, their distinct n-grams by order, and the training counts of these within the block."""

    def __init__(self, words: Words, rows: pa.RecordBatch, order: int) -> None:
        data, offs = raw(rows.column("text"))
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        self.train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
        self.tok, self.starts = tokens(words, data, offs)
        used = np.repeat(self.train, np.diff(self.starts))
        self.keys, self.first, self.at, self.own = [], [], [], []
        for n in range(1, order + 1):
            k, first, at = np.unique(grams(self.tok, self.starts, n), return_index=True, return_inverse=True)
            self.keys.append(k)
            self.first.append(first.astype(np.int32))
            self.at.append(at.astype(np.int32))
            self.own.append(np.bincount(at, weights=used, minlength=len(k)).astype(np.int32))
        self.more: list[np.ndarray] = []  # training counts of each n-gram in other blocks
        self.shared: list[np.ndarray] = []  # whether another block holds it, to train or not
        self.texts = 0  # training texts of all blocks

    def sections(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, own counts) of orders 1 and 2; the second ends with the key of a text's beginning."""
        two = [self.keys[1], self.own[1]] if len(self.keys) > 1 else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return [(self.keys[0], self.own[0]), (np.append(two[0], BEGIN_KEY), np.append(two[1], self.train.sum()))]

    def told(self, got: list[np.ndarray]) -> None:
        """The answers to ``sections``."""
        for x in [got[0], got[1][:-1]][: len(self.keys)]:
            self.learn(x)
        self.texts = int(self.train.sum() + (got[1][-1] >> 1))

    def learn(self, answer: np.ndarray) -> None:
        """The answers about the n-grams of the next order: training counts elsewhere, doubled, plus one where another block holds it."""
        self.more.append(answer >> 1)
        self.shared.append((answer & 1).astype(bool))

    def prefix(self, n: int) -> np.ndarray:
        """For each distinct n-gram, the index of its first n - 1 tokens; -1: the text's beginning; -2: none."""
        at = self.first[n - 1]
        starts = np.zeros(len(self.tok) + 1, bool)
        starts[self.starts[:-1]] = True
        back = np.where(starts[at], -1 if n == 2 else -2, self.at[n - 2][at - 1])
        return back

    def asks(self, n: int) -> np.ndarray:
        """Indexes of the n-grams that another block may hold: one that does asks for it too, so that each hears of the other."""
        p = self.prefix(n)
        before = np.where(p >= 0, self.shared[n - 2][np.maximum(p, 0)], p == -1)
        return np.flatnonzero(before & self.shared[n - 2][self.at[n - 2][self.first[n - 1]]])


def _read(load) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(pa.py_buffer(unsqueeze(load)))))


def _texts(block_bytes: int):
    """mapInArrow: runs of whole texts as blocks: an id and the rows themselves, packed."""

    def pack(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())], names=["block", "load"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for i, j, data, _ in blocks(b.column("text"), block_bytes):
                if held and size + len(data) > block_bytes:
                    yield pack(held)
                    held, size = [], 0
                held.append(b.slice(i, j - i))
                size += len(data)
        if held:
            yield pack(held)

    return run


SCHEMA = "block string, shard int, load binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["block", "shard", "load"])


def _chunks(rows, most: int = 32):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _rows(held)
            held = []
    if held:
        yield _rows(held)


def _loads(name: str, sections: list[tuple[np.ndarray, np.ndarray]], shards: int):
    """What a block asks and tells each shard: sizes, keys and counts of each section."""
    asked = [(Keys(k, shards), c) for k, c in sections]
    counts = [c[k.order] for k, c in asked]
    for s in range(shards):
        sizes = [k.size(s) for k, _ in asked]
        if any(sizes):
            load = np.array([len(sizes), *sizes], np.int64).tobytes()
            yield name, s, squeeze(load + b"".join(k.of(s) + planes(c[k.cuts[s] : k.cuts[s + 1]]) for (k, _), c in zip(asked, counts, strict=True)))


def _gather(sections: list[np.ndarray], answers: dict[int, list[np.ndarray]], shards: int) -> list[np.ndarray]:
    """The answers to ``_loads`` of these keys, in the keys' order."""
    out = []
    for i, keys in enumerate(sections):
        k = Keys(keys, shards)
        got = np.zeros(len(keys), np.int64)
        for s in range(shards):
            if k.size(s):
                got[k.order[k.cuts[s] : k.cuts[s + 1]]] = answers[s][i]
        out.append(got)
    return out


def _ask(order: int, shards: int):
    """mapInArrow over blocks: their n-grams of order 1 and 2 for each shard."""

    def run(batches):
        words = Words()
        for b in batches:
            for name, load in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _chunks(_loads(name, Block(words, _read(load), min(order, 2)).sections(), shards))

    return run


def _answer(shards: int):
    """mapInArrow over requests sorted by shard: twice what other blocks have of each n-gram asked, plus one where any asked too, in its order; block '': the shard's tokens and distinct tokens."""

    def read(shard, load):
        buf = unsqueeze(load)
        n = int(buf[:8].view(np.int64)[0])
        sizes, at, out = buf[8 : 8 + 8 * n].view(np.int64).tolist(), 8 + 8 * n, []
        for m in sizes:
            q, at = unplanes(buf, at, m)
            c, at = unplanes(buf, at, m)
            out.append((np.cumsum(q) * np.uint64(shards) + np.uint64(shard), c.astype(np.int64)))
        return out

    def flush(shard, held):
        answers = []
        seen = distinct = 0
        for part in range(len(held[0][1])):
            keys, counts = (np.concatenate([h[1][part][i] for h in held]) for i in (0, 1))
            every, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(every)).astype(np.int64)
            if part == 0:
                seen, distinct = int(total.sum()), int((total > 0).sum())
            others = np.bincount(inverse, minlength=len(every))[inverse] > 1
            answers.append(np.split(2 * (total[inverse] - counts) + others, np.cumsum([len(h[1][part][0]) for h in held])[:-1]))
        for k, (name, asked) in enumerate(held):
            load = np.array([len(asked), *[len(x) for x, _ in asked]], np.int64).tobytes()
            yield name, shard, squeeze(load + b"".join(planes(a[k]) for a in answers))
        yield "", shard, np.array([seen, distinct], np.int64).tobytes()

    def run(batches):
        key, held = None, []
        for b in batches:
            for name, shard, load in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if shard != key:
                    if held:
                        yield from _chunks(flush(key, held))
                    key, held = shard, []
                held.append((name, read(shard, load)))
        if held:
            yield from _chunks(flush(key, held))

    return run


def _answers_of(load) -> list[np.ndarray]:
    buf = unsqueeze(load)
    n = int(buf[:8].view(np.int64)[0])
    sizes, at, out = buf[8 : 8 + 8 * n].view(np.int64).tolist(), 8 + 8 * n, []
    for m in sizes:
        x, at = unplanes(buf, at, m)
        out.append(x.astype(np.int64))
    return out


def _by_block(order: int, rounds: int, shards: int, then):
    """mapInArrow over blocks and answers sorted by (block, kind, shard): ``then(name, block, rows)`` with all answers read.

    kind: 0 the rows, else the round of the answers. Round 1 is of orders 1 and 2, rounds 2, 3, ... of orders 3, 4, ...
    """

    def done(words, name, rows, answers):
        b = Block(words, rows, order)
        b.told(_gather([k for k, _ in b.sections()], answers.get(1, {}), shards))
        for n in range(3, rounds + 2):
            at, more = b.asks(n), np.zeros(len(b.keys[n - 1]), np.int64)
            more[at] = _gather([b.keys[n - 1][at]], answers.get(n - 1, {}), shards)[0]
            b.learn(more)
        return then(name, b, rows)

    def run(batches):
        words, key, rows, answers = Words(), None, None, {}
        for b in batches:
            for name, kind, shard, load in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if name != key:
                    if rows is not None:
                        yield from done(words, key, rows, answers)
                    key, rows, answers = name, None, {}
                if kind == 0:
                    rows = _read(load)
                else:
                    answers.setdefault(kind, {})[shard] = _answers_of(load)
        if rows is not None:
            yield from done(words, key, rows, answers)

    return run


class Automaton:
    """A block's part of the weighted backoff automaton.

    States are numbered: 0 the root, 1 a text's beginning, then the contexts of order 1, 2, ...
    that the training fold has. ``weight[n]`` and ``target[n]`` are the arcs, by distinct n-gram
    of the block: from the state of its first n - 1 tokens over its last; nan where there is none.
    """

    def __init__(self, b: Block, n: int, v: int) -> None:
        order = len(b.keys)
        count = [own + more for own, more in zip(b.own, b.more, strict=True)]
        self.known = count[0] > 0
        self.order_of, self.fail, self.fall = [np.zeros(1, np.int64), np.ones(1, np.int64)], [np.zeros(2, np.int64)], [np.zeros(1), np.log10(K / (np.array([b.texts]) + K))]
        state, size = [], 2
        for k in range(1, order):
            seen = count[k - 1] > 0
            ids = np.full(len(seen), -1, np.int32)
            ids[seen] = size + np.arange(seen.sum())
            size += int(seen.sum())
            state.append(ids)
            self.order_of.append(np.full(int(seen.sum()), k))
            shorter = np.zeros(len(seen), np.int64) if k == 1 else state[k - 2][b.at[k - 2][b.first[k - 1]]]
            self.fail.append(shorter[seen])
            self.fall.append(np.log10(K / (count[k - 1][seen] + K)))
        self.order_of, self.fail, self.fall = (np.concatenate(x) for x in (self.order_of, self.fail, self.fall))
        p = (count[0] + 1) / (n + v + 1)
        self.base = np.log10(p)
        self.weight, self.target = [self.base], [np.where(self.known, state[0], 0) if order > 1 else np.zeros(len(p), np.int64)]
        for k in range(2, order + 1):
            shorter = b.at[k - 2][b.first[k - 1]]
            context = b.prefix(k)
            above = np.where(context >= 0, count[k - 2][np.maximum(context, 0)], np.where(context == -1, b.texts, 0))
            p = (count[k - 1] + K * p[shorter]) / (above + K)
            arc = (count[k - 1] > 0) & (context > -2)
            self.weight.append(np.where(arc, np.log10(p), np.nan))
            self.target.append(state[k - 1] if k < order else (state[k - 2][shorter] if order > 1 else np.zeros(len(p), np.int64)))
        self.begin = 1 if order > 1 else 0
        self.lists = None

    def walk(self, b: Block, together: int = TOGETHER) -> np.ndarray:
        """The log10 probability of each text: one traversal that carries the states."""
        size = np.diff(b.starts)
        rank = np.argsort(-size, kind="stable")
        start, size = b.starts[:-1][rank], size[rank]
        total, state = np.zeros(len(rank)), np.full(len(rank), self.begin, np.int64)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        step = 0
        for k in active.tolist():
            if k < together:
                break
            todo, at = np.arange(k), start[:k] + step
            for n in range(len(self.weight), 0, -1):
                here = todo[self.order_of[state[todo]] == n - 1]
                if not len(here):
                    continue
                arc = b.at[n - 1][at[here]]
                w = self.weight[n - 1][arc]
                has = ~np.isnan(w)
                took = here[has]
                total[took] += w[has]
                state[took] = self.target[n - 1][arc[has]]
                if len(took) < len(here):
                    left = here[~has]
                    total[left] += self.fall[state[left]]
                    state[left] = self.fail[state[left]]
                if len(took) == len(todo):
                    break
                if len(took):
                    keep = np.ones(k, bool)
                    keep[took] = False
                    todo = todo[keep[todo]]
            step += 1
        for t in range(int(active[step]) if step < len(active) else 0):
            total[t] += self._alone(b, int(start[t]) + step, int(start[t] + size[t]), int(state[t]))
        out = np.empty(len(rank))
        out[rank] = total
        return out

    def _alone(self, b: Block, lo: int, hi: int, state: int) -> float:
        """The rest of one text."""
        total, cut = 0.0, 1 << 16
        if self.lists is None:
            self.lists = self.order_of.tolist(), self.fail.tolist(), self.fall.tolist()
        order_of, fail, fall = self.lists
        for at in range(lo, hi, cut):
            arcs = [a[at : min(hi, at + cut)] for a in b.at]
            weights = [w[a].tolist() for w, a in zip(self.weight, arcs, strict=True)]
            targets = [t[a].tolist() for t, a in zip(self.target, arcs, strict=True)]
            for i in range(len(weights[0])):
                n = order_of[state]
                while True:
                    w = weights[n][i]
                    if w == w:
                        total += w
                        state = targets[n][i]
                        break
                    total += fall[state]
                    state = fail[state]
                    n -= 1
        return float(total)


def scores(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text); train: which rows teach."""
    spark, tmp = docs.sparkSession, Scratch()
    bound_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    # Row groups of a few blocks, so that no reader holds many.
    texts = tmp.keep(docs.mapInArrow(_texts(block_bytes), "block string, load binary"), **{"parquet.block.size": 2 * block_bytes})
    shards = max(4 * parts(spark), texts.count() // 16)

    def answers(asked: DataFrame) -> DataFrame:
        return tmp.keep(asked.repartition(parts(spark), "shard").sortWithinPartitions("shard").mapInArrow(_answer(shards), SCHEMA))

    def blocks_with(told: list[DataFrame]) -> DataFrame:
        rows = texts.select("block", F.lit(0).alias("kind"), F.lit(-1).alias("shard"), "load")
        for i, t in enumerate(told):
            rows = rows.unionByName(t.where("block <> ''").select("block", F.lit(i + 1).alias("kind"), "shard", "load"))
        return rows.repartition(parts(spark), "block").sortWithinPartitions("block", "kind", "shard")

    told = [answers(texts.mapInArrow(_ask(order, shards), SCHEMA))]
    tmp.settle(spark)
    both = np.zeros(2, np.int64)
    for (load,) in told[0].where("block = ''").select("load").collect():
        both += np.frombuffer(bytes(load), np.int64)
    n, v = both.tolist()
    for k in range(3, order + 1):

        def ask(name, b, rows, k=k):
            at = b.asks(k)
            yield from _chunks(_loads(name, [(b.keys[k - 1][at], b.own[k - 1][at])], shards))

        told.append(answers(blocks_with(told).mapInArrow(_by_block(k, k - 2, shards, ask), SCHEMA)))
        tmp.settle(spark)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(name, b, rows):
        a = Automaton(b, n, v)
        total = lambda x: np.add.reduceat(x, b.starts[:-1])
        out = [rows.column("doc_id"), pa.array(np.diff(b.starts)), pa.array(total(a.known[b.at[0]].astype(np.int64))), pa.array(np.full(len(b.starts) - 1, n, np.int64)), pa.array(total(a.base[b.at[0]])), pa.array(a.walk(b, together))]
        yield pa.RecordBatch.from_arrays(out, names=names)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names[1:4]), *(T.StructField(x, T.DoubleType()) for x in names[4:])])
    return tmp.result(blocks_with(told).mapInArrow(_by_block(order, max(1, order - 1), shards, score), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", remainder("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
