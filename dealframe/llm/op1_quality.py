"""Quality classifier: a linear-chain CRF labels every line good or bad.

Every line has features of its own and of its neighbours. The two-state chain is
trained on a bounded sample of labelled documents, whose lines take the document's
label: the mean over texts of the log-likelihood of those labels, with one L2 penalty.
As a text's lines share a label, the chain learns to keep its state, and a line
between others is judged by them too. A document's quality is the length-weighted mean of its lines' posterior
marginals (forward-backward), mapped to a probability by a logistic curve fitted
on the same sample.

Defined cases: null or empty text is one empty line and gets a score as any other;
an empty table gives no rows; with no usable labels every score is 0.5; a null or
repeated doc_id is scored row by row; an input column with an output's name is
replaced. Ties need no rule, as a score depends on its own text alone. Very long texts,
in one line or in millions, are scored whole: features by pieces, the chain by links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealframe.llm._common import append_columns, remainder, table
from dealframe.llm._text import Words, blocks

#: Labelled documents that the classifier is fitted on at most (the first by hash of id).
MAX_TRAIN_DOCS = 3000
#: Bytes of text that it is fitted on at most.
MAX_TRAIN_BYTES = 50_000_000
#: Lines that it is fitted on at most; a text that would go beyond them teaches nothing.
MAX_TRAIN_LINES = 1_000_000
#: Lines of a text that are walked one after the other; longer texts go in links of so many.
CHAIN = 1024
#: A text of more bytes has its features worked out for at most so many bytes (a line at least) and lines at a time.
PIECE_BYTES = 1 << 20
PIECE_LINES = 1 << 16
PENALTY = 1e-3
THRESHOLD = 0.7

OWN = 14
NEAR = [2, 4, 5, 6, 7, 8, 9, 12]
WIDTH = OWN + 2 * len(NEAR)


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[65:91] = 1
    c[97:123] = 2
    c[48:58] = 3
    for ch in b".,;:'\"?()-":
        c[ch] = 4
    for ch in b"#$%&*@^~<>{}[]\\/=+_`":
        c[ch] = 5
    c[ord("|")] = 6
    c[ord("!")] = 7
    c[192:] = 8
    return c


class LineFeatures:
    """Features of the lines of a block of texts."""

    def __init__(self) -> None:
        self.words, self.cls = Words(), _classes()

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (lines x WIDTH), line lengths in bytes, first line of each text (one more at the end)."""
        nd = len(offs) - 1
        nl = np.flatnonzero(data == 10)
        doc = np.searchsorted(offs, nl, "right") - 1
        first = np.arange(nd + 1) + np.searchsorted(nl, offs)
        lines = nd + len(nl)
        lo, hi = np.empty(lines, np.int64), np.empty(lines, np.int64)
        lo[first[:-1]] = offs[:-1]
        hi[first[1:] - 1] = offs[1:]
        k = np.arange(len(nl)) + doc
        lo[k + 1], hi[k] = nl + 1, nl
        cls = self.cls[data]
        count = []
        for c in range(1, 9):
            run = np.zeros(len(data) + 1, np.int32)
            np.cumsum(cls == c, out=run[1:])
            count.append((run[hi] - run[lo]).astype(np.float64))
        upper, lower, digit, punct, symbol, bar, bang, other = count
        st, en, _ = self.words.spans(data, offs)
        h = self.words.hashes(data, st, en)
        same = np.zeros((2, len(st) + 1), np.int32)
        if len(st) > 2:
            np.cumsum(h[1:] == h[:-1], out=same[0, 2:])
            np.cumsum(h[2:] == h[:-2], out=same[1, 3:])
        a, b = np.searchsorted(st, lo), np.searchsorted(st, hi)
        nw = (b - a).astype(np.float64)
        w, size = np.maximum(nw, 1), (hi - lo).astype(np.float64)
        inner = np.minimum(a + 1, b)
        x = np.zeros((lines, WIDTH))
        x[:, 0] = 1
        x[:, 1] = np.log1p(size) / 5
        x[:, 2] = upper / np.maximum(upper + lower + other, 1)
        x[:, 3] = digit / np.maximum(size, 1)
        x[:, 4] = punct / w
        x[:, 5] = symbol / w
        x[:, 6] = bar / w
        x[:, 7] = bang / w
        x[:, 8] = (same[0, b] - same[0, inner]) / w
        x[:, 9] = (same[1, b] - same[1, np.minimum(a + 2, b)]) / w
        x[:, 10] = size / w / 10
        x[:, 11] = nw <= 3
        last = data[np.maximum(hi - 1, 0)] if len(data) else np.zeros(lines, np.uint8)
        x[:, 12] = (size > 0) & ((last == 46) | (last == 33) | (last == 63))
        x[:, 13] = size == 0
        x[:, 10] = np.minimum(x[:, 10], 5)
        x[:, 4:8] = np.minimum(x[:, 4:8], 3)
        n = len(NEAR)
        x[1:, OWN : OWN + n] = x[:-1, NEAR]
        x[first[:-1], OWN : OWN + n] = 0
        x[:-1, OWN + n :] = x[1:, NEAR]
        x[first[1:] - 1, OWN + n :] = 0
        return x, size, first


def _links(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into links of at most ``CHAIN`` lines: first line, number of lines, and place within the text of each."""
    lines = np.diff(first)
    links = np.maximum(-(-lines // CHAIN), 1)
    rank = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    start = np.repeat(first[:-1], links) + rank * CHAIN
    return start, np.minimum(np.repeat(first[1:], links) - start, CHAIN), rank


def _borders(e: np.ndarray, t: np.ndarray, start: np.ndarray, active: np.ndarray, rank: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each link from the lines before it, and from those behind it, from the products of its steps.

    link: the place in this order of each link in order of lines; a text's links follow each other.
    """
    m = np.empty((len(start), 2, 2))
    for s, k in enumerate(active):
        at = e[start[:k] + s][:, None, :]
        m[:k] = (m[:k] @ t if s else np.where(rank[:, None, None] > 0, t, np.eye(2))) * at
        m[:k] /= m[:k].sum((1, 2), keepdims=True)
    enter, leave = np.ones((len(start), 2)), np.ones((len(start), 2))
    chain = rank[link]
    for r in range(1, chain.max() + 1):
        now, before = link[chain == r], link[np.flatnonzero(chain == r) - 1]
        v = (enter[before][:, None, :] @ m[before])[:, 0]
        enter[now] = v / v.sum(1, keepdims=True)
    for r in range(chain.max(), 0, -1):
        now, before = link[chain == r], link[np.flatnonzero(chain == r) - 1]
        v = (m[now] @ leave[now][:, :, None])[:, :, 0]
        leave[before] = v / v.sum(1, keepdims=True)
    return enter, leave


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(line is good) by forward-backward, the expected transitions (2 x 2), and the sum of the texts' log partition functions.

    emit: the log-odds of good of each line. Texts advance together, longest first,
    so that a step costs as many rows as there are texts of that length or more. Texts of
    more than ``CHAIN`` lines go in links that advance together too: the product of a
    link's steps carries the chain across it in both directions, which tells each link
    what its neighbours say before its own lines are walked.
    """
    n = len(emit)
    start, size, rank = _links(first)
    order = np.argsort(-size, kind="stable")
    link = np.empty(len(order), np.int64)
    link[order] = np.arange(len(order))
    start, size, rank = start[order], size[order], rank[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    e = np.zeros((n, 2))
    e[:, 1] = emit
    e = np.exp(e - np.maximum(emit, 0)[:, None])
    t = np.exp(trans - trans.max())
    fw, bw = np.empty((n, 2)), np.ones((n, 2))
    logz = np.maximum(emit, 0).sum() + trans.max() * (np.diff(first) - 1).sum()
    later = rank > 0
    if later.any():
        enter, leave = _borders(e, t, start, active, rank, link)
        bw[start + size - 1] = leave
    for s, k in enumerate(active):
        at = start[:k] + s
        v = e[at] if not s else (fw[at - 1] @ t) * e[at]
        if not s and later.any():
            v[later] = (enter[later] @ t) * e[at[later]]
        total = v.sum(1, keepdims=True)
        fw[at] = v / total
        logz += np.log(total).sum()
    pairs = np.zeros((2, 2))
    for s in range(len(active) - 1, -1, -1):
        at = start[: active[s]] + s
        at = at if s else at[later]
        m = e[at] * bw[at]
        if s:
            v = m @ t.T
            v /= v.sum(1, keepdims=True)
            bw[at - 1] = v
        joint = fw[at - 1][:, :, None] * t[None] * m[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    post = fw * bw
    return post[:, 1] / post.sum(1), pairs, float(logz)


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]

    def documents(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The length-weighted mean marginal of each text."""
        return self._means(x @ self.weights, size, first)

    def _means(self, emit: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = marginals(emit, first, self.trans)
        w = size + 1
        return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def document(self, feats: LineFeatures, data: np.ndarray) -> np.ndarray:
        """``documents`` of one long text: features of a run of lines at a time, each with the lines beside it; only log-odds and lengths are kept."""
        nl = np.flatnonzero(data == 10)
        lo, hi = np.concatenate([[0], nl + 1]), np.concatenate([nl, [len(data)]])
        emits, sizes, a = [], [], 0
        while a < len(lo):
            b = min(a + PIECE_LINES, max(a + 1, int(np.searchsorted(hi, lo[a] + PIECE_BYTES, "right"))), len(lo))
            c, d = max(a - 1, 0), min(b + 1, len(lo))
            x, size, _ = feats(data[lo[c] : hi[d - 1]], np.array([0, hi[d - 1] - lo[c]]))
            emits.append((x @ self.weights)[a - c : b - c])
            sizes.append(size[a - c : b - c])
            a = b
        return self._means(np.concatenate(emits), np.concatenate(sizes), np.array([0, len(lo)]))

    def scores(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * (mean - 0.5) + self.curve[1])))


def _adam(params: list[np.ndarray], grad, steps: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, grad(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)


@dataclass
class Sample:
    """The lines of the training texts: features, lengths, first line of each text, and the texts' labels."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray
    y: np.ndarray


def lines_of(texts: list[str], labels: list[int]) -> Sample:
    feats, xs, sizes, firsts, base = LineFeatures(), [], [], [0], 0
    for _, _, data, offs in blocks(pa.array(texts, pa.large_string())):
        x, size, first = feats(data, offs)
        xs.append(x)
        sizes.append(size)
        firsts += [*(first[1:] + base)]
        base += len(x)
    return Sample(np.vstack(xs), np.concatenate(sizes), np.asarray(firsts), np.asarray(labels, np.float64))


def objective(s: Sample, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss and its gradients: the mean over texts of -log P(all lines have the text's label) + PENALTY / 2 |parameters|^2."""
    emit = s.x @ w
    good, pairs, logz = marginals(emit, s.first, trans)
    n = np.diff(s.first)
    target = np.repeat(s.y, n)
    seen = np.diag([(n[s.y == v] - 1).sum() for v in (0, 1)]).astype(float)
    path = float(emit @ target + (seen * trans).sum())
    loss = (logz - path) / len(s.y) + PENALTY / 2 * (w @ w + (trans * trans).sum())
    return loss, s.x.T @ (good - target) / len(s.y) + PENALTY * w, (pairs - seen) / len(s.y) + PENALTY * trans


def fit(texts: list[str], labels: list[int], steps: int = 200) -> QualityModel:
    """The least ``objective``; then a logistic curve from a text's mean marginal to the probability of its label."""
    if not len(labels):
        return QualityModel(np.zeros(WIDTH), np.zeros((2, 2)), (0.0, 0.0))
    s = lines_of(texts, labels)
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    _adam([w, trans], lambda: objective(s, w, trans)[1:], steps, 0.05)
    model = QualityModel(w, trans, (0.0, 0.0))
    mean, y = model.documents(s.x, s.size, s.first) - 0.5, s.y
    curve = [np.array([4.0, 0.0])]

    def slope():
        p = 1 / (1 + np.exp(-(curve[0][0] * mean + curve[0][1])))
        return [np.array([((p - y) * mean).mean() + 1e-3 * curve[0][0], (p - y).mean()])]

    _adam(curve, slope, 400, 0.05)
    model.curve = (float(curve[0][0]), float(curve[0][1]))
    return model


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES) -> QualityModel:
    """Fit on at most ``max_docs`` labelled documents of ``max_bytes`` and ``MAX_TRAIN_LINES`` in all, outside the held-out fold (crc32 mod 4 = 2).

    An id with both labels teaches nothing; of an id's rows the shortest (then least) text teaches.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_label"), F.max("quality").alias("_other")).where("_label = _other").drop("_other")
    sizes = docs.where("doc_id is not null").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_len")).groupBy("doc_id").agg(F.min("_len").alias("_len"))
    # Ids and lengths alone are ranked; texts are fetched for the ids that stay within both bounds.
    ranked = sizes.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    picked, room = [], max_bytes
    for r in ranked:
        if r["_len"] <= room:
            picked.append((r["doc_id"], r["_label"], r["_len"]))
            room -= r["_len"]
    if not picked:
        return fit([], [])
    want = docs.sparkSession.createDataFrame(picked, f"doc_id {dict(docs.dtypes)['doc_id']}, _label int, _len long")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_len", F.octet_length("text").cast("long"))
    rows = text.join(F.broadcast(want), ["doc_id", "_len"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    taught, room = [], MAX_TRAIN_LINES
    for r in rows:
        if (lines := r["text"].count("\n") + 1) <= room:
            taught.append(r)
            room -= lines
    return fit([r["text"] for r in taught], [r["_label"] for r in taught])


def with_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keep`` (default: all columns) and the score of every row's whole text."""

    def make():
        feats = LineFeatures()

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            means = [model.document(feats, data) if len(offs) == 2 and len(data) > PIECE_BYTES else model.documents(*feats(data, offs)) for _, _, data, offs in blocks(b.column("text"))]
            got = [model.scores(m) for m in means]
            return [pa.array(np.concatenate(got), pa.float64())]

        return batch

    return append_columns(docs, docs.columns if keep is None else keep, [(out, T.DoubleType())], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, model, ["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
