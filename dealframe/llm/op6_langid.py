"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams over letters (every run of
other characters is one separator), hashed to 2**16 buckets. The weights are
trained with FTRL-proximal and elastic-net penalties on a bounded sample of the
training fold; a temperature fitted on a slice the trainer didn't see calibrates
the probabilities. Every text is read whole.

Defined cases: null text or a text without a letter gives ``und`` with score 0;
rows with a null lang teach nothing; with nothing to learn from every text is
``und``; equal scores go to the first language in order; an empty table gives no
rows; a repeated row is scored again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dealframe.llm._common import append_columns, remainder, table

BITS = 16
ORDERS = 3
#: Odd multipliers of the hash, one an order.
FACTORS = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35]
#: Texts of each language in the training sample at most (the first by hash of id).
MAX_PER_LANG = 600
#: Bytes of text in the sample at most, shared out evenly; each language has one text at least.
MAX_BYTES = 100_000_000
REJECT_BELOW = 0.5
SCALE = 20.0


class Grams:
    """Hashed letter n-grams of texts (code units of the basic plane)."""

    def __init__(self) -> None:
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)

    def codes(self, text: str) -> np.ndarray:
        """Lower-case code units; runs of what isn't a letter become one 0, also at both ends."""
        c = np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "surrogatepass"), np.uint16)
        ok = self.alpha[c]
        keep = ok.copy()
        keep[0] = True
        keep[1:] |= ok[:-1]
        return (c * ok)[keep].astype(np.uint32)

    def hashed(self, c: np.ndarray) -> list[np.ndarray]:
        h, out = c * np.uint32(FACTORS[0]), []
        for k in range(ORDERS):
            if k:
                h = (h[:-1] + c[k:]) * np.uint32(FACTORS[k])
            out.append((h >> np.uint32(32 - BITS)).astype(np.intp))
        return out


@dataclass
class LangModel:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def sparse(grams: Grams, text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.concatenate(grams.hashed(grams.codes(text)))
    idx, n = np.unique(g, return_counts=True)
    return idx, SCALE * n / max(1, len(g)) * idf[idx]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def ftrl(rows, ys, k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
    """Follow the regularised leader, per coordinate; returns weights (2**BITS x k) and bias."""
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias = np.zeros(k)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for (idx, x), y in zip(rows, ys, strict=True):
            w = weights(z[idx], n[idx])
            p = softmax(x @ w + bias)
            p[y] -= 1
            g = x[:, None] * p[None]
            sq = n[idx] + g * g
            z[idx] += g - (np.sqrt(sq) - np.sqrt(n[idx])) / alpha * w
            n[idx] = sq
            bias -= 0.01 * p
    return weights(z, n), bias


def fit(texts: list[str], langs: list[str]) -> LangModel:
    names = sorted(set(langs))
    if not names:
        return LangModel([], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0)
    grams = Grams()
    counted = [np.unique(np.concatenate(grams.hashed(grams.codes(t)))) for t in texts]
    df = np.zeros(1 << BITS)
    for idx in counted:
        df[idx] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    rows = [sparse(grams, t, idf) for t in texts]
    ys = [names.index(x) for x in langs]
    order = np.random.default_rng(5).permutation(len(rows))
    held = max(1, len(rows) // 10) if len(rows) >= 10 * len(names) else 0
    cal, tr = order[:held], order[held:]
    w, bias = ftrl([rows[i] for i in tr], [ys[i] for i in tr], len(names))
    best = 1.0
    if held:
        logits = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in cal])
        y = np.array([ys[i] for i in cal])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() + 1e-3 * abs(np.log(t))
        best = min(np.geomspace(0.05, 20, 121), key=loss)
    return LangModel(names, (w * idf[:, None] * SCALE).astype(np.float32), bias, float(best))


def sample(docs: DataFrame, max_per_lang: int, max_bytes: int) -> DataFrame:
    """(lang, text): at most ``max_per_lang`` whole rows of each language, in all at most ``max_bytes`` but for one text a language.

    A row is picked by itself, by (hash of id, id, hash of text): an id that stands in
    several rows teaches each of its texts under that row's own language, once.
    """
    ok = docs.where("lang is not null and text is not null and doc_id is not null").where(remainder("doc_id", 4) != 2)
    row = ["doc_id", "lang", F.xxhash64("text").alias("_h"), F.octet_length("text").cast("long").alias("_len")]
    # One top-n of every language: tasks pass on at most max_per_lang rows of each before the shuffle.
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_h")
    top = ok.select(*row).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max_per_lang)
    top = top.groupBy("doc_id", "lang", "_h", "_len").agg(F.min("_r").alias("_r"))
    share = F.lit(max_bytes) / F.greatest(F.count_distinct("lang"), F.lit(1))
    room = top.agg(share.alias("_share"))
    run = F.sum("_len").over(Window.partitionBy("lang").orderBy("_r"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_r"))
    top = top.select("doc_id", "lang", "_h", run.alias("_run"), place.alias("_at")).join(F.broadcast(room)).where("_at = 1 or _run <= _share").select("doc_id", "lang", "_h")
    rows = ok.select("doc_id", "lang", F.xxhash64("text").alias("_h"), "text").join(F.broadcast(top), ["doc_id", "lang", "_h"])
    return rows.groupBy("doc_id", "lang", "_h").agg(F.min("text").alias("text")).orderBy("doc_id", "lang", "_h").select("lang", "text")


def train(docs: DataFrame, max_per_lang: int = MAX_PER_LANG, max_bytes: int = MAX_BYTES) -> LangModel:
    """Fit on a bounded sample of rows outside the held-out fold (crc32 mod 4 = 2); every language is learned."""
    rows = sample(docs, max_per_lang, max_bytes).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def with_language(docs: DataFrame, model: LangModel, keep: list[str] | None = None, out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep`` (default: all columns), the predicted language and its calibrated probability."""

    def make():
        grams = Grams()
        k = len(model.langs)
        # A table a language; with many languages one product over counted grams is cheaper.
        tables = [np.ascontiguousarray(model.weights[:, i]) for i in range(k)] if k <= 16 else []
        step = 1 << 18

        def one(text: str | None) -> tuple[str, float]:
            if not text or not k:
                return "und", 0.0
            codes = grams.codes(text)
            if not codes.any() and not any(ch.isalpha() for ch in text):
                return "und", 0.0
            total, z = 0, np.zeros(k)
            for at in range(0, len(codes), step):
                for n, g in enumerate(grams.hashed(codes[at : at + step + ORDERS - 1])):
                    g = g[:step] if at + step < len(codes) else g[: max(0, len(codes) - at - n)]
                    total += len(g)
                    if tables:
                        for i, t in enumerate(tables):
                            z[i] += float(t[g].sum(dtype=np.float32)) if len(g) < 20_000 else float(t[g].sum(dtype=np.float64))
                    else:
                        z += np.bincount(g, minlength=1 << BITS) @ model.weights
            p = softmax((z / max(1, total) + model.bias) / model.temperature)
            i = int(p.argmax())
            return model.langs[i], float(p[i])

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            got = [one(x.as_py()) for x in b.column("text")]
            return [pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())]

        return batch

    return append_columns(docs, docs.columns if keep is None else keep, [(out, T.StringType()), (score, T.DoubleType())], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return with_language(docs, train(docs), ["doc_id"]).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
