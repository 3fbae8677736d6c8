"""A training-corpus pipeline: quality, language, near-duplicates, decontamination, token ids.

Each stage takes the documents its predecessor kept and returns documents with the
same columns; the last returns each document's token ids. Between stages the rows
are written as Parquet in the cluster's shared folder and read again.

A null or empty text is scored by the quality classifier as any other text; a text
without a letter has no language and goes; equal texts keep the least doc_id; a
row with a null doc_id is never removed as a copy. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealframe.llm import op1_quality, op3_ngram_join, op5_sentencepiece, op6_langid, op10_decontam
from dealframe.llm._common import Written, table
from dealframe.llm._pieces import load

_SCORE, _LANG, _PROB = "_pipeline_score", "_pipeline_lang", "_pipeline_prob"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    model = op1_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = op1_quality.with_quality(docs, model, out=_SCORE)
    return scored.where(F.col(_SCORE) >= op1_quality.THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the identifier is sure of."""
    scored = op6_langid.with_language(docs, op6_langid.train(docs), out=_LANG, score=_PROB)
    return scored.where((F.col(_LANG) != "und") & (F.col(_PROB) >= op6_langid.REJECT_BELOW)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of five-word shingle links at 80 %."""
    found = op3_ngram_join.classes(docs, 5, 80).where("doc_id <> component_id")
    # Written, so that the size of the ids alone decides how they meet the texts.
    copies = Written(found.select("doc_id").distinct()).df
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return op10_decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars_decoded, round_trip) of each document."""
    return op5_sentencepiece.encoded(docs, load())


STAGES = [
    ("quality classifier", quality),
    ("language identification", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece coding", tokens),
]

#: The stages train models and search with fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        kept = Written(out)
        if last is not None:
            last.drop()
        docs, last = kept.df, kept
    return docs
