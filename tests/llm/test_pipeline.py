"""The pipeline's stages keep the columns, take effect and stay whole."""

import collections

import corpus_pipeline as P
from dealframe.llm import op1_quality, op3_ngram_join, op6_langid, op10_decontam
from dealframe.llm._common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    q = P.quality(spark, docs, sf)
    assert q.columns == docs.columns
    model = op1_quality.train(docs, table(spark, sf, "labels"))
    want = {r["doc_id"] for r in op1_quality.with_quality(docs, model).collect() if r["score"] >= 0.7}
    assert {r["doc_id"] for r in q.collect()} == want

    lang = P.language(spark, docs, sf)
    m = op6_langid.train(docs)
    want = {r["doc_id"] for r in op6_langid.with_language(docs, m, out="p", score="s").collect() if r["p"] != "und" and r["s"] >= 0.5}
    assert lang.columns == docs.columns
    assert {r["doc_id"] for r in lang.collect()} == want

    near = P.near_duplicates(spark, docs, sf)
    comp = {r["doc_id"]: r["component_id"] for r in op3_ngram_join.classes(docs, 5, 80).collect()}
    assert near.columns == docs.columns
    assert {r["doc_id"] for r in near.collect()} == set(comp.values())

    clean = P.decontaminate(spark, docs, sf)
    bad = {r["doc_id"] for r in op10_decontam.hits(docs, table(spark, sf, "benchmark")).collect()}
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_run(spark, sf):
    out = P.run(spark, sf).collect()
    assert out and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert max(collections.Counter(r["doc_id"] for r in out).values()) == 1
    assert [n for n, _ in P.STAGES] == ["quality classifier", "language identification", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece coding"]


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 0")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_odd_rows(spark, tmp_path, sf):
    """Null and empty texts, null and repeated ids, columns named as the stages name theirs, and empty labels and benchmark."""
    docs = table(spark, sf, "documents")
    more = spark.createDataFrame([(None, None, "en", "a", 0), (None, "", None, "a", 0), (90_001, "", "en", "a", 0), (90_002, None, None, None, None), (90_003, "same text here " * 30, "en", "b", 1), (90_003, "same text here " * 30, "en", "b", 1)], docs.schema)
    clash = docs.unionByName(more).selectExpr("*", "1.5d as score", "'x' as lang_pred", "7L as component_id", "n_chars as n", "'q' as _pipeline_score")
    n = clash.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns, name
        assert 0 < out.count() <= n
    at = str(tmp_path)
    clash.write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, sf, t).limit(0).write.parquet(f"{at}/{t}.parquet")
    assert P.decontaminate(spark, clash, at).count() == n
    assert P.tokens(spark, clash, at).count() == n
    assert P.quality(spark, clash, at).count() == 0
