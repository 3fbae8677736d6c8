"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from dealframe.llm import (
    op1_quality,
    op2_extract,
    op3_ngram_join,
    op4_embed_dedup,
    op5_sentencepiece,
    op6_langid,
    op7_lm,
    op8_chat,
    op9_token_counts,
    op10_decontam,
    op11_align,
    op12_whitening,
    op13_repeats,
    oracles,
)

QUERIES: dict[str, Callable] = {
    "op1_quality_crf": op1_quality.query,
    "op2_html_extract": op2_extract.query,
    "op3_ngram_jaccard": op3_ngram_join.query,
    "op4_embedding_dedup": op4_embed_dedup.query,
    "op5_sentencepiece": op5_sentencepiece.query,
    "op6_language_id": op6_langid.query,
    "op7_lm_score": op7_lm.query,
    "op8_chat_format": op8_chat.query,
    "op9_token_counts": op9_token_counts.query,
    "op10_decontamination": op10_decontam.query,
    "op11_cross_tokenizer": op11_align.query,
    "op12_embedding_whitening": op12_whitening.query,
    "op13_suffix_dedup": op13_repeats.query,
}
ORACLE: dict[str, str] = {
    "op3_ngram_jaccard": oracles.JACCARD,
    "op4_embedding_dedup": oracles.COSINE,
    "op8_chat_format": op8_chat.ORACLE,
    "op13_suffix_dedup": op13_repeats.ORACLE,
}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
