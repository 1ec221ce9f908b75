"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pacegrid.llm import bpe, chat, dedup, filteraudit, jaccard, langid, mixing, ogg, pii, quality, tokencount, toxicity, whitening

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_knn": quality.op2_quality_knn,
    "op3_toxicity_fm": toxicity.op3_toxicity_fm,
    "op4_pii_boosting": pii.op4_pii_boosting,
    "op5_ogg_media": ogg.op5_ogg_media,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_language_id": langid.op7_language_id,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_exact_dedup": dedup.op10_exact_dedup,
    "op11_token_counts": tokencount.op11_token_counts,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_filter_audit": filteraudit.op13_filter_audit,
}

SQL = {
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op10_exact_dedup": dedup.ORACLE_SQL,
    "op13_filter_audit": filteraudit.ORACLE_SQL,
}


def all_queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
