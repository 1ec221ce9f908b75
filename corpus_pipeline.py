"""A training-data pipeline over ``documents``: quality, exact copies, near duplicates, source
mixing, tokens. Each stage works on all rows that its predecessor kept.

Nulls may stand in any column and ids may repeat: rows are told apart by number. A null text counts
as empty. Empty tables give empty results; without labels of both classes no document is rejected
unless all labels are 0. Further columns are carried through all stages but the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pacegrid.llm import bpe, common, dedup, jaccard, mixing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null or empty text is scored like any other."""
    return quality.keep_good(docs, quality.fit(docs, common.read_table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id stays, null ids last; null and empty are equal."""
    return dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id stays, null ids last; texts without
    words are nobody's near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for; a null source is a source, and one
    without words gives no documents."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes."""
    fields = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, public_tokenizers.path(bpe.RANKS), fields=fields)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_duplicates),
    ("mix", source_mix),
    ("tokens", tokens),
]

#: Classifier, components and tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds each
#: stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
