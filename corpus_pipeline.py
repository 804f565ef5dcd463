"""A training corpus from `documents`: quality, near-duplicates, secrets, packing. Counted as part of graphloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents; the last returns the pieces of the packed sequences.

Defined cases: null and empty texts pass the near-duplicate stage each by itself, score as the classifier's bias alone, and are packed as
their end token; rows with a null or repeated doc_id take part, one row of each class stays; without usable labels every document scores
the share of good labels, 0.5 without any, and goes if that is under 0.7; empty tables give no rows; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard, packing, quality, secret_scan
from graphloom.llm.common import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier learns from the labelled ones among docs."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id. Five words a shingle, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET]; every document stays."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. Executors have grown in the stages before, so the encoder keeps fewer stretches."""
    return packing.pack(docs, entries=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The trained models of the first and third stage have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
