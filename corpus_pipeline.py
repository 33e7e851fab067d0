"""The corpus pipeline over `documents`: stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. SQL cannot express the stages (MinHash pruning, a fitted forest, byte-pair merges), so
there is no ORACLE_SQL; tests/llm compares a small run with plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.llm import bpe, mixing, ngram_join, quality, secrets
from captionloom.llm.common import documents, named, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null, empty and blank texts are rejected; equal rows fare alike; other columns ride along."""
    packed = docs.select("doc_id", "text", F.struct(*[named(c) for c in docs.columns]).alias("_row"))
    return quality.score_quality(packed).filter("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; rows without doc_id or word stay; an empty table stays empty."""
    return ngram_join.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every row stays, null and empty texts as they are; see secrets.redact()."""
    return secrets.redact(docs, secrets.forest(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets; null sources are one; see mixing.with_copies()."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and digests of the round trip, a row for each copy; null texts are empty ones."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what a stage returns is written to the shared folder before the next.

    Null, empty, repeated and very long texts fare as the stages say; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, name.replace(" ", "-"))
    return docs
