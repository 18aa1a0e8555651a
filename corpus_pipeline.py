"""The training-data pipeline: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldra.llm import minhash, packing, quality, secrets, substring
from veldra.llm.queries import table, vocabulary
from veldra.llm.store import staged


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; the labels that are not held out teach the classifier."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 percent)."""
    return minhash.deduplicated(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that also stand elsewhere."""
    return substring.deduplicated(docs, window=35)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("secret scan", mask_secrets), ("packing", pack)]

#: SQL can't express the classifier or the tokeniser; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
