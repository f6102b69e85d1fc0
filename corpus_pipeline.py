"""From raw documents to packed training sequences, in stages.

Each stage works on all rows that the one before it kept, and each is written
as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blocktrace.llm import mixing, near_dups, packing, passages, quality
from blocktrace.llm.common import settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8."""
    return near_dups.representatives(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has."""
    return passages.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents so that sources reach their target weights."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    return packing.pack(docs, added_tokens=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near-duplicates", one_of_each),
    ("passages", first_passages),
    ("mixing", mix),
    ("packing", sequences),
]

#: Learned scores and minimiser positions have no SQL; tests/llm/test_pipeline.py holds run() and each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
