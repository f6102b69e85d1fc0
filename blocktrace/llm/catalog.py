"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blocktrace.llm import (addresses, audio, fertility, languages, mixing, near_dups, packing, passages, prefixes,
                            quality, vectors, whitening)
from blocktrace.llm import pages as web
from blocktrace.llm.common import table


def op1_line_field(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learned from four fifths of the labels."""
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the addresses of all pages."""
    return addresses.judge_urls(table(spark, folder, "pages"))


def op3_mpeg_audio(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as Layer III streams, stored and read back."""
    return audio.audio_features(table(spark, folder, "documents"))


def op4_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies of all documents: two-word shingles, similarity of 0.8."""
    return near_dups.near_duplicates(table(spark, folder, "documents"), words=2)


def op5_sparse_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that several documents share."""
    return passages.repeated_passages(table(spark, folder, "documents"))


def op6_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    return languages.detect_languages(table(spark, folder, "documents"))


def op7_block_network(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return web.extract_text(table(spark, folder, "pages"))


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Three repeating weights share 150 % of all words, two repetitions at most."""
    return mixing.mix_sources(table(spark, folder, "documents")).drop("source")


def op9_fertility(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and fertility bands over all documents."""
    return fertility.fertility_rules(table(spark, folder, "documents"))


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, as `tokenizers` encodes them by default."""
    return packing.pack(table(spark, folder, "documents"), added_tokens=True)


def op11_z_fast_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Shared prefixes of all conversations, rebuilt on the heads of every twentieth."""
    return prefixes.prefix_tree(table(spark, folder, "conversations"))


def op12_qd_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on their 32 leading principal directions, with unit variance."""
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_tiled_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies of all vectors within their labels: a cosine of 0.93."""
    return vectors.near_vectors(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_line_field, op2_path_templates, op3_mpeg_audio, op4_minhash_join, op5_sparse_suffixes, op6_byte_network,
    op7_block_network, op8_mix_sources, op9_fertility, op10_pack, op11_z_fast_trie,
    op12_qd_whitening, op13_tiled_cosine)}
SQL = {"op8_mix_sources": mixing.SQL, "op11_z_fast_trie": prefixes.SQL, "op13_tiled_cosine": vectors.SQL}
