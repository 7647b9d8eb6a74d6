"""The registered queries of the corpus operators: (session, table folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    exact_dedup,
    fingerprint,
    hyperminhash,
    language,
    line_dedup,
    mixing,
    prefix_trie,
    quality,
    simhash,
    token_alignment,
    token_blocks,
    token_counts,
    word_codec,
)
from postmill.sources.staging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


TOKEN_LIMIT = 4096


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.col("change.section").alias("changed_section"),
        F.col("change.paragraph").alias("changed_paragraph"),
    )


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in two batches, the second against what the first has left in the index."""
    path = f"{shared_folder(spark)}/postmill-index-{uuid.uuid4().hex}"
    index = exact_dedup.open_index(spark, path)
    found = exact_dedup.admit_batches(documents(spark, sf_dir), index)
    exact_dedup.drop_index(spark, index, path)
    return found


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated(documents(spark, sf_dir))
    return cleaned.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.removed_lines", "line_dedup.removed_chunks")


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/postmill-blocks-{uuid.uuid4().hex}"
    token_blocks.write_blocks(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_blocks.read_digests(spark, path)


@query
def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return word_codec.digests(coded)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the conversations, each rebuilt with the opening of the first of its block of 100 ids."""
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.shared_openings(turns))


@query
def op12_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.align(documents(spark, sf_dir), *paths)
