"""The corpus pipeline: stages over ``documents``, each written and read back.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``docs``.  Rows that repeat a ``doc_id`` are kept or dropped together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import language, line_dedup, mixing, simhash, word_codec
from postmill.sources.staging import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, wanted: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {name.lower() for name in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter.

    A null ``lang`` becomes the predicted one.
    """
    lang_pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    told = language.predict(docs, language.fit(docs), lang_pred, score).filter(F.col(lang_pred) != language.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", lang_pred)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks are taken out; documents of which no word is left go."""
    report = _free(docs, "line_dedup")
    cleaned = line_dedup.remove_repeated(docs, report)
    kept = cleaned.filter((F.col(report)["removed_chunks"] == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest id, null last, and of rows with
    that id the first."""
    row = _free(docs, "row_number")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group_row"))
    ids = numbered.select(F.col("doc_id").alias("row_id"), row).join(groups, row)
    first = ids.groupBy("group_row").agg(F.min(F.struct(F.col("row_id").isNull(), F.col("row_id"), F.col(row).alias("kept_row"))).alias("first"))
    # As many rows as documents: not a table to broadcast, at any size.
    kept = settle(first.select(F.col("first.kept_row").alias(row)), "kept").hint("merge")
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it, to whole passes; unread documents go."""
    read = mixing.passes(mixing.mix(docs)).select(F.col("doc_id").alias("read_id"), F.col("passes").alias("read_passes"))
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("doc"))
    joined = rows.join(settle(read, "passes").hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("read_id")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), "read_passes"))).select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every row."""
    coded = word_codec.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return word_codec.digests(coded)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("mixing sources", mixed_sources),
    ("BPE encoding", encoded),
]

# Stages train models and follow links between documents, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all rows that the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
