"""The labelled ``posts`` view derived from the driver's ``documents`` table.

The driver's tables have no title, label or generator.  Integer arithmetic on
``doc_id`` supplies them, whole documents stay whole, and some documents get a
second copy that differs in decoration only; a few get a post without any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Added to the id of a decorated copy, and twice to that of an empty post; keeps every
# divisibility used below.
COPY_OFFSET = 40_040_000
DECORATION = "!!😊"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical post columns plus ``doc_id``, ``source`` and a fixture ``score_ai``."""
    copies = (
        F.when(F.col("doc_id") % 17 == 3, F.array(F.lit(0), F.lit(1)))
        .when(F.col("doc_id") % 77 == 0, F.array(F.lit(0), F.lit(2)))
        .otherwise(F.array(F.lit(0)))
    )
    decorated, empty = F.col("copy") == 1, F.col("copy") == 2
    base = (
        documents(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .select(
            (F.col("doc_id") + F.col("copy") * COPY_OFFSET).alias("doc_id"),
            F.when(empty, "").when(decorated, F.concat("text", F.lit(DECORATION))).otherwise(F.col("text")).alias("text"),
            "lang",
            "source",
            F.when(empty, 0).otherwise(F.col("n_chars") + F.col("copy") * len(DECORATION)).alias("n_chars"),
        )
    )
    key, text = F.col("doc_id"), F.col("text")
    label = F.when(key % 8 == 0, 1).otherwise(0)
    labelled = base.withColumn("label", label)
    human, ai = F.col("label") == 0, F.col("label") == 1
    family = F.concat(F.lit("fam"), (F.floor(key / 8) % 6).cast("string"))
    return labelled.select(
        "doc_id",
        F.when(key % 11 == 0, text)
        .when(human & (key % 7 == 0), "")
        .otherwise(F.split_part(text, F.lit("\n"), F.lit(1)))
        .alias("note_title"),
        F.when(key % 11 == 0, F.lit(None).cast("string"))
        .when(key % 5 == 0, F.concat(F.lit("\t"), F.replace(text, F.lit("\n"), F.lit("\r\n\n\n")), F.lit("  ")))
        .otherwise(text)
        .alias("note_content"),
        "label",
        F.when(ai, "aigc").otherwise("human").alias("source_file"),
        key.alias("source_line"),
        F.when(human, F.concat(F.lit("n"), key.cast("string"))).alias("note_id"),
        F.when(human, F.col("n_chars")).alias("likes"),
        F.col("lang").alias("domain"),
        "source",
        F.when(ai, family).alias("model_family"),
        F.when(ai, F.concat(family, F.lit("-"), (F.floor(key / 48) % 3).cast("string"))).alias("model"),
        ((key * 7919 % 701 + F.col("label") * 300) / F.lit(1000.0)).alias("score_ai"),
    )
