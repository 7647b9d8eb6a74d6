"""Copies of a text: groups, label conflicts, keep-first removal.

Texts are long and mostly unique, so they are not shuffled to find copies.  A
64-bit key per row is counted first and the repeated keys are folded into a
bitmap of bounded size.  Only rows whose bit is set (copies, and a few others)
go through the exact text comparison, where map-side aggregation folds a hot
text before anything moves; all other rows pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import text_key
from postmill.sources.staging import settle

ORDER = ("source_file", "source_line")


# A bitmap chunk holds this many bits (fixed by the bitmap aggregate); the whole
# map has at most 2**31 bits, so that broadcasting it costs at most 256 MB.
CHUNK_BITS, MAX_BITS = 15, 31


def map_bits(keys: int) -> int:
    """Address width that keeps about one bit in sixteen set, within the bounds."""
    return min(MAX_BITS, max(CHUNK_BITS, (16 * keys).bit_length()))


def split_copies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is certainly unique, rows that may have a copy)."""
    keyed = df.withColumn("_key", text_key(F.col("text")))
    repeated = settle(keyed.groupBy("_key").count().where("count > 1").select("_key"), "copy-keys")
    place = F.col("_key").bitwiseAND(F.lit((1 << map_bits(repeated.count())) - 1))
    chunk, offset = F.shiftright(place, CHUNK_BITS), place.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
    chunks = repeated.groupBy(chunk.alias("_chunk")).agg(F.bitmap_construct_agg(offset).alias("_bits"))
    byte = F.substring(F.col("_bits"), F.shiftright(offset, 3).cast("int") + 1, F.lit(1))
    mask = F.pow(F.lit(2), offset % 8).cast("int")
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(mask)
    marked = keyed.withColumn("_chunk", chunk).join(F.broadcast(chunks), "_chunk", "left")
    repeats = F.coalesce(bit != 0, F.lit(False))
    return marked.where(~repeats).select(*df.columns), marked.where(repeats).select(*df.columns)


def maybe_copies(df: DataFrame) -> DataFrame:
    return split_copies(df)[1]


def text_groups(copies: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One row per text shared by at least two rows, with the wanted counts."""
    aggregates = [F.count_if(condition).alias(name) for name, condition in counts.items()]
    return copies.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), *aggregates).where("copies > 1")


def by_label() -> dict[str, Column]:
    return {"human_rows": F.col("label") == 0, "ai_rows": F.col("label") == 1}


_CONFLICT = "human_rows > 0 AND ai_rows > 0"


def label_conflicts(df: DataFrame) -> DataFrame:
    """Every row whose text occurs under both labels."""
    copies = maybe_copies(df)
    texts = text_groups(copies, by_label()).where(_CONFLICT).select("text")
    return copies.join(settle(texts, "conflict-texts"), "text", "left_semi").select(*df.columns)


def deduplicate(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows without label conflicts, first row per (label, text) in source order."""
    unique, copies = split_copies(df)
    others = [name for name in df.columns if name != "text"]
    first = F.min_by(F.struct(*others), F.struct(*order))
    kept = (
        copies.groupBy("text")
        .agg(F.min("label").alias("_low"), F.max("label").alias("_high"), first.alias("_first"))
        .where("_low = _high")
        .select("text", "_first.*")
    )
    return unique.unionByName(kept).select(*df.columns)


def dedupe_report(df: DataFrame) -> DataFrame:
    """One row: what ``deduplicate`` removes and why."""
    unique, copies = split_copies(df)
    per_text = copies.groupBy("text").agg(
        F.count(F.lit(1)).alias("copies"),
        (F.min("label") < F.max("label")).alias("conflict"),
    )
    zero = F.lit(0).cast("bigint")
    parts = unique.agg(
        F.count(F.lit(1)).alias("rows_in"), zero.alias("texts"), zero.alias("rows"), zero.alias("extra")
    ).unionByName(
        per_text.agg(
            F.coalesce(F.sum("copies"), zero).alias("rows_in"),
            F.count_if("conflict").alias("texts"),
            F.coalesce(F.sum(F.when(F.col("conflict"), F.col("copies"))), zero).alias("rows"),
            F.coalesce(F.sum(F.when(~F.col("conflict"), F.col("copies") - 1)), zero).alias("extra"),
        )
    )
    total = parts.agg(*[F.sum(name).alias(name) for name in parts.columns])
    return total.select(
        F.col("rows_in").alias("input_rows"),
        F.col("texts").alias("conflict_text_values"),
        F.col("rows").alias("conflict_rows_removed"),
        F.col("extra").alias("within_label_duplicate_rows_removed"),
        (F.col("rows_in") - F.col("rows") - F.col("extra")).alias("output_rows"),
    )


def copy_groups(df: DataFrame) -> DataFrame:
    """Rows per label of every text that occurs more than once, without the texts."""
    return text_groups(maybe_copies(df), by_label()).drop("text")


def duplicate_counts(groups: DataFrame) -> DataFrame:
    """Metric/value rows from ``copy_groups``: rows in groups of equal text, overall and per label."""
    zero = F.lit(0)
    totals = groups.agg(
        F.coalesce(F.sum("copies"), zero).alias("duplicate_rows_overall"),
        F.coalesce(F.sum(F.col("copies") - 1), zero).alias("duplicate_text_values_overall"),
        F.coalesce(F.sum("human_rows"), zero).alias("duplicate_rows_label_0"),
        F.coalesce(F.sum("ai_rows"), zero).alias("duplicate_rows_label_1"),
    )
    long = totals.unpivot([], totals.columns, "metric", "value")
    # A label without duplicated rows has no entry.
    return long.where(~F.col("metric").startswith("duplicate_rows_label_") | (F.col("value") > 0))


def text_overlap(groups: DataFrame) -> DataFrame:
    """From ``copy_groups``: distinct texts under both labels, and the rows that carry them."""
    return groups.where(_CONFLICT).agg(
        F.count(F.lit(1)).alias("overlap_text_values"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in_overlap"),
    )
