"""Exact seeded selection of the first k rows per group, without a global sort.

Rows are ordered by a hash of their id.  To find the hash of the k-th row of a
group, rows are counted per (group, hash prefix); only the one prefix bucket
that holds the k-th row is ranked.  The outcome is a tiny table of cut-off
hashes, so choosing rows is a comparison and wide rows never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.ordering import seeded_rank
from postmill.sources.staging import settle

# Hex digits of the hash that form a bucket: 4,096 buckets per group.
BUCKET_DIGITS = 3
BELOW_ALL, ABOVE_ALL = "", "g"  # sort before and after every hex digest


def bucket_counts(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group and hash bucket, with the running count of the group."""
    by = list(by)
    counts = settle(
        keyed.groupBy(*by, F.substring("_rank", 1, BUCKET_DIGITS).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")),
        "bucket-counts",
    )
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_upto", F.sum("_n").over(upto))


def rank_cutoffs(keyed: DataFrame, by: Sequence[str], takes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Hash of the ``take``-th row per group.

    ``keyed`` has the ``by`` columns and ``_rank``, unique within a group.
    ``takes`` has the ``by`` columns, ``take`` and any columns to carry along,
    several rows per group allowed.  Rows with ``_rank <= cutoff`` are taken.
    ``counts`` are the bucket counts, when the caller has them already.
    """
    by = list(by)
    counts = bucket_counts(keyed, by) if counts is None else counts
    # Written, so that its true size decides how the wide side is joined.
    wanted = settle(
        takes.join(counts, by)
        .where((F.col("take") <= F.col("_upto")) & (F.col("take") > F.col("_upto") - F.col("_n")))
        .withColumn("_nth", F.col("take") - F.col("_upto") + F.col("_n"))
        .drop("_n", "_upto"),
        "rank-buckets",
    )
    within = Window.partitionBy(*by, "_bucket").orderBy("_rank")
    ranked = (
        keyed.withColumn("_bucket", F.substring("_rank", 1, BUCKET_DIGITS))
        .join(wanted.select(*by, "_bucket").distinct(), [*by, "_bucket"], "left_semi")
        .withColumn("_nth", F.row_number().over(within))
        .withColumnRenamed("_rank", "_cut")
    )
    found = wanted.join(ranked, [*by, "_bucket", "_nth"]).drop("_bucket", "_nth")
    cutoff = F.when(F.col("take") <= 0, F.lit(BELOW_ALL)).otherwise(F.coalesce(F.col("_cut"), F.lit(ABOVE_ALL)))
    carried = takes.columns
    return settle(takes.join(found, carried, "left").select(*carried, cutoff.alias("cutoff")), "rank-cutoffs")


def _label_takes(df: DataFrame, n: int) -> tuple[int, dict[int, int], DataFrame]:
    sizes = {row["label"]: row["rows"] for row in df.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    total = sum(sizes.values())
    takes = {label: min(size, max(1, round(n * size / total))) for label, size in sizes.items()}
    frame = df.sparkSession.createDataFrame(sorted(takes.items()), "label int, take bigint")
    return total, takes, frame


def stratified_sample(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """About ``n`` rows with the label shares of ``df``, never more than ``n``.

    ``key`` must identify a row.  ``n`` at or above the row count returns ``df``.
    """
    total, takes, frame = _label_takes(df, n)
    if n >= total:
        return df
    keyed = df.withColumn("_rank", seeded_rank(F.col(key), seed))
    cutoffs = {
        row["label"]: row["cutoff"]
        for row in rank_cutoffs(keyed.select("label", "_rank"), ["label"], frame).collect()
    }
    keep = F.lit(False)
    for label, cutoff in cutoffs.items():
        keep = keep | ((F.col("label") == label) & (F.col("_rank") <= cutoff))
    sample = keyed.where(keep)
    if sum(takes.values()) > n:
        everything = F.lit(0).alias("_all")
        one = df.sparkSession.createDataFrame([(0, n)], "_all int, take bigint")
        last = rank_cutoffs(sample.select(everything, "_rank"), ["_all"], one).first()["cutoff"]
        sample = sample.where(F.col("_rank") <= last)
    return sample.drop("_rank")
