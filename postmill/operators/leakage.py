"""Overlap between splits, exact and up to decoration, and the split checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import text_fingerprint
from postmill.operators.dedupe import maybe_copies, text_groups
from postmill.operators.split import SPLITS

PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


def _in(split: str) -> Column:
    return F.col(f"{split}_rows") > 0


def exact_overlap(df: DataFrame) -> DataFrame:
    """One row: distinct texts shared by each pair of splits."""
    counts = {f"{name}_rows": F.col("split") == name for name in SPLITS}
    groups = text_groups(maybe_copies(df.select("text", "split")), counts)
    return groups.agg(*[F.count_if(_in(a) & _in(b)).alias(f"{a}_{b}_shared_texts") for a, b in PAIRS])


def near_duplicate_leakage(df: DataFrame) -> DataFrame:
    """One row: fingerprints shared by each pair of splits, and the rows that carry them."""
    prints = df.groupBy(text_fingerprint(F.col("text")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("split") == name).alias(f"{name}_rows") for name in SPLITS],
    )
    crossing = (_in("train") & _in("val")) | (_in("train") & _in("test")) | (_in("val") & _in("test"))
    return prints.agg(
        *[F.count_if(_in(a) & _in(b)).alias(f"{a}_{b}_shared_fingerprints") for a, b in PAIRS],
        F.coalesce(F.sum(F.when(crossing, F.col("rows"))), F.lit(0)).alias("rows_involved"),
    )


def split_checks(df: DataFrame) -> DataFrame:
    """Checks table: emptiness and labels per split, shared texts per pair.

    ``problem`` is the number of offending things; 0 is a pass.
    """
    rows = [F.count_if(F.col("split") == name).alias(f"empty_{name}") for name in SPLITS]
    labels = [
        F.count_if((F.col("split") == name) & (F.col("label") == label)).alias(f"{name}_{label}")
        for name in SPLITS
        for label in (0, 1)
    ]
    counted = df.agg(*rows, *labels)
    flags = [F.when(F.col(f"empty_{name}") == 0, 1).otherwise(0).cast("bigint").alias(f"empty_{name}") for name in SPLITS]
    flags += [
        (
            F.when(F.col(f"{name}_0") == 0, 1).otherwise(0) + F.when(F.col(f"{name}_1") == 0, 1).otherwise(0)
        ).cast("bigint").alias(f"missing_labels_{name}")
        for name in SPLITS
    ]
    wide = counted.select(*flags)
    overlap = exact_overlap(df)
    return wide.unpivot([], wide.columns, "check_name", "problem").unionByName(
        overlap.unpivot([], overlap.columns, "check_name", "problem")
    )


def validate_splits(df: DataFrame) -> None:
    """Raise when a split is empty, shares a text with another, or lacks a label."""
    found = {row["check_name"]: row["problem"] for row in split_checks(df).collect()}
    empty = [name for name in SPLITS if found[f"empty_{name}"]]
    if empty:
        raise ValueError(f"no rows in {', '.join(empty)}")
    shared = {f"{a}_{b}": found[f"{a}_{b}_shared_texts"] for a, b in PAIRS}
    shared = {pair: count for pair, count in shared.items() if count}
    if shared:
        raise ValueError(f"texts occur in two splits: {shared}")
    lacking = [name for name in SPLITS if found[f"missing_labels_{name}"]]
    if lacking:
        raise ValueError(f"only one label in {', '.join(lacking)}")
