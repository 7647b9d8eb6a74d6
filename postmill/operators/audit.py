"""Descriptive audit of a cleaned corpus; nothing here changes the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import missing_label
from postmill.operators.dedupe import copy_groups, duplicate_counts, text_overlap
from postmill.sources.staging import settle

# Lengths of a bin in which the middle of a group is looked for.
LENGTH_BIN = 1 << 10

# Metadata that may be reported on but must never become a feature.
NOT_FOR_FEATURES = ["local_time", "likes", "collections", "comments", "domain", "model_family", "model"]


def value_counts(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Rows per value, null as ``<missing>``; an absent column gives no rows."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, rows bigint")
    kept = df if where is None else df.where(where)
    return kept.groupBy(missing_label(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows per pair of values; null is a group of its own."""
    if not {outer, inner} <= set(df.columns):
        return df.sparkSession.createDataFrame([], f"{outer} string, {inner} string, rows bigint")
    return df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("rows"))


def _is_missing(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    if dict(df.dtypes)[column] in ("float", "double"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _is_empty(column: str) -> Column:
    return F.length(F.coalesce(F.col(column).cast("string"), F.lit(""))) == 0


def _gaps(df: DataFrame) -> dict[str, Column]:
    """Whether each column is missing; a ``_raw`` column counts for the one it belongs to."""
    raw = {name: f"{name}_raw" for name in df.columns if f"{name}_raw" in df.columns}
    return {
        name: _is_missing(df, name) & F.col(raw[name]).isNull() if name in raw else _is_missing(df, name)
        for name in df.columns
        if name not in raw.values()
    }


def missing_counts(df: DataFrame) -> DataFrame:
    """Null (or NaN) rows per column, from one pass.

    A value that was kept in the ``_raw`` column beside its own is not missing.
    """
    wide = df.agg(*[F.count_if(missing).alias(name) for name, missing in _gaps(df).items()])
    return wide.unpivot([], wide.columns, "column_name", "missing_rows")


def empty_counts(df: DataFrame) -> DataFrame:
    """Rows with an empty title, body or text."""
    names = [name for name in ("note_title", "note_content", "text") if name in df.columns]
    wide = df.agg(*[F.count_if(_is_empty(name)).alias(name) for name in names])
    return wide.unpivot([], wide.columns, "column_name", "empty_rows")


def empty_title_by_label(df: DataFrame) -> DataFrame:
    """How often each label has no title, a formatting cue a model could learn."""
    rows, empty = F.count(F.lit(1)), F.count_if(_is_empty("note_title"))
    return df.groupBy("label").agg(
        rows.alias("rows"), empty.alias("empty_title_rows"), F.round(empty / rows, 6).alias("empty_title_share")
    )


def length_stats(df: DataFrame, group: str) -> DataFrame:
    """Count, mean, exact median, minimum and maximum of the text length.

    All follow from the number of rows of each group and length.  The median is found by running counts over bins
    of lengths, and over the lengths of the one or two bins that hold its places, so no task sees a group's rows.
    """
    size, rows = F.col("text_len_chars"), F.col("rows")
    lengths = settle(df.groupBy(group, size).agg(F.count(F.lit(1)).alias("rows")), "length-counts")
    known = lengths.where(size.isNotNull())
    bins = known.groupBy(group, F.floor(size / LENGTH_BIN).alias("bin")).agg(F.sum(rows).alias("rows"))
    upto = F.sum(rows).over(Window.partitionBy(group).orderBy("bin"))
    summed = bins.withColumns({"upto": upto, "all": F.sum(rows).over(Window.partitionBy(group))})
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = summed.where((F.col("upto") > low) & (F.col("upto") - rows <= high))
    middle = middle.select(F.col(group).alias("_group"), "bin", "all", (F.col("upto") - rows).alias("ahead"))
    inside = known.join(middle, F.col(group).eqNullSafe(F.col("_group")) & (F.floor(size / LENGTH_BIN) == F.col("bin")))
    reached = F.col("ahead") + F.sum(rows).over(Window.partitionBy(group, "bin").orderBy(size))
    at = [F.min(F.when(F.col("reached") > place, size)) for place in (low, high)]
    medians = inside.withColumn("reached", reached).groupBy("_group").agg(((at[0] + at[1]) / 2).alias("median"))
    stats = lengths.groupBy(group).agg(
        F.sum(F.when(size.isNotNull(), rows).otherwise(0)).alias("count"),
        F.sum(size * rows).alias("chars"),
        F.min(size).cast("bigint").alias("min"),
        F.max(size).cast("bigint").alias("max"),
    )
    mean = F.when(F.col("count") > 0, F.col("chars") / F.col("count")).alias("mean")
    joined = stats.join(medians, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(group, "count", mean, "median", "min", "max")


def metadata_columns(df: DataFrame) -> list[str]:
    """Columns present that must stay out of model features."""
    return [name for name in NOT_FOR_FEATURES if name in df.columns]


def _entry(section: str, key1: Column, key2: Column, metric: Column, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        key1.cast("string").alias("key1"),
        key2.cast("string").alias("key2"),
        metric.alias("metric"),
        value.cast("double").alias("value"),
    )


def _summed(facts: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """Each fact row contributes to every entry; null entries do not count."""
    slots = facts.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return slots.groupBy("section", "key1", "key2", "metric").agg(F.sum("value").alias("value"))


def _listed(df: DataFrame, *entries: Column) -> DataFrame:
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def audit_report(df: DataFrame) -> DataFrame:
    """The whole audit as tidy rows ``(section, key1, key2, metric, value)``.

    ``df`` should be a written table.  One pass over its narrow columns feeds
    every count; lengths and copies take one pass each.
    """
    none, rows = F.lit(""), F.lit("rows")
    columns = set(df.columns)
    dims = [name for name in ("label", "domain", "model_family", "model") if name in columns]
    blank = [name for name in ("note_title", "note_content", "text") if name in columns]
    gaps = {f"missing {name}": missing for name, missing in _gaps(df).items()}
    blanks = {f"empty {name}": _is_empty(name) for name in blank}
    facts = settle(
        df.groupBy(*dims).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(condition).alias(name) for name, condition in (gaps | blanks).items()],
        ),
        "audit-facts",
    )
    count, label, ai = F.col("rows"), F.col("label"), F.col("label") == 1
    entries = [
        _entry("total_rows", none, none, rows, count),
        _entry("label_counts", missing_label(label), none, rows, count),
    ]
    if "domain" in columns:
        domain = F.coalesce(F.col("domain"), F.lit("nan"))
        entries.append(_entry("domain_counts_by_label", label, domain, rows, count))
    for name in ("model_family", "model"):
        if name in columns:
            entries.append(F.when(ai, _entry(f"{name}_counts_aigc", missing_label(F.col(name)), none, rows, count)))
    for name in _gaps(df):
        entries.append(_entry("missing_field_counts", F.lit(name), none, rows, F.col(f"`missing {name}`")))
    for name in blank:
        entries.append(_entry("empty_counts", F.lit(name), none, rows, F.col(f"`empty {name}`")))
    parts = [_summed(facts, entries)]
    if "note_title" in columns:
        titles = facts.groupBy("label").agg(F.sum("rows").alias("rows"), F.sum("`empty note_title`").alias("empty"))
        section, share = "empty_title_counts_by_label", F.round(F.col("empty") / count, 6)
        parts.append(
            _listed(
                titles,
                _entry(section, label, none, rows, count),
                _entry(section, label, none, F.lit("empty_title_rows"), F.col("empty")),
                _entry(section, label, none, F.lit("empty_title_share"), share),
            )
        )
    groups = settle(copy_groups(df.select("label", "text")), "copy-groups")
    value = F.col("value")
    parts.append(
        _listed(duplicate_counts(groups), _entry("duplicate_text_counts", none, none, F.col("metric"), value))
    )
    overlap = text_overlap(groups)
    parts.append(
        _listed(
            overlap,
            *[
                _entry("human_aigc_exact_text_overlap", none, none, F.lit(name), F.col(name))
                for name in overlap.columns
            ],
        )
    )
    grouped = [name for name in ("label", "domain") if name in columns]
    keys = [
        F.struct(F.lit(name).alias("group"), F.coalesce(F.col(name).cast("string"), F.lit("nan")).alias("key"))
        for name in grouped
    ]
    lengths = length_stats(df.select("text_len_chars", F.explode(F.array(*keys)).alias("k")), "k")
    section = F.concat(F.lit("length_stats_by_"), F.col("k.group"))
    stats = _listed(
        lengths,
        *[
            F.struct(
                section.alias("section"),
                F.col("k.key").alias("key1"),
                none.alias("key2"),
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
            )
            for name in ("count", "mean", "median", "min", "max")
        ],
    )
    barred = df.sparkSession.createDataFrame([(name,) for name in metadata_columns(df)], "name string")
    section = "suspicious_columns_not_for_model_features"
    parts += [stats, _listed(barred, _entry(section, F.col("name"), none, F.lit("present"), F.lit(1)))]
    return reduce(DataFrame.unionByName, parts)
