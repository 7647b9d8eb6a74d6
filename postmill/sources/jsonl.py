"""JSON-lines posts: strict scan, canonical columns, load report."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from postmill.functions.text import STRIP_CLASS
from postmill.sources.staging import settle

# The canonical columns and the keys each may be stored under, in
# order of preference.
ALIASES = {
    "note_content": ("note_content", "desc"),
    "likes": ("likes", "liked_count"),
    "collections": ("collections", "collected_count"),
    "comments": ("comments", "comments_count"),
}
COUNTS = ("likes", "collections", "comments")
CANONICAL_COLUMNS = [
    "note_title",
    "note_content",
    "label",
    "source_file",
    "source_line",
    "note_id",
    "local_time",
    "likes",
    "collections",
    "comments",
    "domain",
    "model_family",
    "model",
]
RAW_COUNTS = [f"{name}_raw" for name in COUNTS]
MODES = ("fail", "quarantine")
# Lines of a block in which good rows are counted.
BLOCK_LINES = 1 << 16
_PLAIN = ("note_title", "note_id", "local_time", "domain", "model_family", "model")
_KEYS = [*_PLAIN, *[key for keys in ALIASES.values() for key in keys]]
_VALUES = "struct<" + ",".join(f"`{key}`:string" for key in _KEYS) + ">"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line, value) with exact 1-based line numbers.

    The lines are staged once.  A line's number is its place within its file
    block plus the lines of the blocks before it, so nothing is sorted.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    staged = settle(raw, "raw-lines")
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        staged.groupBy("_path", "_block")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
        .withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
        .drop("_lines")
    )
    number = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return staged.join(settle(blocks, "line-blocks"), ["_path", "_block"]).select(
        "source_file", number.alias("source_line"), "value"
    )


@pandas_udf(T.BooleanType())
def _loads_as_object(lines: pd.Series) -> pd.Series:
    """The verdict of Python's own parser on the few lines in doubt."""

    def verdict(line: str | None) -> bool | None:
        if line is None:
            return None
        try:
            return isinstance(json.loads(line), dict)
        except (ValueError, RecursionError):
            return False

    return lines.map(verdict, na_action=None).astype("object")


def _is_object(line: Column) -> Column:
    """Exactly one JSON object on the line.

    A line that the native parser accepts and whose first closing brace is also
    its last character cannot hide anything behind the object.  Every other
    line is asked of ``json.loads``.
    """
    bare = F.regexp_replace(line, r"\A[ \t\n\r]+|[ \t\n\r]+\z", "")
    plain = (
        F.try_parse_json(line).isNotNull() & bare.startswith("{") & (F.instr(bare, "}") == F.length(bare))
    )
    certain = F.coalesce(plain, F.lit(False))
    return certain | F.coalesce(_loads_as_object(F.when(~certain, line)), F.lit(False))


def _keys(line: Column) -> Column:
    listed = F.coalesce(F.json_object_keys(line), F.map_keys(F.from_json(line, "map<string,string>")))
    return F.coalesce(listed, F.array().cast("array<string>"))


def parse_lines(lines: DataFrame, label: int) -> DataFrame:
    """Canonical columns of every non-blank line, with ``_problem`` on bad ones.

    ``_problem`` is null on a good row.  An alias counts when its key is there,
    also with a null value.  A count is a whole number in any JSON spelling; what else stands
    in its place is kept as it is in a ``_raw`` column, but NaN is a missing value.
    """
    present = F.col("_present")

    def stored(name: str) -> Column:
        keys = ALIASES.get(name, (name,))
        chosen = F.lit(None).cast("string")
        for key in reversed(keys):
            chosen = F.when(F.array_contains(present, key), F.col(f"_value.{key}")).otherwise(chosen)
        return chosen

    def alias_used(name: str) -> Column:
        keys = ALIASES[name]
        return F.array_contains(present, keys[1]) & ~F.array_contains(present, keys[0])

    problem = (
        F.when(~F.col("_object"), "malformed: not one JSON object")
        .when(~F.array_contains(present, "note_title"), "missing: no title key")
        .when(
            ~F.arrays_overlap(present, F.array(*[F.lit(key) for key in ALIASES["note_content"]])),
            "missing: no body under any of its keys (note_content, desc)",
        )
    )
    columns = {name: stored(name) for name in CANONICAL_COLUMNS if name not in ("label", "source_file", "source_line")}
    for name in COUNTS:
        found = columns[name]
        number = found.try_cast("decimal(38,18)")
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        columns[name] = whole
        columns[f"{name}_raw"] = F.when(whole.isNull() & (found != "NaN"), found)
    return (
        lines.where(F.col("value").rlike(f"[^{STRIP_CLASS}]"))
        .withColumns(
            {
                "_object": _is_object(F.col("value")),
                "_present": _keys(F.col("value")),
                "_value": F.from_json(F.col("value"), _VALUES),
            }
        )
        .withColumns({"label": F.lit(label), "_problem": problem, **columns})
        .withColumns({f"_alias_{name}": alias_used(name) for name in ALIASES})
        .select(*CANONICAL_COLUMNS, *RAW_COUNTS, "_problem", *[f"_alias_{name}" for name in ALIASES], "value")
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_problem").isNull()).select(*CANONICAL_COLUMNS, *RAW_COUNTS)


def bad_rows(parsed: DataFrame) -> DataFrame:
    """Rows kept aside in quarantine mode."""
    return parsed.where(F.col("_problem").isNotNull()).select(
        "source_file", "source_line", F.col("_problem").alias("problem"), "value"
    )


def load_report(parsed: DataFrame) -> DataFrame:
    """Per source: rows loaded, malformed, lacking a field, alias uses, and counts that are no number."""
    ok = F.col("_problem").isNull()
    return parsed.groupBy("source_file", "label").agg(
        F.count_if(ok).alias("rows_loaded"),
        F.count_if(F.col("_problem").startswith("malformed")).alias("malformed_rows"),
        F.count_if(F.col("_problem").startswith("missing")).alias("missing_required_rows"),
        *[F.count_if(ok & F.col(f"_alias_{name}")).alias(f"alias_{name}") for name in ALIASES],
        *[F.count_if(ok & F.col(f"{name}_raw").isNotNull()).alias(f"unread_{name}") for name in COUNTS],
    )


def _reaching(good: DataFrame, key: Column, n: int) -> Row | None:
    """``(key, ahead)``: the first group, by ``key``, at whose end ``n`` rows have been seen, and the rows ahead of it."""
    counts = good.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    summed = counts.withColumn("upto", F.sum("rows").over(Window.orderBy("key")))
    place = F.struct("key", (F.col("upto") - F.col("rows")).alias("ahead"))
    return summed.where(F.col("upto") >= n).agg(F.min_by(place, "upto")).first()[0]


def first_n(parsed: DataFrame, n: int) -> DataFrame:
    """Lines up to the one that holds the n-th good row of the source.

    Later lines are never looked at, so a bad line after that cannot fail the load.  Lines are not sorted: good
    rows are counted by file, by block of the file that the n-th is in, and by line of that block.
    """
    if n <= 0:
        return parsed.where(F.lit(False))
    file, line = F.col("source_file"), F.col("source_line")
    block = F.floor(line / BLOCK_LINES)
    good = parsed.where(F.col("_problem").isNull()).select(file, line)
    in_file = _reaching(good, file, n)
    if in_file is None:
        return parsed
    last_file, n = F.lit(in_file["key"]), n - in_file["ahead"]
    good = good.where(file == last_file)
    in_block = _reaching(good, block, n)
    last_line = _reaching(good.where(block == in_block["key"]), line, n - in_block["ahead"])["key"]
    return parsed.where((file < last_file) | ((file == last_file) & (line <= F.lit(last_line))))


def check_lines(parsed: DataFrame, source: str) -> None:
    """Raise on bad rows, malformed ones first, with a count and three examples."""
    for kind, title in (("malformed", "not JSON objects"), ("missing", "without a needed key")):
        bad = parsed.where(F.col("_problem").startswith(kind))
        examples = bad.select("source_file", "source_line", "_problem").orderBy("source_file", "source_line").limit(3).collect()
        if examples:
            shown = ", ".join(f"{row['source_line']} ({row['_problem']})" for row in examples)
            raise ValueError(f"{source}: {bad.count()} lines are {title}; the first are {shown}")


def load_source(
    spark: SparkSession, path: str, label: int, sample: int | None = None, mode: str = "fail"
) -> DataFrame:
    """Parsed lines of one source; ``mode`` decides what bad rows do."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, use one of {', '.join(MODES)}")
    parsed = settle(parse_lines(read_lines(spark, path), label), "parsed-lines")
    if sample is not None:
        parsed = first_n(parsed, sample)
    if mode == "fail":
        check_lines(parsed, path)
    return parsed


def load_posts(
    spark: SparkSession, human_path: str, ai_path: str, sample: int | None = None, mode: str = "fail"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, load report, quarantined rows) of the human and the AI source."""
    human = load_source(spark, human_path, 0, sample, mode)
    ai = load_source(spark, ai_path, 1, sample, mode)
    parsed = human.unionByName(ai)
    return good_rows(parsed), load_report(parsed), bad_rows(parsed)
