"""Raw posts to split table: load, clean, audit, quarantine, dedupe, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.audit import audit_report
from postmill.operators.clean import clean_posts, cleaning_report
from postmill.operators.dedupe import dedupe_report, deduplicate, label_conflicts
from postmill.operators.leakage import near_duplicate_leakage, validate_splits
from postmill.operators.split import Ratios, create_splits, manifest_counts
from postmill.sources import sinks, versions
from postmill.sources.jsonl import load_posts
from postmill.sources.staging import run_folder, settle

OUTPUTS = ("data_audit", "label_conflicts", "cleaned_all", "prepare_summary")


def _tidy(report: DataFrame, section: str, key: Column) -> DataFrame:
    names = [name for name, kind in report.dtypes if kind == "bigint"]
    return report.withColumn("key1", key).unpivot(["key1"], names, "metric", "value").select(
        F.lit(section).alias("section"), "key1", F.lit("").alias("key2"), "metric", F.col("value").cast("double").alias("value")
    )


def audit_rows(raw: DataFrame, cleaned: DataFrame, min_title_only_chars: int = 1, load_report: DataFrame | None = None) -> DataFrame:
    """The audit of cleaned rows with the report of the cleaning and, when given, of the loading."""
    rows = audit_report(cleaned).unionByName(_tidy(cleaning_report(raw, min_title_only_chars), "cleaning_report", F.lit("")))
    if load_report is None:
        return rows
    return rows.unionByName(_tidy(load_report, "load_report", F.col("source_file")))


def prepare_summary(raw: DataFrame, cleaned: DataFrame, deduped: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows after each step, one row per step."""

    def step(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("step"), "rows")

    per_split = splits.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return (
        step(raw, "raw")
        .unionByName(step(cleaned, "cleaned"))
        .unionByName(step(deduped, "deduped"))
        .unionByName(per_split.select(F.col("split").alias("step"), "rows"))
    )


def audit_posts(raw: DataFrame, folder: str, min_title_only_chars: int = 1, load_report: DataFrame | None = None) -> DataFrame:
    """Clean and audit only; writes the report and returns its rows."""
    with run_folder(raw.sparkSession):
        cleaned = settle(clean_posts(raw, min_title_only_chars), "cleaned")
        return sinks.save_report(audit_rows(raw, cleaned, min_title_only_chars, load_report), folder)


def prepare_posts(
    raw: DataFrame,
    folder: str,
    ratios: Ratios = Ratios(),
    seed: int = 42,
    prefer_domain: bool = True,
    min_stratum_count: int = 2,
    min_title_only_chars: int = 1,
    force: bool = False,
    load_report: DataFrame | None = None,
) -> dict:
    """Write every preparation output under ``folder`` and return the summary.

    The order is fixed: the audit sees cleaned rows before any split exists, and
    duplicates go before the split so none is trained on and tested on.
    """
    spark = raw.sparkSession
    outputs = [f"{folder}/{name}" for name in OUTPUTS]
    sinks.guard_targets(spark, [*outputs, *versions.published(spark, f"{folder}/{sinks.SPLIT_OUTPUTS}")], force)
    with run_folder(spark):
        return _prepare(raw, folder, ratios, seed, prefer_domain, min_stratum_count, min_title_only_chars, load_report)


def _prepare(raw, folder, ratios, seed, prefer_domain, min_stratum_count, min_title_only_chars, load_report) -> dict:
    spark = raw.sparkSession
    cleaned = settle(clean_posts(raw, min_title_only_chars), "cleaned")
    sinks.save_report(audit_rows(raw, cleaned, min_title_only_chars, load_report), folder)

    label_conflicts(cleaned).write.mode("overwrite").parquet(f"{folder}/label_conflicts")
    deduplicate(cleaned).write.mode("overwrite").parquet(f"{folder}/cleaned_all")
    deduped = spark.read.parquet(f"{folder}/cleaned_all")
    removed = dedupe_report(cleaned).first().asDict()

    made, design = create_splits(deduped, ratios, seed, prefer_domain, min_stratum_count)
    # The splits are checked where they were written, and published with their manifest once they are sound.
    with versions.new_version(spark, f"{folder}/{sinks.SPLIT_OUTPUTS}") as place:
        splits = sinks.write_splits(made, place)
        validate_splits(splits)
        design["near_duplicate_leakage"] = near_duplicate_leakage(splits).first().asDict()
        design["dedupe_report"] = removed
        design["model_input_columns"] = ["text"]
        sinks.write_manifest(manifest_counts(splits), design, place)

    steps = prepare_summary(raw, cleaned, deduped, splits)
    summary = {row["step"]: row["rows"] for row in steps.collect()} | {"dedupe_report": removed}
    sinks.write_json(spark, summary, f"{folder}/prepare_summary")
    return summary


def prepare_jsonl(spark: SparkSession, human_path: str, ai_path: str, folder: str, sample: int | None = None,
                  mode: str = "fail", **options) -> dict:
    """``prepare_posts`` from two JSON-lines sources, with their load report."""
    with run_folder(spark):
        posts, report, bad = load_posts(spark, human_path, ai_path, sample, mode)
        summary = prepare_posts(posts, folder, load_report=settle(report, "load-report"), **options)
        report.write.mode("overwrite").json(f"{folder}/load_report")
        if mode == "quarantine":
            bad.write.mode("overwrite").parquet(f"{folder}/bad_lines")
        return summary
