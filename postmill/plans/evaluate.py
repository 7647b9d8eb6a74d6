"""Score a split once and write metrics, tables and error lists from the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.scores import DEFAULT_THRESHOLD
from postmill.operators import metrics as mt
from postmill.operators.buckets import add_length_buckets
from postmill.operators.model import load_model, score_posts
from postmill.operators.sampling import stratified_sample
from postmill.sources import sinks
from postmill.sources.staging import run_folder, settle


def evaluate_scores(
    scored: DataFrame, folder: str, threshold: float = DEFAULT_THRESHOLD, split_name: str = "test"
) -> DataFrame:
    """Write every evaluation output for a frame with ``label`` and ``score_ai``.

    Any model goes through this path.  A ``split`` column of the frame wins over
    ``split_name``; missing metadata columns only drop their tables.
    """
    spark = scored.sparkSession
    frame = mt.predictions(scored, threshold)
    if "split" not in frame.columns:
        frame = frame.withColumn("split", F.lit(split_name))
    with run_folder(spark):
        record = _write_outputs(settle(add_length_buckets(frame), "scored"), folder, threshold)
    return spark.read.schema(record.schema).json(f"{folder}/metrics")


def _write_outputs(rows: DataFrame, folder: str, threshold: float) -> DataFrame:
    record = settle(mt.binary_metrics(rows, threshold=threshold), "metrics")
    record.write.mode("overwrite").json(f"{folder}/metrics")
    mt.per_class_f1(record).write.mode("overwrite").json(f"{folder}/class_f1_chart")
    mt.class_report(rows).write.mode("overwrite").json(f"{folder}/classification_report")
    sinks.prediction_table(rows).write.mode("overwrite").parquet(f"{folder}/predictions")
    # Overwritten even when empty, so no table of an earlier run stays behind.
    tables = settle(mt.all_subgroups(rows, threshold), "subgroups")
    tables.write.mode("overwrite").partitionBy("dimension").json(f"{folder}/subgroup_metrics")
    for name, chart in (("domain", mt.domain_chart), ("length_bucket", mt.length_chart)):
        own = tables.where(F.col("dimension") == name).withColumnRenamed("value", name)
        chart(own).write.mode("overwrite").json(f"{folder}/{name}_chart")
    sinks.false_positives(rows).write.mode("overwrite").parquet(f"{folder}/errors_false_positives")
    sinks.false_negatives(rows).write.mode("overwrite").parquet(f"{folder}/errors_false_negatives")
    mt.roc_points(rows).write.mode("overwrite").parquet(f"{folder}/roc_points")
    mt.pr_points(rows).write.mode("overwrite").parquet(f"{folder}/pr_points")
    return record


def evaluate_model(
    spark: SparkSession,
    model_folder: str,
    rows: DataFrame,
    folder: str,
    threshold: float = DEFAULT_THRESHOLD,
    max_rows: int | None = None,
    seed: int = 42,
    split_name: str = "test",
) -> DataFrame:
    """Load a saved model, score ``rows`` and write the evaluation outputs."""
    sinks.require_columns(rows)
    model = load_model(spark, model_folder)
    with run_folder(spark):
        frame = rows if max_rows is None else stratified_sample(rows, max_rows, seed)
        # Scoring is the costly step: its result is written once and read by every table.
        scored = settle(score_posts(frame, model), "model-scores")
        return evaluate_scores(scored, folder, threshold, split_name)
