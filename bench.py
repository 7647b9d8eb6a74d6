"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Every query starts from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from postmill.registry.queries import QUERIES

HEADLINE = [
    "canonical_text",
    "dedupe",
    "audit_report",
    "near_dup",
    "stratified_split",
    "group_split",
    "stratified_sample",
    "binary_metrics",
    "subgroup_tables",
    "roc_points",
    "fold_summary",
    "json_alias",
    "char_ngrams",
    "vocabulary",
    "tfidf_weights",
    "train_score",
    "predict_test",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="postmill-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["nested_counts"](spark, "/root/testdata/sf0.001").collect()  # start the JVM's engines
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
