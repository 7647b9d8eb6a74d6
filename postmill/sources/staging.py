"""Materialisation of intermediate tables in the cluster's shared folder.

A settled table survives the loss of executors, cuts lineage, and carries a
file size, so the planner itself decides whether it is small enough to
broadcast and falls back to a shuffle join when it is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUN: ContextVar[str | None] = ContextVar("postmill_run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or a folder of the warehouse where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/postmill-staging").rstrip("/")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for what is settled inside the block; it is removed at the end.

    A job that owns such a folder returns what it has written elsewhere, not a settled table.
    """
    path = f"{shared_folder(spark)}/postmill-run-{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, name: str = "table", by: str | None = None, **options: object) -> DataFrame:
    """Write ``df`` as Parquet, with options of the writer, to the folder of the run, or the shared one, and read it back."""
    spark = df.sparkSession
    path = f"{_RUN.get() or shared_folder(spark)}/postmill-{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
