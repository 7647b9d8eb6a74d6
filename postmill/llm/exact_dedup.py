"""Exact de-duplication against a persistent digest index.

The index is a table of (digest, keep_id) bucketed and sorted by digest.  A
batch is folded to one row per digest (map-side combine, so a group of copies
of any size is one row per task), the digests already indexed are removed by a
sort-merge anti-join that shuffles the batch only, and the rest is appended.
A batch that is run again finds its own digests and reports the same result; a table can be admitted in batches.

Defined cases: a null text is the empty text; a null id counts as smaller than
any other; rows that repeat both id and text are one group of which one row
stays; other columns are not touched, whatever their names; an empty batch
leaves the index as it is.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.staging import settle


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def digest(text: Column) -> Column:
    """SHA-256 of the folded text, as 32 bytes."""
    return F.unhex(F.sha2(fold_ascii(F.coalesce(text, F.lit(""))), 256))


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """The table over the index at ``path``, created where there is none.

    ``buckets`` is fixed when an index is created and must be given again when
    another session opens it; by default it is the session's shuffle partitions.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def _buckets(spark: SparkSession, index: str) -> int:
    described = spark.sql(f"DESCRIBE EXTENDED {index}").filter("col_name = 'Num Buckets'").first()
    return int(described["data_type"])


def compact(spark: SparkSession, index: str, path: str) -> str:
    """The index with one sorted file per bucket again, written to ``path``."""
    fresh = open_index(spark, path, _buckets(spark, index))
    _append(spark, spark.table(index), fresh)
    return fresh


def _append(spark: SparkSession, rows: DataFrame, index: str) -> None:
    dealt = rows.select("digest", "keep_id").repartition(_buckets(spark, index), "digest")
    dealt.write.insertInto(index)


def drop_index(spark: SparkSession, index: str, path: str) -> None:
    """Forget the index and remove its folder."""
    spark.sql(f"DROP TABLE IF EXISTS {index}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _digests(docs: DataFrame) -> DataFrame:
    """``(digest, doc_id, repeats)``; texts are read once and go no further."""
    seen = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return settle(seen.groupBy("digest", "doc_id").agg(F.count("*").alias("repeats")), "digests")


def _groups(rows: DataFrame) -> DataFrame:
    return settle(rows.groupBy("digest").agg(F.max("doc_id").alias("largest"), F.sum("repeats").alias("group_size")), "groups")


def _add(groups: DataFrame, index: str) -> None:
    """Append the digests that the index lacks."""
    spark = groups.sparkSession
    fresh = groups.hint("merge").join(spark.table(index), "digest", "left_anti")
    _append(spark, fresh.withColumnRenamed("largest", "keep_id"), index)
    spark.catalog.refreshTable(index)


def _reported(rows: DataFrame, groups: DataFrame, index: str) -> DataFrame:
    """One row per document of ``rows``, from written tables: the index may go afterwards."""
    spark = rows.sparkSession
    # One row per group again; the join of rows with groups is free to split a hot digest.
    kept = settle(groups.hint("merge").join(spark.table(index), "digest").select("digest", "keep_id", "group_size"), "kept")
    joined = rows.join(kept, "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("repeat"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"),
        "text_sha256",
    )


def admit(docs: DataFrame, index: str) -> DataFrame:
    """Index the new digests of ``docs`` and return one row per document.

    A group that is new keeps its largest ``doc_id``; a group that was indexed
    before keeps the document indexed then.
    """
    rows = _digests(docs)
    groups = _groups(rows)
    _add(groups, index)
    return _reported(rows, groups, index)


def admit_batches(docs: DataFrame, index: str, batches: int = 2) -> DataFrame:
    """``admit`` in ``batches`` of about equal numbers of ids, larger ids first and null ids last.

    Later batches meet the digests of those before, so into an empty index each group keeps its largest
    ``doc_id``; ``group_size`` counts all batches.
    """
    rows = _digests(docs)
    shares = [i / batches for i in range(1, batches)]
    edges = (rows.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None) or []
    number = sum((F.col("doc_id") <= edge).cast("int") for edge in edges) if edges else F.lit(0)
    batch = F.coalesce(number, F.lit(len(edges)))
    for place in range(len(edges) + 1):
        _add(_groups(rows.where(batch == place)), index)
    return _reported(rows, _groups(rows), index)
