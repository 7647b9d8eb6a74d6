"""Outputs that are replaced as a whole.

A target is a folder of numbered versions.  A version counts once its mark, the last thing that is written,
stands in it; readers take the newest that counts.  A job that ends before that leaves the version before it
to the readers, and nothing is ever overwritten or renamed, so this holds on object stores too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

MARK = "_PUBLISHED"
# Versions that stay: the newest, and the one that a reader may still be in.
KEPT = 2


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, system = _system(spark, path)
    if not system.exists(target):
        return []
    return sorted(name for name in (status.getPath().getName() for status in system.listStatus(target)) if name.startswith("v-"))


def _counts(spark: SparkSession, folder: str) -> bool:
    mark, system = _system(spark, f"{folder}/{MARK}")
    return system.exists(mark)


def published(spark: SparkSession, path: str) -> list[str]:
    """Folders of the versions that count, oldest first."""
    return [folder for folder in (f"{path}/{name}" for name in _names(spark, path)) if _counts(spark, folder)]


def current(spark: SparkSession, path: str, otherwise: str | None = None) -> str:
    """The folder to read; ``otherwise`` (or ``path`` itself) where no version has been published."""
    found = published(spark, path)
    return found[-1] if found else otherwise or path


@contextmanager
def new_version(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write the next version to.  It is published when the block ends, and removed when it fails."""
    last = max((int(name.split("-")[1]) for name in _names(spark, path)), default=0)
    folder = f"{path}/v-{last + 1:09d}-{uuid.uuid4().hex[:8]}"
    target, system = _system(spark, folder)
    try:
        yield folder
    except BaseException:
        system.delete(target, True)
        raise
    mark, _ = _system(spark, f"{folder}/{MARK}")
    system.create(mark, False).close()
    for old in published(spark, path)[:-KEPT]:
        system.delete(_system(spark, old)[0], True)
