"""Arrow batches of texts, bounded by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT = "67108864b"
BYTES = 4 << 20


def bound_batches(docs: DataFrame) -> None:
    """Send batches of about 4 MB to Python from here on in this session, unless its user has
    set a bound; the engine's default of 64 MB is held several times over by each worker."""
    conf = docs.sparkSession.conf
    if conf.get(LIMIT) == DEFAULT:
        conf.set(LIMIT, str(BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``, to be sent to Python in bounded batches."""
    bound_batches(docs)
    return docs.select("doc_id", "text")
