"""Length tertiles of the frame being scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tertile fractions as they come out of the percentage round
# trip that defines the published tables; an ideal 1/3 moves edge rows.
LOWER_TERTILE = 0.33333333333333326
UPPER_TERTILE = 0.6666666666666665
NAMES = ("short", "medium", "long")


def _interpolated(fraction: float) -> Column:
    """Linear quantile between two order statistics of a cumulated histogram.

    Walks from whichever neighbour is nearer, as numpy does, so that integer
    edges come out exactly.
    """
    place = F.lit(fraction) * (F.col("_all") - 1)
    low = F.floor(place)
    high = F.least(low + 1, F.col("_all") - 1)
    share = F.max(place - low)

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col("text_len_chars"))).cast("double")

    left, right = at(low), at(high)
    return F.when(share < 0.5, left + (right - left) * share).otherwise(right - (right - left) * (1 - share))


def tertile_edges(df: DataFrame) -> DataFrame:
    """One row: smallest length, both tertile edges, largest length.

    Works on the histogram of lengths, whose size is bounded by the longest text.
    """
    histogram = df.where(F.col("text_len_chars").isNotNull()).groupBy("text_len_chars").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("text_len_chars").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = histogram.withColumns(
        {"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy())}
    )
    return cumulated.agg(
        F.min("text_len_chars").cast("double").alias("smallest"),
        _interpolated(LOWER_TERTILE).alias("lower"),
        _interpolated(UPPER_TERTILE).alias("upper"),
        F.max("text_len_chars").cast("double").alias("largest"),
    )


def add_length_buckets(df: DataFrame) -> DataFrame:
    """``df`` with ``length_bucket``: short, medium, long, or ``nan`` without a length.

    When the tertile edges coincide, the range is cut into three equal widths.
    """
    if "text_len_chars" not in df.columns:
        df = df.withColumn("text_len_chars", F.length(F.coalesce(F.col("text"), F.lit(""))))
    edges = tertile_edges(df).first()
    if edges["smallest"] is None:
        return df.withColumn("length_bucket", F.lit("nan"))
    first, second = edges["lower"], edges["upper"]
    if not edges["smallest"] < first < second < edges["largest"]:
        width = (edges["largest"] - edges["smallest"]) / 3
        first, second = width + edges["smallest"], 2 * width + edges["smallest"]
        if width == 0:
            first -= 1  # a single length is a medium one
    size = F.col("text_len_chars")
    bucket = F.when(size.isNull(), "nan").when(size <= first, "short").when(size <= second, "medium").otherwise("long")
    return df.withColumn("length_bucket", bucket)
