"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations to a minimum per node (map-side combine) and two
joins on the node.  The tables that are joined are written, so the joins read plain
exchanges on both sides and the planner may split the links of a hub; nothing
but the number of nodes that are not settled yet reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.sources.staging import settle


def _pointed_at(links: DataFrame, lower: DataFrame) -> DataFrame:
    """Links (u, v) with the least node ``m`` of u's neighbourhood."""
    return links.join(settle(lower, "least"), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = _pointed_at(both, least).filter("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = _pointed_at(links, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def _unsettled(links: DataFrame) -> int:
    """Nodes that have two parents, or a parent and a child; without such nodes every component is one star."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    nodes = links.select(ends.alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("parents"), F.min("end.up").alias("child"))
    return nodes.filter("parents > 1 or (parents = 1 and child = 0)").count()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)`` but the roots; root is the least node.

    Self-links, repeated links and either direction are allowed; no links give no rows.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    links = settle(ordered.distinct(), "links")
    while _unsettled(links):
        links = settle(_small_star(settle(_large_star(links), "large-star")), "small-star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
