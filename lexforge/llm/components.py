"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join on the node; links and labels
stay distributed and are written to the shared folder after each round.
Rounds end as soon as the links are stars: every node has one link to a
smaller one, which itself has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the smallest of them and the node."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(least, "u")
    moved = moved.where("v > u") if large else moved
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v")


def _open_nodes(links: DataFrame) -> DataFrame:
    """Nodes with several smaller neighbours, or with smaller and larger ones."""
    ends = (links.select("u", F.lit(1).alias("down"), F.lit(0).alias("up"))
            .union(links.select(F.col("v").alias("u"), F.lit(0), F.lit(1))))
    return (ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
            .where("down > 1 or (down = 1 and up = 1)"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the smallest node names it."""
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u != v").distinct())
    while not _open_nodes(links).isEmpty():
        links = written(_star(_star(links, True), False).distinct())
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v"), F.col("v")).distinct())
