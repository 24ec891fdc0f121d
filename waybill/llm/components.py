"""Connected components of a link table, by alternating large and small stars.

Every round is two joins with map-side minima; a node with very many links is
split by adaptive execution.  Rounds are cut by written tables, and nothing but whether
a round was the last reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.workspace import Workspace


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "c")
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """From links (u, v): (node, label) of every linked node but the least of each component, which is the label."""
    edges = space.save(links.where("u <> v").select("u", "v").distinct())
    while True:
        starred = space.save(_small(_large(edges)))
        space.drop(edges)
        edges = starred
        inner = edges.select(F.col("v").alias("c")).join(edges.select(F.col("u").alias("d")), F.col("c") == F.col("d"), "left_semi")
        if inner.isEmpty():  # all links point at a least node: nothing is left to move
            return edges.withColumnsRenamed({"u": "node", "v": "label"})
