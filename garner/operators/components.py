"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garner.session import cut


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` with ``component``, the smallest node it is linked to.

    ``edges``: a, b, of the same type as ``node``. Alternates large-star and small-star steps
    until no edge changes; each halves distances, so the number of rounds grows with the logarithm
    of the longest path. All steps are joins and aggregations: nothing is gathered on the driver.
    Null ends, loops and repeated edges are ignored; a node without edges is its own component.
    """
    found = edges.where("a is not null and b is not null and a <> b")
    # each edge points from the larger to the smaller end
    found = cut(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not found.isEmpty():
        before = None
        while True:
            found = cut(_small_star(_large_star(found)))
            mark = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if before == mark:
                break
            before = mark
    labels = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    return nodes.distinct().join(labels, "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node, are linked to the node's smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
