"""Connected components of a distributed edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node of the component.

    A round points each node to its smallest neighbour, shortens these pointers twice, and replaces both ends of each
    edge by what they point to; edges within one tree vanish. Rounds grow with the logarithm of the longest chain. Each
    step is a written table, so a join with a much-linked node can be split by the adaptive planner, the neighbour minimum
    is combined before its shuffle, and no neighbour list is ever built.
    """
    edges = scratch.save(edges.where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min("b").alias("b"))
        up = scratch.save(near.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "up")
        for _ in range(2):
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = scratch.save(up.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "up")
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = scratch.save(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        half = scratch.save(edges.join(up.withColumnRenamed("node", "a"), "a").select("b", F.col("root").alias("x")), "half")
        moved = half.join(up.withColumnRenamed("node", "b"), "b").select(F.col("x").alias("a"), F.col("root").alias("b"))
        edges = scratch.save(moved.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
