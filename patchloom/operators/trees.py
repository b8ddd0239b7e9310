"""Trees as node rows: (tree_id, node_id, parent_id, position), ids in pre-order from 0, the root's parent -1.

In pre-order a subtree is a run of ids, so copying and deleting need the subtree sizes only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.session import written


def numbered(rows: DataFrame, tree: str, levels: list[str]) -> DataFrame:
    """rows with node_id, parent_id and position. levels: key columns from the top down, null from a node's own depth on."""
    by = Window.partitionBy(tree)
    placed = rows.withColumn("node_id", (F.row_number().over(by.orderBy(*[F.col(c).asc_nulls_first() for c in levels])) - 1).cast("long"))
    parent = F.lit(-1).cast("long")
    for depth in range(len(levels)):
        # the first node that shares the keys above this depth has them as its own
        above = F.min("node_id").over(Window.partitionBy(tree, *levels[:depth]))
        parent = F.when(F.col(levels[depth]).isNotNull(), above).otherwise(parent)
    placed = placed.withColumn("parent_id", parent)
    return placed.withColumn("position", (F.row_number().over(Window.partitionBy(tree, "parent_id").orderBy("node_id")) - 1).cast("long"))


def with_path(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, path: ids from the root down to the node, level by level."""
    rest = nodes.select("tree_id", "node_id", "parent_id")
    level = written(rest.where("parent_id < 0").select("tree_id", "node_id", F.array("node_id").alias("path")), "path")
    found = [level]
    while True:
        above = level.select("tree_id", F.col("node_id").alias("parent_id"), "path")
        level = written(rest.join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.concat("path", F.array("node_id")).alias("path")), "path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(level)


def sized(nodes: DataFrame) -> DataFrame:
    """nodes with size: nodes of the subtree, the node included."""
    sizes = with_path(nodes).select("tree_id", F.explode("path").alias("node_id")).groupBy("tree_id", "node_id").agg(F.count("*").alias("size"))
    return nodes.join(sizes, ["tree_id", "node_id"])


def _inside(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """tree_id, root_id, node_id: nodes of the subtrees at roots (tree_id, root_id)."""
    sizes = sized(nodes).select("tree_id", F.col("node_id").alias("root_id"), "size")
    spans = roots.join(sizes, ["tree_id", "root_id"])
    return spans.select("tree_id", "root_id", F.explode(F.sequence("root_id", F.col("root_id") + F.col("size") - 1)).alias("node_id"))


def copies(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """tree_id, root_id, node_id, copy_id and the node's other columns: the subtrees at roots, their ids counted from 0."""
    return _inside(nodes, roots).join(nodes, ["tree_id", "node_id"]).withColumn("copy_id", F.col("node_id") - F.col("root_id"))


def without(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes outside the subtrees at roots, with new_id and new_parent: ids without gaps."""
    kept = nodes.join(_inside(nodes, roots).select("tree_id", "node_id").distinct(), ["tree_id", "node_id"], "left_anti")
    named = kept.withColumn("new_id", (F.row_number().over(Window.partitionBy("tree_id").orderBy("node_id")) - 1).cast("long"))
    above = named.select("tree_id", F.col("node_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return named.join(above, ["tree_id", "parent_id"], "left").withColumn("new_parent", F.coalesce("new_parent", F.lit(-1).cast("long")))
