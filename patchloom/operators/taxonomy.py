"""Category trees: paths, roots, subtree counts, routing and rollup of rare classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.session import written

#: Main classes of the public weakness taxonomy, and the class of what belongs to none.
MAIN_CLASSES = ("CWE-189", "CWE-254", "CWE-264", "CWE-284", "CWE-310", "CWE-399", "CWE-664", "CWE-682", "CWE-691", "CWE-703", "CWE-707")
DEFAULT_CLASS = "CWE-0"


class CycleError(ValueError):
    """Some nodes are their own ancestors, so no root is above them."""


def closure(edges: DataFrame) -> DataFrame:
    """node, path (array from the root down) for edges node, parent (null: a root).

    Grows level by level from the roots, one join per level, until a level is empty; of several parents the smallest counts, and a
    node whose parent is unknown is a root. Each level is written before the next one joins it. Nodes on or below a cycle are
    an error.
    """
    single = written(edges.groupBy("node").agg(F.min("parent").alias("parent")), "tree")
    known = single.select(F.col("node").alias("parent"), F.lit(True).alias("is_node"))
    marked = single.join(known, "parent", "left")
    rest = written(marked.where("is_node").select("node", "parent"), "tree-rest")
    level = written(marked.where("is_node IS NULL").select("node", F.array("node").alias("path")), "tree-level")
    out, reached = level, 0
    while True:
        above = level.select(F.col("node").alias("parent"), "path")
        level = written(rest.join(above, "parent").select("node", F.concat("path", F.array("node")).alias("path")), "tree-level")
        n = level.count()
        if not n:
            break
        out, reached = out.unionByName(level), reached + n
    if reached < rest.count():
        raise CycleError("some nodes of the tree are on a cycle")
    return out


def path_text(path: Column) -> Column:
    return F.array_join(path, "<>")


def subtree_counts(paths: DataFrame) -> DataFrame:
    """node, n: nodes at or below each node."""
    return paths.select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def route(rows: DataFrame, key: str, paths: DataFrame, default: str = DEFAULT_CLASS, main: tuple[str, ...] = ()) -> DataFrame:
    """rows with top_parent: the root of their key's path; a main class stands for itself; else the default."""
    roots = paths.select(F.col("node").alias(key), F.element_at("path", 1).alias("__root"))
    own = F.when(F.col(key).isin(*main), F.col(key)) if main else F.lit(None).cast("string")
    return rows.join(roots, key, "left").withColumn("top_parent", F.coalesce("__root", own, F.lit(default))).drop("__root")


def roll_up_rare(counts: DataFrame, parents: DataFrame, least: int) -> DataFrame:
    """class, final: every class under least joins its parent, counts are taken anew, and so on until none does.

    counts: class, n; parents: class, parent. A round is a sum and a join of tables with a row per class, each written.
    """
    current = written(counts.select("class", F.col("class").alias("final"), "n"), "rollup")
    up = parents.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("class"))).select(F.col("class").alias("final"), "parent")
    while True:
        sizes = current.groupBy("final").agg(F.sum("n").alias("total")).where(F.col("total") < least)
        rare = written(sizes.join(up, "final").select("final", "parent"), "rollup-rare")
        if rare.isEmpty():
            return current.select("class", "final")
        current = written(current.join(rare, "final", "left").select("class", F.coalesce("parent", "final").alias("final"), "n"), "rollup")
