"""Forward and backward slices of a program graph, and its DOT text, from the command line.

    python -m patchloom.slice NODES EDGES SOURCE OUT LINE [LINE ...]

NODES and EDGES are tab-separated tables of one program, SOURCE its text. OUT gets the folders forward, backward and dot.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import graph
from patchloom.session import get_session
from patchloom.sources import readers


def write_slices(spark: SparkSession, nodes: str, edges: str, source: str, out: str, lines: list[int], data_only: bool = False) -> DataFrame:
    """Write both slices from some lines and the graph; returns part and text of what was written."""
    vertices, links = readers.read_graph(spark, nodes, edges)
    one = F.lit(0).alias("grp")
    flow = graph.line_graph(vertices.select(one, "id", "line"), links.select(one, "start", "end", "etype", "var"), data_only)
    text = readers.read_source_lines(spark, source).select(one, "line", "text")
    seeds = spark.createDataFrame([(0, x) for x in lines], "grp int, node int")
    sizes = text.groupBy("grp").agg(F.max("line").alias("n_lines"))
    valid = graph.checked_seeds(seeds, sizes)
    parts = [graph.slice_text(graph.slices(flow, valid, kind), text).select(F.lit(kind).alias("part"), "text") for kind in ("forward", "backward")]
    parts.append(graph.to_dot(flow).select(F.lit("dot").alias("part"), F.col("dot").alias("text")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    every.select("part", F.col("text").alias("value")).write.mode("overwrite").partitionBy("part").text(out)
    return every


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="patchloom.slice", description="Slices of a program graph.")
    for name in ("nodes", "edges", "source", "out"):
        parser.add_argument(name)
    parser.add_argument("lines", type=int, nargs="+")
    parser.add_argument("--data-only", action="store_true")
    a = parser.parse_args(args)
    write_slices(get_session(), a.nodes, a.edges, a.source, a.out, a.lines, a.data_only)


if __name__ == "__main__":
    main()
