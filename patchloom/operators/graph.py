"""Dependency graphs: construction, slicing, neighbourhoods, subgraphs, calls and the Weisfeiler-Lehman kernel.

Edges are rows (grp, src, dst, kind): grp names the program, src and dst its nodes or lines.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.session import written

#: Edge types behind each selector.
EDGE_KINDS = {
    "reftype": ("EVAL_TYPE", "REF"),
    "ast": ("AST",),
    "pdg": ("REACHING_DEF", "CDG"),
    "ddg": ("REACHING_DEF",),
    "cfgddg": ("REACHING_DEF", "CFG"),
    "cfgcdg": ("CFG", "CDG"),
    "all": ("REACHING_DEF", "CDG", "AST", "EVAL_TYPE", "REF", "CFG"),
}
#: The two producers' names of the flow that a line graph is made of.
CONTROL, DATA = ("FLOWS_TO", "CFG"), ("REACHES", "REACHING_DEF")
#: Groups with more edges than this are sliced by the distributed loop.
GROUPED_EDGES = 200_000


def select_edges(edges: DataFrame, kind: str, etype: str = "etype") -> DataFrame:
    """Edges of a selector; an unknown one selects none."""
    return edges.where(F.col(etype).isin(*EDGE_KINDS.get(kind, ())))


def line_graph(nodes: DataFrame, edges: DataFrame, data_only: bool = False) -> DataFrame:
    """Line edges of program edges (grp, start, end, etype, var): both ends must have a line (grp, id, line).

    Data edges need a variable. Lines that are not positive are unknown.
    """
    lines = nodes.where("line > 0").select("grp", "id", "line")
    flow = edges.where(F.col("etype").isin(*CONTROL, *DATA) & ((F.col("etype") != "REACHING_DEF") | (F.coalesce("var", F.lit("")) != "")))
    flow = flow.withColumn("kind", F.when(F.col("etype").isin(*DATA), "data").otherwise("control"))
    if data_only:
        flow = flow.where("kind = 'data'")
    at = flow.join(lines.toDF("grp", "start", "src"), ["grp", "start"]).join(lines.toDF("grp", "end", "dst"), ["grp", "end"])
    return at.select("grp", "src", "dst", "kind").distinct()


def merged(edges: DataFrame) -> DataFrame:
    """Edges without their kind."""
    return edges.select("grp", "src", "dst").distinct()


def inverted(edges: DataFrame) -> DataFrame:
    swapped = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns])


def _reach(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    after = defaultdict(list)
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        after[a].append(b)
    seen = set(seeds["node"])
    todo = list(seen)
    while todo:
        for b in after[todo.pop()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    grp = seeds["grp"].iloc[0] if len(seeds) else None
    return pd.DataFrame({"grp": [grp] * len(seen), "node": sorted(seen)})


def reachable(edges: DataFrame, seeds: DataFrame, grouped_edges: int = GROUPED_EDGES) -> DataFrame:
    """grp, node: the seeds (grp, node) and all that they reach; a seed outside the graph is kept.

    Programs are small as a rule: those up to grouped_edges edges are searched in one task each. Larger ones are grown
    level by level, a join of the frontier and an anti-join with what is known, each level written before the next.
    """
    edges = written(edges.select("grp", "src", "dst").distinct(), "edges")
    seeds = written(seeds.select("grp", "node").distinct(), "seeds")
    sizes = edges.groupBy("grp").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > grouped_edges).select("grp"), "large")
    small_edges, small_seeds = (x.join(large, "grp", "left_anti") for x in (edges, seeds))
    kinds = dict(seeds.dtypes)
    grouped = small_edges.groupBy("grp").cogroup(small_seeds.groupBy("grp")).applyInPandas(_reach, f"grp {kinds['grp']}, node {kinds['node']}")
    if large.isEmpty():
        return grouped
    return grouped.unionByName(_grow(edges.join(large, "grp", "left_semi"), seeds.join(large, "grp", "left_semi")))


def _grow(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    frontier = known = written(seeds, "known")
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("node", "src").join(edges, ["grp", "src"]).select("grp", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(known, ["grp", "node"], "left_anti"), "frontier")
        known = written(known.unionByName(frontier), "known")
    return known


def slices(edges: DataFrame, seeds: DataFrame, kind: str) -> DataFrame:
    """forward, backward or combined slice; another kind gives none."""
    if kind == "forward":
        return reachable(edges, seeds)
    if kind == "backward":
        return reachable(inverted(edges), seeds)
    if kind == "combined":
        return slices(edges, seeds, "forward").unionByName(slices(edges, seeds, "backward")).distinct()
    return seeds.select("grp", "node").limit(0)


def checked_seeds(seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """Seeds (grp, node) of programs (grp, n_lines) all of whose seeds are lines of theirs; one bad line empties the slice."""
    bad = seeds.join(sizes, "grp").where("node < 1 OR node > n_lines").select("grp").distinct()
    return seeds.join(bad, "grp", "left_anti")


def slice_text(sliced: DataFrame, source: DataFrame) -> DataFrame:
    """grp, text: the lines (grp, line, text) of each slice, in order."""
    kept = source.join(sliced.select("grp", F.col("node").alias("line")), ["grp", "line"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return kept.groupBy("grp").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def hops(edges: DataFrame, starts: DataFrame, h: int, cumulative: bool = False) -> DataFrame:
    """grp, start, node: what walks of exactly h steps reach, or of 1 to h; edges count in both directions."""
    both = edges.select("grp", "src", "dst").unionByName(inverted(edges.select("grp", "src", "dst"))).distinct()
    at = starts.select("grp", F.col("node").alias("start"), "node").distinct()
    found = None
    for _ in range(h):
        at = at.withColumnRenamed("node", "src").join(both, ["grp", "src"]).select("grp", "start", F.col("dst").alias("node")).distinct()
        found = at if found is None or not cumulative else found.unionByName(at)
    found = at.limit(0) if found is None else found.distinct()
    return found.where("start <> node") if cumulative else found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (grp, node)."""
    kept = edges.join(nodes.select("grp", F.col("node").alias("src")), ["grp", "src"], "left_semi")
    return kept.join(nodes.select("grp", F.col("node").alias("dst")), ["grp", "dst"], "left_semi")


def ego(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The subgraph of the targets, their predecessors and successors."""
    after = edges.join(targets.select("grp", F.col("node").alias("src")), ["grp", "src"], "left_semi").select("grp", F.col("dst").alias("node"))
    before = edges.join(targets.select("grp", F.col("node").alias("dst")), ["grp", "dst"], "left_semi").select("grp", F.col("src").alias("node"))
    return induced(edges, targets.select("grp", "node").unionByName(after).unionByName(before).distinct())


def climb(nodes: DataFrame, parents: DataFrame, most: int = 10) -> DataFrame:
    """id, line, steps: the line of a node (id, line) or of its nearest ancestor that has one, up to most steps above."""
    lines = nodes.select(F.col("id").alias("at"), F.col("line"))
    open_rows, done = nodes.where("line IS NULL").select("id", F.col("id").alias("at")), nodes.where("line IS NOT NULL").select("id", "line", F.lit(0).alias("steps"))
    up = parents.select(F.col("id").alias("at"), "parent")
    for step in range(1, most + 1):
        above = open_rows.join(up, "at").select("id", F.col("parent").alias("at")).join(lines, "at")
        above = written(above, "climb")
        done = done.unionByName(above.where("line IS NOT NULL").select("id", "line", F.lit(step).alias("steps")))
        open_rows = above.where("line IS NULL").select("id", "at")
        if open_rows.isEmpty():
            break
    return done


def ordered_children(nodes: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Nodes with their 0-based position among their parent's children."""
    return nodes.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)


def function_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """grp, name, function, line, ordinal, formal, type, formal_line: the functions of a program with their formals in order.

    nodes: grp, id, label, code, line, ordinal; edges: grp, start, end, etype. A function leads to its definition, that to its
    parameter list, that to its parameters, and those to their names and types. One without parameters has a row without formal.
    """
    parent = edges.where(F.col("etype").isin("IS_FUNCTION_OF_AST", "IS_AST_PARENT")).select("grp", F.col("start").alias("above"), F.col("end").alias("id")).distinct()
    below = nodes.join(parent, ["grp", "id"])

    def step(rows: DataFrame, at: str, label: str, names: dict[str, str], how: str) -> DataFrame:
        found = below.where(F.col("label") == label).select("grp", F.col("above").alias(at), *[F.col(c).alias(n) for c, n in names.items()])
        return rows.join(found, ["grp", at], how)

    found = nodes.where("label = 'Function'").select("grp", F.col("id").alias("function"), F.col("code").alias("name"), "line")
    found = step(found, "function", "FunctionDef", {"id": "definition"}, "inner")
    found = step(found, "definition", "ParameterList", {"id": "list"}, "left")
    found = step(found, "list", "Parameter", {"id": "parameter", "line": "formal_line", "ordinal": "place"}, "left")
    found = step(found, "parameter", "Identifier", {"code": "formal"}, "left")
    found = step(found, "parameter", "ParameterType", {"code": "type"}, "left")
    ordinal = F.row_number().over(Window.partitionBy("grp", "function").orderBy("place", "parameter")) - 1
    return found.select("grp", "name", "function", "line", F.when(F.col("parameter").isNotNull(), ordinal).alias("ordinal"), "formal", "type", "formal_line")


def local_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """grp, id, name, type, block_line: the type that a local variable is two REF or EVAL_TYPE hops from, and its block's line.

    nodes: grp, id, label, name, line; edges: grp, start, end, etype.
    """
    links = select_edges(edges, "reftype").select("grp", F.col("start").alias("src"), F.col("end").alias("dst"))
    locals_ = nodes.where("label = 'LOCAL'").select("grp", "id", "name")
    near = hops(links, locals_.select("grp", F.col("id").alias("node")), 2).withColumnRenamed("start", "id")
    kinds = nodes.where("label = 'TYPE'").select("grp", F.col("id").alias("node"), F.col("name").alias("type"))
    typed = near.join(kinds, ["grp", "node"]).groupBy("grp", "id").agg(F.min("type").alias("type"))
    blocks = nodes.where("label = 'BLOCK'").select("grp", F.col("id").alias("start"), F.col("line").alias("block_line"))
    above = edges.where("etype = 'AST'").select("grp", "start", F.col("end").alias("id")).join(blocks, ["grp", "start"]).groupBy("grp", "id").agg(F.min("block_line").alias("block_line"))
    return locals_.join(typed, ["grp", "id"], "left").join(above, ["grp", "id"], "left")


def last_definitions(definitions: DataFrame) -> DataFrame:
    """name, def_id: of definitions with one name the last counts."""
    return definitions.groupBy("name").agg(F.max("def_id").alias("def_id"))


def call_edges(calls: DataFrame, definitions: DataFrame, library: tuple[str, ...] = ()) -> DataFrame:
    """Call sites (call_id, name) with the definition that they reach; library names are skipped."""
    return calls.where(~F.col("name").isin(*library)).join(last_definitions(definitions), "name")


def argument_edges(actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """Actual (call_id, def_id, ordinal) to formal (def_id, ordinal) arguments; surplus actual ones are dropped."""
    return actuals.join(formals, ["def_id", "ordinal"])


def return_edges(returns: DataFrame, calls: DataFrame) -> DataFrame:
    """Return statements (def_id, return_id) to the call sites of their function."""
    return returns.join(calls.select("def_id", "call_id"), "def_id")


def last_parallel(edges: DataFrame, order: str) -> DataFrame:
    """Of parallel edges the last one's attributes."""
    return edges.groupBy("grp", "src", "dst").agg(F.max_by("kind", order).alias("kind"))


def first_declaration(names: DataFrame, text: DataFrame) -> DataFrame:
    """The first line at or after a block's start (grp, name, block_line) whose text (grp, line, text) declares the name."""
    near = names.join(text, "grp").where((F.col("line") >= F.col("block_line")) & F.contains("text", "name"))
    return near.groupBy("grp", "name").agg(F.min("line").alias("line"))


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """grp, round, label for each node and round: a label is hashed with the sorted labels of the neighbours."""
    both = edges.select("grp", "src", "dst").unionByName(inverted(edges.select("grp", "src", "dst"))).distinct()
    at = nodes.select("grp", "node", "label")
    out = at.select("grp", F.lit(0).alias("round"), "label")
    for i in range(1, rounds + 1):
        near = both.join(at.withColumnRenamed("node", "dst"), ["grp", "dst"]).groupBy("grp", "src").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("near"))
        at = at.join(near.withColumnRenamed("src", "node"), ["grp", "node"], "left")
        at = written(at.select("grp", "node", F.md5(F.concat_ws("|", "label", F.coalesce("near", F.lit("")))).alias("label")), "wl")
        out = out.unionByName(at.select("grp", F.lit(i).alias("round"), "label"))
    return out


def wl_kernel(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of graph pairs: normalised dot product of label counts; two empty graphs are equal, one is unlike any."""
    counts = labels.groupBy("grp", "round", "label").agg(F.count("*").cast("double").alias("n"))
    own = counts.groupBy("grp").agg(F.sum(F.col("n") * F.col("n")).alias("own"))
    left, right = counts.toDF("a", "round", "label", "n"), counts.toDF("b", "round", "label", "m")
    both = pairs.join(left, "a").join(right, ["b", "round", "label"]).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    joined = pairs.join(both, ["a", "b"], "left").join(own.toDF("a", "own_a"), "a", "left").join(own.toDF("b", "own_b"), "b", "left")
    empty = F.col("own_a").isNull() & F.col("own_b").isNull()
    value = F.when(empty, 1.0).otherwise(F.coalesce(F.col("dot") / F.sqrt(F.col("own_a") * F.col("own_b")), F.lit(0.0)))
    return joined.select("a", "b", value.alias("similarity"))


def to_dot(edges: DataFrame) -> DataFrame:
    """grp, dot: boxes for nodes, red control and blue data edges."""
    color = F.when(F.col("kind") == "control", "red").otherwise("blue")
    line = F.format_string('  "%s" -> "%s" [color=%s];', F.col("src").cast("string"), F.col("dst").cast("string"), color)
    body = F.array_join(F.array_sort(F.collect_set(line)), "\n")
    return edges.groupBy("grp").agg(F.concat(F.lit("digraph {\n  node [shape=box];\n"), body, F.lit("\n}")).alias("dot"))

