"""Queries on dependency graphs, with their SQL.

The graph of a user has the user's events as nodes. A data edge leads to the next event with the same remainder of k by 8, a
control edge from a signup or purchase to the next event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.operators import graph
from patchloom.session import table, written

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("grp"), "event_id", "ts", "event_type", (F.from_json("props", "k long")["k"] % 8).alias("k"))


def event_graph(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("data", "control")) -> DataFrame:
    ev = _events(spark, d)
    after = lambda *keys: F.lead("event_id").over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    data = ev.select("grp", F.col("event_id").alias("src"), after("grp", "k").alias("dst"), F.lit("data").alias("kind"))
    control = ev.select("grp", F.col("event_id").alias("src"), after("grp").alias("dst"), F.lit("control").alias("kind"), "event_type")
    control = control.where(F.col("event_type").isin("signup", "purchase")).drop("event_type")
    return data.unionByName(control).where(F.col("dst").isNotNull() & F.col("kind").isin(*kinds))


def event_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The first error of each user."""
    errors = _events(spark, d).where("event_type = 'error'")
    return errors.groupBy("grp").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("node"))


_GRAPH = """ev AS (SELECT user_id AS grp, event_id, ts, event_type, json_extract_string(props, '$.k')::BIGINT % 8 AS k FROM events),
g AS (SELECT * FROM (
  SELECT grp, event_id AS src, lead(event_id) OVER (PARTITION BY grp, k ORDER BY ts, event_id) AS dst, 'data' AS kind FROM ev
  UNION ALL SELECT grp, src, dst, 'control' FROM (SELECT grp, event_id AS src, lead(event_id) OVER (PARTITION BY grp ORDER BY ts, event_id) AS dst, event_type FROM ev) WHERE event_type IN ('signup', 'purchase'))
  WHERE dst IS NOT NULL),
seeds AS (SELECT grp, min_by(event_id, (ts, event_id)) AS node FROM ev WHERE event_type = 'error' GROUP BY grp)"""


@query(f"WITH {_GRAPH} SELECT grp, src, dst, kind FROM g")
def line_graph_build(spark: SparkSession, d: str) -> DataFrame:
    """The graph from node and edge tables, with unresolved ends and variables as a producer leaves them."""
    ev = _events(spark, d)
    nodes = ev.select("grp", F.concat(F.lit("n"), "event_id").alias("id"), F.col("event_id") + 1)
    nodes = nodes.toDF("grp", "id", "line")
    edges = event_graph(spark, d)
    edge = lambda c: F.concat(F.lit("n"), F.col(c)).alias({"src": "start", "dst": "end"}[c])
    etype = F.when(F.col("kind") == "data", "REACHES").otherwise("FLOWS_TO")
    program = edges.select("grp", edge("src"), edge("dst"), etype.alias("etype"), F.lit("v").alias("var"))
    dangling = edges.select("grp", edge("src"), F.lit("nowhere").alias("end"), F.lit("REACHES").alias("etype"), F.lit("v").alias("var"))
    built = graph.line_graph(nodes, program.unionByName(dangling))
    return built.select("grp", (F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), "kind")


@query(f"WITH {_GRAPH} SELECT DISTINCT grp, dst AS src, src AS dst FROM g")
def graph_inverted(spark: SparkSession, d: str) -> DataFrame:
    """Merged kinds, turned around."""
    return graph.inverted(graph.merged(event_graph(spark, d)))


def _walk(name: str, a: str, b: str, where: str = "") -> str:
    return f"{name} AS (SELECT grp, node FROM seeds UNION SELECT g.grp, g.{b} FROM {name} w JOIN g ON g.grp = w.grp AND g.{a} = w.node {where})"


def _slice_sql(*parts: str) -> str:
    walks = {"forward": _walk("f", "src", "dst"), "backward": _walk("b", "dst", "src")}
    names = {"forward": "f", "backward": "b"}
    return f"WITH RECURSIVE {_GRAPH}, {', '.join(walks[p] for p in parts)} " + " UNION ".join(f"SELECT grp, node FROM {names[p]}" for p in parts)


@query(_slice_sql("forward"))
def forward_slice(spark: SparkSession, d: str) -> DataFrame:
    """G4."""
    return graph.slices(event_graph(spark, d), event_seeds(spark, d), "forward")


@query(_slice_sql("backward"))
def backward_slice(spark: SparkSession, d: str) -> DataFrame:
    """G5."""
    return graph.slices(event_graph(spark, d), event_seeds(spark, d), "backward")


@query(_slice_sql("forward", "backward"))
def combined_slice(spark: SparkSession, d: str) -> DataFrame:
    """G6, U3."""
    return graph.slices(event_graph(spark, d), event_seeds(spark, d), "combined")


@query(f"WITH RECURSIVE {_GRAPH}, {_walk('f', 'src', 'dst', chr(65) + 'ND g.kind = ' + chr(39) + 'data' + chr(39))} SELECT f.grp, string_agg(node || ':' || event_type, chr(10) ORDER BY node) AS text FROM f JOIN ev ON event_id = node GROUP BY f.grp")
def data_slice_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of the data-only forward slice."""
    source = _events(spark, d).select("grp", F.col("event_id").alias("line"), F.concat_ws(":", "event_id", "event_type").alias("text"))
    return graph.slice_text(graph.slices(event_graph(spark, d, ("data",)), event_seeds(spark, d), "forward"), source)


_PURCHASES = "SELECT user_id AS grp, event_id AS node FROM events WHERE event_type IN ('purchase', 'error')"


def _some(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where(F.col("event_type").isin("purchase", "error")).select("grp", F.col("event_id").alias("node"))


@query(f"WITH {_GRAPH}, t AS ({_PURCHASES}) SELECT grp, src, dst, kind FROM g WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """J15, J16."""
    return graph.induced(event_graph(spark, d), _some(spark, d)).select("grp", "src", "dst", "kind")


@query(
    f"WITH {_GRAPH}, n AS (SELECT node FROM seeds UNION SELECT dst FROM g JOIN seeds s ON g.src = s.node UNION SELECT src FROM g JOIN seeds s ON g.dst = s.node) "
    "SELECT grp, src, dst, kind FROM g WHERE src IN (FROM n) AND dst IN (FROM n)"
)
def ego_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """J17."""
    return graph.ego(event_graph(spark, d), event_seeds(spark, d)).select("grp", "src", "dst", "kind")


@query(
    f"WITH {_GRAPH}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), h1 AS (SELECT DISTINCT grp, node AS start, dst AS node FROM seeds JOIN u ON src = node), "
    "h2 AS (SELECT DISTINCT grp, start, dst AS node FROM h1 JOIN u ON src = node) "
    "SELECT 'exact' AS mode, grp, start, node FROM h2 UNION ALL SELECT 'upto', * FROM (SELECT * FROM h1 UNION SELECT * FROM h2) WHERE start <> node"
)
def k_hop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Two hops, exactly and at most."""
    edges, seeds = event_graph(spark, d), event_seeds(spark, d)
    exact = graph.hops(edges, seeds, 2).withColumn("mode", F.lit("exact"))
    upto = graph.hops(edges, seeds, 2, cumulative=True).withColumn("mode", F.lit("upto"))
    return exact.unionByName(upto).select("mode", "grp", "start", "node")


@query("""
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'REF' WHEN 'view' THEN 'AST' WHEN 'purchase' THEN 'CDG' WHEN 'signup' THEN 'CFG' WHEN 'error' THEN 'REACHING_DEF' ELSE 'EVAL_TYPE' END AS t FROM events),
s(kind, t) AS (VALUES ('reftype', 'EVAL_TYPE'), ('reftype', 'REF'), ('ast', 'AST'), ('pdg', 'REACHING_DEF'), ('pdg', 'CDG'), ('ddg', 'REACHING_DEF'), ('cfgddg', 'REACHING_DEF'), ('cfgddg', 'CFG'), ('cfgcdg', 'CFG'), ('cfgcdg', 'CDG'),
  ('all', 'REACHING_DEF'), ('all', 'CDG'), ('all', 'AST'), ('all', 'EVAL_TYPE'), ('all', 'REF'), ('all', 'CFG'))
SELECT kind, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM e JOIN s USING (t) GROUP BY kind
""")
def edge_type_select(spark: SparkSession, d: str) -> DataFrame:
    """Every selector over edges typed by event."""
    kinds = {"click": "REF", "view": "AST", "purchase": "CDG", "signup": "CFG", "error": "REACHING_DEF"}
    etype = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("EVAL_TYPE"))
    edges = table(spark, d, "events").select("event_id", etype.alias("etype"))
    parts = [graph.select_edges(edges, k).withColumn("kind", F.lit(k)) for k in [*graph.EDGE_KINDS, "unknown"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""
WITH RECURSIVE n AS (SELECT event_id AS id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, CASE WHEN event_type = 'error' THEN event_id * 2 END AS line FROM events),
c AS (SELECT id, id AS at, 0 AS steps, line, parent FROM n UNION ALL SELECT c.id, n.id, c.steps + 1, n.line, n.parent FROM c JOIN n ON n.id = c.parent WHERE c.line IS NULL AND c.steps < 10)
SELECT id, line::BIGINT AS line, steps::BIGINT AS steps FROM c WHERE line IS NOT NULL
""")
def bounded_parent_climb(spark: SparkSession, d: str) -> DataFrame:
    """Line of the nearest ancestor that has one, within ten steps."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lag("event_id").over(by).alias("parent"), F.when(F.col("event_type") == "error", F.col("event_id") * 2).alias("line"))
    found = graph.climb(ev.select("id", "line"), ev.where("parent IS NOT NULL").select("id", "parent"))
    return found.select("id", "line", F.col("steps").cast("long").alias("steps"))


@query("""
WITH defs AS (SELECT p_brand AS name, max(p_partkey) AS def_id FROM part GROUP BY 1),
calls AS (SELECT l_orderkey, def_id, row_number() OVER (PARTITION BY l_orderkey, def_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ordinal
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN defs ON name = p_brand WHERE p_brand <> 'Brand#11'),
formals AS (SELECT def_id, unnest(range(0, 1 + def_id % 3)) AS ordinal FROM defs)
SELECT def_id, count(*)::BIGINT AS arguments, count(DISTINCT l_orderkey)::BIGINT AS calls, max(ordinal)::BIGINT AS last_ordinal FROM calls JOIN formals USING (def_id, ordinal) GROUP BY def_id
""")
def call_return_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order call the last part of their brand; arguments meet formals by position; returns go back."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    definitions = parts.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("def_id"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    calls = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).withColumnRenamed("p_brand", "name")
    resolved = graph.call_edges(calls, definitions, library=("Brand#11",)).withColumn("call", F.struct("l_orderkey", "def_id"))
    actuals = graph.ordered_children(resolved, "call", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    formals = graph.last_definitions(definitions).select("def_id", F.explode(F.sequence(F.lit(0), (F.col("def_id") % 3).cast("int"))).alias("ordinal"))
    bound = graph.argument_edges(actuals, formals)
    back = graph.return_edges(formals.select("def_id").distinct().withColumn("return_id", F.col("def_id")), bound.select("def_id", F.col("l_orderkey").alias("call_id"), "ordinal").distinct())
    calls_by_def = back.groupBy("def_id").agg(F.count_distinct("call_id").alias("calls"))
    counted = bound.groupBy("def_id").agg(F.count("*").alias("arguments"), F.max("ordinal").cast("long").alias("last_ordinal"))
    return counted.join(calls_by_def, "def_id").select("def_id", "arguments", "calls", "last_ordinal")


def _wl_sql() -> str:
    rounds = ["l0 AS (SELECT grp, event_id AS node, event_type AS label FROM ev)"]
    for i in range(1, 6):
        rounds.append(
            f"l{i} AS (SELECT l.grp, l.node, md5(any_value(l.label) || '|' || coalesce(string_agg(o.label, ',' ORDER BY o.label), '')) AS label "
            f"FROM l{i - 1} l LEFT JOIN u ON u.src = l.node LEFT JOIN l{i - 1} o ON o.node = u.dst GROUP BY l.grp, l.node)"
        )
    every = " UNION ALL ".join(f"SELECT grp, {i} AS r, label FROM l{i}" for i in range(6))
    return f"""WITH {_GRAPH}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), {', '.join(rounds)},
c AS (SELECT grp, r, label, count(*)::DOUBLE AS n FROM ({every}) GROUP BY ALL), o AS (SELECT grp, sum(n * n) AS own FROM c GROUP BY grp),
p AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM ev a JOIN ev b ON b.grp = a.grp + 1)
SELECT p.a, p.b, round(coalesce(sum(x.n * y.n), 0) / sqrt(any_value(oa.own) * any_value(ob.own)), 6) AS similarity
FROM p JOIN o oa ON oa.grp = p.a JOIN o ob ON ob.grp = p.b LEFT JOIN c x ON x.grp = p.a LEFT JOIN c y ON y.grp = p.b AND y.r = x.r AND y.label = x.label GROUP BY p.a, p.b"""


@query(_wl_sql())
def wl_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Kernel of the graphs of consecutive users."""
    nodes = _events(spark, d).select("grp", F.col("event_id").alias("node"), F.col("event_type").alias("label"))
    users = nodes.select(F.col("grp").alias("a")).distinct()
    pairs = users.join(users.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    found = graph.wl_kernel(graph.wl_labels(nodes, event_graph(spark, d)), pairs)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_GRAPH} SELECT grp, src, dst, max(kind) AS kind FROM g GROUP BY ALL")
def attributed_graph(spark: SparkSession, d: str) -> DataFrame:
    """One edge between two nodes, the later kind wins."""
    return graph.last_parallel(event_graph(spark, d), "kind")


@query(f"""WITH {_GRAPH} SELECT grp, 'digraph {{' || chr(10) || '  node [shape=box];' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}}' AS dot
FROM (SELECT DISTINCT grp, '  "' || src || '" -> "' || dst || '" [color=' || CASE kind WHEN 'control' THEN 'red' ELSE 'blue' END || '];' AS l FROM g) GROUP BY grp""")
def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    """DOT text of each graph."""
    return graph.to_dot(event_graph(spark, d))


@query("""
SELECT user_id AS grp, event_type AS name, min(event_id) AS line FROM events JOIN (SELECT user_id, min(event_id) AS block_line FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id)
WHERE event_id >= block_line GROUP BY ALL
""")
def first_declaration(spark: SparkSession, d: str) -> DataFrame:
    """First line at or after a block's start that names a variable."""
    ev = _events(spark, d)
    block = ev.where("event_type = 'error'").groupBy("grp").agg(F.min("event_id").alias("block_line"))
    names = ev.select("grp", F.col("event_type").alias("name")).distinct().join(block, "grp")
    return graph.first_declaration(names, ev.select("grp", F.col("event_id").alias("line"), F.col("event_type").alias("text")))


def _functions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A function per order, a formal per part of it: nodes (grp, id, label, code, line, ordinal) and edges (grp, start, end, etype)."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("grp"))
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), "l_partkey").agg(F.min("l_returnflag").alias("flag")).join(orders, "grp", "left_semi")
    node = lambda rows, id_, label, code, line, ordinal: rows.select("grp", F.expr(id_).alias("id"), F.lit(label).alias("label"), F.expr(code).alias("code"), F.expr(line).alias("line"), F.expr(ordinal).alias("ordinal"))
    nodes = [
        node(orders, "concat('f', grp)", "Function", "concat('run_', grp)", "grp + 1", "0L"),
        node(orders, "concat('d', grp)", "FunctionDef", "''", "grp + 1", "0L"),
        node(orders, "concat('l', grp)", "ParameterList", "''", "grp + 1", "0L"),
        node(parts, "concat('p', grp, '/', l_partkey)", "Parameter", "''", "grp + 2", "l_partkey"),
        node(parts, "concat('n', grp, '/', l_partkey)", "Identifier", "concat('a', l_partkey)", "grp + 2", "0L"),
        node(parts, "concat('t', grp, '/', l_partkey)", "ParameterType", "flag", "grp + 2", "1L"),
    ]
    edge = lambda rows, a, b, etype="IS_AST_PARENT": rows.select("grp", F.expr(a).alias("start"), F.expr(b).alias("end"), F.lit(etype).alias("etype"))
    edges = [
        edge(orders, "concat('f', grp)", "concat('d', grp)", "IS_FUNCTION_OF_AST"),
        edge(orders, "concat('d', grp)", "concat('l', grp)"),
        edge(parts, "concat('l', grp)", "concat('p', grp, '/', l_partkey)"),
        edge(parts, "concat('p', grp, '/', l_partkey)", "concat('n', grp, '/', l_partkey)"),
        edge(parts, "concat('p', grp, '/', l_partkey)", "concat('t', grp, '/', l_partkey)"),
    ]
    return written(reduce(DataFrame.unionByName, nodes), "nodes"), written(reduce(DataFrame.unionByName, edges), "edges")


@query("""
WITH p AS (SELECT l_orderkey, l_partkey, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS grp, 'run_' || o_orderkey AS name, o_orderkey + 1 AS line, CASE WHEN l_partkey IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey) - 1 END AS ordinal, 'a' || l_partkey AS formal, flag AS type
FROM orders LEFT JOIN p ON l_orderkey = o_orderkey
""")
def function_table(spark: SparkSession, d: str) -> DataFrame:
    """Functions with entry line and ordered formals."""
    found = graph.function_table(*_functions(spark, d))
    return found.select("grp", "name", "line", F.col("ordinal").cast("long").alias("ordinal"), "formal", "type")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS grp, l_partkey FROM lineitem), t AS (SELECT p.*, p_brand FROM p JOIN part ON p_partkey = l_partkey),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY l_partkey) AS i FROM t)
SELECT grp, 'v' || lpad(l_partkey::VARCHAR, 8, '0') AS name, p_brand AS type, (grp % 3)::BIGINT AS block_line, CASE WHEN i >= grp % 3 THEN i END::BIGINT AS declared FROM n
""")
def local_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Type of every local variable over two hops, line of its block, and the first line from there on that names it."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_partkey").distinct().join(parts, "l_partkey")
    rows = written(rows.withColumn("name", F.concat(F.lit("v"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))), "locals")
    node = lambda df, id_, label, name, line: df.select("grp", F.expr(id_).alias("id"), F.lit(label).alias("label"), F.expr(name).alias("name"), F.expr(line).alias("line"))
    nodes = node(rows, "concat('l', l_partkey)", "LOCAL", "name", "CAST(NULL AS BIGINT)").unionByName(node(rows.select("grp", "brand").distinct(), "concat('t', brand)", "TYPE", "brand", "CAST(NULL AS BIGINT)"))
    nodes = nodes.unionByName(node(rows.select("grp").distinct(), "'b'", "BLOCK", "''", "grp % 3")).unionByName(node(rows, "concat('i', l_partkey)", "IDENTIFIER", "name", "1L"))
    edge = lambda a, b, etype: rows.select("grp", F.expr(a).alias("start"), F.expr(b).alias("end"), F.lit(etype).alias("etype"))
    edges = edge("concat('i', l_partkey)", "concat('l', l_partkey)", "REF").unionByName(edge("concat('i', l_partkey)", "concat('t', brand)", "EVAL_TYPE")).unionByName(edge("'b'", "concat('l', l_partkey)", "AST"))
    found = written(graph.local_types(nodes, edges), "typed")
    source = rows.select("grp", F.row_number().over(Window.partitionBy("grp").orderBy("l_partkey")).cast("long").alias("line"), F.concat_ws(" ", "brand", "name").alias("text"))
    at = graph.first_declaration(found.select("grp", "name", "block_line"), source).withColumnRenamed("line", "declared")
    return found.join(at, ["grp", "name"], "left").select("grp", "name", "type", "block_line", "declared")


@query(f"WITH RECURSIVE {_GRAPH}, {_walk('f', 'src', 'dst')} SELECT grp, 'n' || node AS node FROM f")
def node_reach(spark: SparkSession, d: str) -> DataFrame:
    """Reachability over node names rather than lines."""
    name = lambda c: F.concat(F.lit("n"), F.col(c)).alias(c)
    edges = event_graph(spark, d).select("grp", name("src"), name("dst"))
    return graph.reachable(edges, event_seeds(spark, d).select("grp", name("node")))
