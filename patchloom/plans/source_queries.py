"""Queries that pass through sources and sinks, and plain controls on the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.operators import graph, vector_search
from patchloom.session import shared_dir, table
from patchloom.sources import readers, sinks
from patchloom.streaming import changes

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey AS a, p_name AS b, p_brand AS c FROM part")
def normalize_headers_ids(spark: SparkSession, d: str) -> DataFrame:
    """Headers by position and a dense id."""
    return readers.normalise_headers(table(spark, d, "part"), ["a", "b", "c"], ["a"])


@query("SELECT conv_id || '/' || turn AS cve_id, text AS code_before, role AS code_after, NULL::VARCHAR AS trigger_path FROM conversations")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with line feeds and quotes through CSV; an absent optional column is null."""
    out = _folder(spark, "csv")
    sinks.write_csv(table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("cve_id"), F.col("text").alias("code_before"), F.col("role").alias("code_after")), out)
    return readers.read_csv(spark, out, required=("code_before", "code_after"), optional=("trigger_path",))


@query("SELECT label, vec_id, len(embedding)::BIGINT AS dimensions FROM embeddings WHERE label = 3")
def knowledge_partition(spark: SparkSession, d: str) -> DataFrame:
    """A knowledge base by partition; one partition is read."""
    out = _folder(spark, "knowledge")
    sinks.write_knowledge_base(table(spark, d, "embeddings").withColumn("top_parent_cwe", F.concat(F.lit("P"), "label")), out)
    return readers.read_knowledge_base(spark, out, "P3").select("label", "vec_id", F.size("embedding").cast("long").alias("dimensions"))


@query("""
SELECT part, count(*)::BIGINT AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'click_x' WHEN 'view' THEN NULL WHEN 'error' THEN 'err_or' ELSE event_type END AS part FROM events) WHERE part IS NOT NULL GROUP BY 1
""")
def split_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """K2: a folder per value; nulls are left out, slashes become underscores."""
    out = _folder(spark, "by-parent")
    kind = F.when(F.col("event_type") == "click", "click/x").when(F.col("event_type") == "error", "err\\or").when(F.col("event_type") != "view", F.col("event_type"))
    sinks.write_by_parent(table(spark, d, "events").withColumn("kind", kind), "kind", out)
    return spark.read.options(header=True, escape='"').csv(out).groupBy("part").agg(F.count("*").alias("n"))


_UNION = "SELECT 'item' AS kind, item_id AS id, text, NULL::VARCHAR AS name FROM benchmark UNION ALL SELECT 'nation', n_nationkey, NULL, n_name FROM nation UNION ALL SELECT 'region', r_regionkey, NULL, r_name FROM region WHERE r_regionkey = 0"


@query(_UNION)
def union_json_sources(spark: SparkSession, d: str) -> DataFrame:
    """JSON arrays and an object from several files, one of which is missing, one after the other."""
    out = _folder(spark, "json")
    items = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    nations = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    region = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("region").alias("kind"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    sinks.write_json_array(items, f"{out}/items")
    sinks.write_json_array(nations, f"{out}/nations")
    region.coalesce(1).write.json(f"{out}/region")
    read = readers.read_json_records(spark, [f"{out}/{n}" for n in ("items", "missing", "nations", "region")])
    return read.select("kind", F.col("id").cast("long").alias("id"), "text", "name")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_orderkey::VARCHAR AS code_before, o_orderpriority AS code_after, 'c' || o_custkey AS focus FROM orders ORDER BY o_orderkey LIMIT 501")
def positional_csv(spark: SparkSession, d: str) -> DataFrame:
    """S3: headerless columns by position, rows up to an index over all files."""
    out = _folder(spark, "positional")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderpriority").alias("b"), F.concat(F.lit("c"), "o_custkey").alias("c"), "o_orderkey")
    rows.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey").write.options(header=False, escape='"').csv(out)
    return readers.read_positional(spark, out, last_index=500)


@query("SELECT p_partkey::VARCHAR AS _c0, p_name AS _c1, p_brand AS _c2 FROM part")
def headerless_scan(spark: SparkSession, d: str) -> DataFrame:
    """A headerless CSV file."""
    out = _folder(spark, "headerless")
    table(spark, d, "part").select(F.col("p_partkey").cast("string"), "p_name", "p_brand").write.options(header=False, escape='"').csv(out)
    return readers.read_csv(spark, out, header=False)


@query("""
WITH ev AS (SELECT event_id, user_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events)
SELECT user_id::VARCHAR AS grp, event_id + 1 AS src, next + 1 AS dst, CASE WHEN event_type = 'click' THEN 'control' ELSE 'data' END AS kind FROM ev WHERE next IS NOT NULL AND event_type <> 'view'
""")
def graph_tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated nodes and edges to a line graph; unset variables, lines and ends drop out."""
    out = _folder(spark, "graph")
    by = Window.partitionBy("user_id").orderBy("event_id")
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", F.lead("event_id").over(by).alias("next"))
    location = F.when(F.col("event_id") % 2 == 0, F.concat((F.col("event_id") + 1).cast("string"), F.lit(":7:0")))
    nodes = ev.select(
        F.col("event_id").alias("key"), F.col("event_type").alias("type"), F.lit("x = 1;").alias("code"), location.alias("location"),
        F.when(location.isNull(), F.col("event_id") + 1).alias("lineNumber"), F.col("user_id").alias("functionId"), F.lit(0).alias("childNum"),
    )
    etype = F.when(F.col("event_type") == "click", "FLOWS_TO").when(F.col("event_type") == "view", "REACHING_DEF").otherwise("REACHES")
    edges = ev.select(F.col("event_id").alias("start"), F.coalesce("next", F.lit(-1)).alias("end"), etype.alias("type"), F.when(F.col("event_type") != "view", "v").alias("var"))
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.options(header=True, sep="\t").csv(f"{out}/{name}")
    vertices, links = readers.read_graph(spark, f"{out}/nodes", f"{out}/edges")
    own = vertices.select(F.col("function").alias("grp"), "id", F.col("line").cast("long").alias("line"))
    return graph.line_graph(own, links.join(own.select("grp", F.col("id").alias("start")), "start").select("grp", "start", "end", "etype", "var"))


@query("SELECT 'full' AS part, doc_id, lang, source FROM documents UNION ALL SELECT 'summary', doc_id, NULL, source FROM documents")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    """Full results and their projection as JSON, read back."""
    out = _folder(spark, "results")
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    sinks.write_results(rows, rows.select("doc_id", "source"), out)
    read = lambda part: spark.read.json(f"{out}/{part}").withColumn("part", F.lit(part))
    return read("full").unionByName(read("summary"), allowMissingColumns=True).select("part", "doc_id", "lang", "source")


@query("SELECT conv_id, turn, text FROM conversations WHERE turn > 0")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """A JSON line per row; a second run leaves nothing of the first."""
    out = _folder(spark, "lines")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    sinks.write_lines(rows, out)
    sinks.write_lines(rows.where("turn > 0"), out)
    return spark.read.schema(rows.schema).json(out)


@query("SELECT event_id::VARCHAR AS event_id, (event_id % 3)::VARCHAR AS hits FROM events WHERE event_id % 3 > 0 OR event_id % 5 = 0")
def hits_csv(spark: SparkSession, d: str) -> DataFrame:
    """K9: rows with a candidate or a success, as CSV."""
    out = _folder(spark, "hits")
    sinks.write_hits(table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("hits"), (F.col("event_id") % 5 == 0).alias("exact")), out)
    return readers.read_csv(spark, out, required=("event_id", "hits", "exact")).select("event_id", "hits")


@query("SELECT 'candidate-' || item_id AS name, text FROM benchmark")
def candidate_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file per candidate, under its name, line feeds and all."""
    out = _folder(spark, "candidates")
    sinks.write_texts(table(spark, d, "benchmark").select(F.concat(F.lit("candidate-"), "item_id").alias("name"), "text"), "name", "text", out)
    read = spark.read.text(out, wholetext=True)
    return read.select("name", F.regexp_replace("value", "\n$", "").alias("text"))


@query("""
SELECT query_id, vec_id, round(distance, 6) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM (
  SELECT q.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance
  FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0)) WHERE place <= 3
""")
def flat_index_search(spark: SparkSession, d: str) -> DataFrame:
    """An unpartitioned index written, loaded and searched; lengths are checked."""
    out = _folder(spark, "flat")
    sinks.write_flat_index(table(spark, d, "embeddings").select("vec_id", "embedding"), out)
    base = readers.read_flat_index(spark, out)
    asked = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.lit(0).alias("key"))
    found = vector_search.search(asked, base.withColumn("partition", F.lit(0)), 3)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("place"))


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS ids, 8::BIGINT AS dimensions, true AS inside, true AS spread, true AS repeats")
def synthetic_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Uniform vectors from a seed."""
    once, again = (readers.random_vectors(spark, 1000, 8, seed=3).withColumn("sum", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)) for _ in range(2))
    total = lambda df: df.agg(F.round(F.sum("sum"), 4).alias("total"))
    same = total(once).intersect(total(again)).agg((F.count("*") == 1).alias("repeats"))
    mean = F.avg(F.col("sum") / 8)
    one = once.agg(
        F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.max(F.size("embedding")).cast("long").alias("dimensions"),
        F.bool_and(F.forall("embedding", lambda x: (x >= 0) & (x < 1))).alias("inside"), ((mean > 0.45) & (mean < 0.55)).alias("spread"),
    )
    return one.join(same.withColumn("k", F.lit(1)), F.lit(1) == F.col("k")).drop("k")


@query("SELECT event_id, event_type, value >= 50 AS high FROM events")
def stream_row_map(spark: SparkSession, d: str) -> DataFrame:
    """K4 as a stream: every event once through a row-local step."""
    out = _folder(spark, "stream")
    events = table(spark, d, "events")
    source = _folder(spark, "arrivals")
    events.write.parquet(source)
    stream = changes.changes(spark, source, ", ".join(f"{n} {t}" for n, t in events.dtypes))
    step = lambda s: s.select("event_id", "event_type", (F.col("value") >= 50).alias("high"))
    changes.process(stream, step, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.value >= 95 AND f.user_id = e.user_id AND f.event_type = e.event_type)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do of keys not done yet."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return sinks.pending(events, events.where("value >= 95").select("user_id", "event_type").distinct(), ["user_id", "event_type"]).select("event_id")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def control_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """A control on the star schema, not an operator of its own."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def control_revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A control: joins of the star schema."""
    c, o, li, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
