"""Queries on vectors and category trees, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import vectors as V
from patchloom.functions.text import word_tokens
from patchloom.operators import taxonomy, vector_search
from patchloom.session import shared_dir, table
from patchloom.sources import readers, sinks

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _search(spark: SparkSession, d: str, key) -> DataFrame:  # noqa: ANN001
    rows = table(spark, d, "embeddings")
    base = rows.select("vec_id", "embedding", F.col("label").alias("partition"))
    # the stated query set of a search: every id divisible by 100
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), key.cast("int").alias("key"))
    found = vector_search.search(asked, base, 5)
    return found.select("query_id", "vec_id", "partition", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _search_sql(match: str) -> str:
    return f"""
SELECT query_id, vec_id, partition, round(distance, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, b.vec_id, b.label AS partition,
           list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance
    FROM embeddings q JOIN embeddings b ON {match} WHERE q.vec_id % 100 = 0))
WHERE rank <= 5
"""


@query(_search_sql("q.label = b.label"))
def vector_topk_routed(spark: SparkSession, d: str) -> DataFrame:
    """Search in the partition that the query's key names."""
    return _search(spark, d, F.col("label"))


@query(_search_sql("true"))
def vector_topk_global(spark: SparkSession, d: str) -> DataFrame:
    """V2: k per partition, merged to k."""
    return _search(spark, d, F.lit(None))


@query(_search_sql("q.label = b.label OR q.vec_id % 200 = 0"))
def vector_topk_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every second query names an unknown partition and searches all of them."""
    return _search(spark, d, F.when(F.col("vec_id") % 200 == 0, -1).otherwise(F.col("label")))


@query("""
SELECT label, count(*)::BIGINT AS n, max(len(embedding))::BIGINT AS dimensions, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm
FROM embeddings GROUP BY label
""")
def kb_build_counts(spark: SparkSession, d: str) -> DataFrame:
    """V1, A1: rows, dimensions and mean norm of each partition."""
    return table(spark, d, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dimensions"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm")
    )


@query("""
SELECT e.vec_id, f.vec_id AS other_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, f.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS distance,
  round(list_sum(list_transform(list_zip(e.embedding, f.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(f.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine
FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1
""")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance and cosine of neighbouring vectors."""
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    pairs = a.join(b, a["vec_id"] + 1 == b["other_id"])
    x, y = F.col("embedding"), F.col("other")
    return pairs.select("vec_id", "other_id", F.round(V.l2(x, y), 6).alias("distance"), F.round(V.cosine(x, y), 6).alias("cosine"))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"""
WITH t AS (SELECT conv_id, turn, token, count(*)::DOUBLE AS tf FROM (SELECT conv_id, turn, unnest({_TOKENS}) AS token FROM conversations) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(tf * tf) AS sq FROM t GROUP BY ALL),
m AS (SELECT a.conv_id, a.turn, sum(a.tf * b.tf) AS dot, sum(a.tf * a.tf) AS sa, sum(b.tf * b.tf) AS sb FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.token = b.token GROUP BY ALL)
SELECT c.conv_id, c.turn, round(coalesce(m.dot / sqrt((1 + ln(1.5)) ** 2 * a.sq - ((1 + ln(1.5)) ** 2 - 1) * m.sa) / sqrt((1 + ln(1.5)) ** 2 * b.sq - ((1 + ln(1.5)) ** 2 - 1) * m.sb), 0), 6) AS similarity
FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
LEFT JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn LEFT JOIN s a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN s b ON b.conv_id = c.conv_id AND b.turn = c.turn + 1
""")
def tfidf_pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    """V7: TF-IDF cosine of consecutive turns, fitted on the two alone.

    In two texts, a token of both weighs 1 and a token of one weighs 1 + ln 1.5, so the norms follow from sums over all and
    over shared tokens, and only shared tokens are joined.
    """
    turns = table(spark, d, "conversations")
    w = (1 + F.log(F.lit(1.5))) * (1 + F.log(F.lit(1.5)))
    tf = turns.select("conv_id", "turn", F.explode(word_tokens(F.col("text"))).alias("token")).groupBy("conv_id", "turn", "token").agg(F.count("*").cast("double").alias("tf"))
    sq = tf.groupBy("conv_id", "turn").agg(F.sum(F.col("tf") * F.col("tf")).alias("sq"))
    after = tf.select("conv_id", (F.col("turn") - 1).alias("turn"), "token", F.col("tf").alias("tf2"))
    both = tf.join(after, ["conv_id", "turn", "token"]).groupBy("conv_id", "turn").agg(
        F.sum(F.col("tf") * F.col("tf2")).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("sa"), F.sum(F.col("tf2") * F.col("tf2")).alias("sb")
    )
    pairs = turns.select("conv_id", "turn").join(turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"])
    joined = pairs.join(both, ["conv_id", "turn"], "left").join(sq, ["conv_id", "turn"], "left")
    joined = joined.join(sq.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("sq").alias("sq2")), ["conv_id", "turn"], "left")
    value = F.col("dot") / F.sqrt(w * F.col("sq") - (w - 1) * F.col("sa")) / F.sqrt(w * F.col("sq2") - (w - 1) * F.col("sb"))
    return joined.select("conv_id", "turn", F.round(F.coalesce(value, F.lit(0.0)), 6).alias("similarity"))


@query(f"""
SELECT a.vec_id, b.vec_id AS other_id, round(0.4 * cosine + 0.2 * (a.label = b.label)::INT + 0.4 * (1 - abs(a.label - b.label) / 10.0), 6) AS similarity, round(1 - (0.4 * cosine + 0.2 * (a.label = b.label)::INT + 0.4 * (1 - abs(a.label - b.label) / 10.0)), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN ({ORACLE["vector_distances"]}) v ON v.vec_id = a.vec_id
""")
def weighted_similarity(spark: SparkSession, d: str) -> DataFrame:
    """V8: blend of three similarities, and its complement."""
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    same = (F.col("label") == F.col("other_label")).cast("int")
    near = 1 - F.abs(F.col("label") - F.col("other_label")) / 10.0
    value = V.blended(F.round(V.cosine(F.col("embedding"), F.col("other")), 6), same, near)
    return a.join(b, "vec_id").select("vec_id", (F.col("vec_id") + 1).alias("other_id"), F.round(value, 6).alias("similarity"), F.round(1 - value, 6).alias("distance"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        table(spark, d, "region").select(node("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")),
        table(spark, d, "nation").select(node("N", "n_nationkey").alias("node"), node("R", "n_regionkey").alias("parent")),
        table(spark, d, "customer").select(node("C", "c_custkey").alias("node"), node("N", "c_nationkey").alias("parent")),
        table(spark, d, "supplier").select(node("S", "s_suppkey").alias("node"), node("N", "s_nationkey").alias("parent")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_TREE_SQL = """WITH RECURSIVE e AS (
  SELECT 'R' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
p AS (SELECT node, [node] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.node, list_append(p.path, e.node) FROM p JOIN e ON e.parent = p.node)
"""


@query(_TREE_SQL + "SELECT node, array_to_string(path, '<>') AS path, path[1] AS root, path[-2] AS father, len(path)::BIGINT AS depth FROM p")
def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, root, father and depth of each node."""
    p = F.col("path")
    father = F.when(F.size(p) > 1, F.element_at(p, -2))
    return taxonomy.closure(_tree(spark, d)).select("node", taxonomy.path_text(p).alias("path"), F.element_at(p, 1).alias("root"), father.alias("father"), F.size(p).cast("long").alias("depth"))


@query(_TREE_SQL + "SELECT node, count(*)::BIGINT AS n FROM (SELECT unnest(path) AS node FROM p) GROUP BY node")
def taxonomy_subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    """A5: nodes at or below each node."""
    return taxonomy.subtree_counts(taxonomy.closure(_tree(spark, d)))


@query(
    _TREE_SQL
    + """SELECT event_id, coalesce(path[1], CASE WHEN k = 'M1' THEN k END, 'CWE-0') AS top_parent
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'C' || user_id WHEN 1 THEN 'M' || (event_id % 3) WHEN 2 THEN NULL ELSE 'N' || (user_id % 30) END AS k FROM events) LEFT JOIN p ON p.node = k"""
)
def taxonomy_route_default(spark: SparkSession, d: str) -> DataFrame:
    """Routing of known, unknown, main-class and null keys."""
    k = F.expr("CASE event_id % 4 WHEN 0 THEN concat('C', user_id) WHEN 1 THEN concat('M', event_id % 3) WHEN 2 THEN NULL ELSE concat('N', user_id % 30) END")
    rows = table(spark, d, "events").select("event_id", k.alias("k"))
    return taxonomy.route(rows, "k", taxonomy.closure(_tree(spark, d)), main=("M1",)).select("event_id", "top_parent")


@query("""
WITH b AS (SELECT p_brand || '/' || p_type || '/' || p_size AS class, p_brand || '/' || p_type AS up1, p_brand AS up2, count(*) AS n FROM part GROUP BY ALL),
t AS (SELECT floor(count(*) / 60)::BIGINT AS least FROM part),
r1 AS (SELECT *, CASE WHEN n < least THEN up1 ELSE class END AS f1 FROM b, t),
r2 AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY f1) < least THEN CASE WHEN f1 = class THEN up1 ELSE up2 END ELSE f1 END AS f2 FROM r1),
r3 AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY f2) < least THEN CASE WHEN f2 = up1 THEN up2 WHEN f2 = up2 THEN 'all' ELSE f2 END ELSE f2 END AS f3 FROM r2),
r4 AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY f3) < least THEN CASE WHEN f3 = up1 THEN up2 WHEN f3 = up2 THEN 'all' ELSE f3 END ELSE f3 END AS f4 FROM r3)
SELECT f4 AS final, sum(n)::BIGINT AS n FROM r4 GROUP BY 1
""")
def rare_class_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Rare kinds of parts join their type, rare types their brand, rare brands all, to a fixpoint."""
    parts = table(spark, d, "part").select("p_brand", F.concat_ws("/", "p_brand", "p_type").alias("type"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("class"))
    counts = parts.groupBy("class").agg(F.count("*").alias("n"))
    edges = parts.select("class", F.col("type").alias("parent")).unionByName(parts.select(F.col("type").alias("class"), F.col("p_brand").alias("parent")))
    edges = edges.unionByName(parts.select(F.col("p_brand").alias("class"), F.lit("all").alias("parent"))).distinct()
    final = taxonomy.roll_up_rare(counts, edges, parts.count() // 60)
    return counts.join(final, "class").groupBy("final").agg(F.sum("n").alias("n"))


@query("SELECT n_chars_class, count(*)::BIGINT AS n FROM (SELECT n_chars // 1000 AS n_chars_class FROM documents) GROUP BY 1")
def frequency_table(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies, ascending."""
    return table(spark, d, "documents").groupBy(F.floor(F.col("n_chars") / 1000).alias("n_chars_class")).agg(F.count("*").alias("n")).orderBy("n")


@query("""
SELECT conv_id, turn, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS keyword_distance FROM (
  SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ')) AS b FROM conversations) WHERE b IS NOT NULL
""")
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    """U4: set overlap of consecutive turns' words."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("after", after).where("after IS NOT NULL")
    words = lambda c: F.array_distinct(F.split(c, " "))
    return rows.select("conv_id", "turn", F.round(1 - V.jaccard(words("text"), words("after")), 6).alias("keyword_distance"))


@query(f"""
SELECT query_id, vec_id, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, vec_id) AS place FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (
      SELECT q.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score, (b.vec_id * 37 % 101)::BIGINT AS second
      FROM embeddings q JOIN embeddings b ON q.label = b.label WHERE q.vec_id % 100 = 0)) WHERE n <= 50)) WHERE place <= 10
""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fifty best by one score, ten of these by another."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    pairs = asked.join(rows, "label").select("query_id", "vec_id", F.round(V.dot(F.col("query"), F.col("embedding")), 6).alias("score"), (F.col("vec_id") * 37 % 101).alias("second"))
    return vector_search.reranked(pairs, ["query_id"], "score", "second", "vec_id").select("query_id", "vec_id", F.col("rank").cast("long").alias("place"))


_HASHES = """w AS (SELECT doc_id, source, list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w),
h AS (SELECT doc_id, ('0x' || left(md5(feature), 8))::BIGINT AS h FROM f),
v AS (SELECT doc_id, h // 2 % 64 AS place, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
s AS (SELECT doc_id, count(*) FILTER (x <> 0) AS filled, count(*) FILTER (x > 0) AS positive, max_by(place, (abs(x), -place)) FILTER (x <> 0) AS largest, sum(x * x) AS square, max(abs(x)) AS top FROM v GROUP BY doc_id)"""


@query(f"""WITH {_HASHES} SELECT w.doc_id, source AS partition, coalesce(filled, 0)::BIGINT AS filled, coalesce(positive, 0)::BIGINT AS positive, largest::BIGINT AS largest, round(top / sqrt(square), 4) AS height
FROM w LEFT JOIN s USING (doc_id) WHERE len(w.w) > 0""")
def kb_build(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base of all texts that are not blank, embedded, partitioned, written and read back."""
    out = f"{shared_dir(spark)}/base-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select("doc_id", "text", "source")
    base = vector_search.build_base(rows, F.col("text"), V.embed(V.HashingEmbedder())(F.col("text")), F.col("source"))
    sinks.write_knowledge_base(base.select("doc_id", "embedding", F.col("partition").alias("top_parent_cwe")), out)
    read = readers.read_knowledge_base(spark, out)
    e = F.transform("embedding", lambda x: x.cast("double"))
    height = F.array_max(F.transform(e, lambda x: F.abs(x)))
    filled = F.size(F.filter(e, lambda x: x != 0)).cast("long")
    largest = F.when(height > 0, F.array_position(F.transform(e, lambda x: F.abs(x) == height), True) - 1)
    return read.select(
        "doc_id", F.col("top_parent_cwe").alias("partition"), filled.alias("filled"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), largest.alias("largest"),
        F.when(height > 0, F.round(height, 4)).alias("height"),
    )


@query("""
WITH p AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE vec_id % 3 <> 0)
SELECT label, i::BIGINT AS i, round(avg(x::DOUBLE), 6) AS mean FROM p GROUP BY ALL
""")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the vectors that a mask leaves, for each label."""
    pooled = vector_search.masked_mean(table(spark, d, "embeddings").withColumn("mask", F.col("vec_id") % 3 != 0), ["label"], "embedding", "mask")
    rows = pooled.select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("mean"))


_STEP = "SELECT {prev}.user_id, {prev}.path || '>' || t.b AS path, t.b AS here, {prev}.score + t.w AS score FROM {prev} JOIN t ON t.user_id = {prev}.user_id AND t.a = {prev}.here WHERE {prev}.here <> 'error' UNION ALL SELECT * FROM {prev} WHERE here = 'error'"


def _beam_sql() -> str:
    steps = ["b0 AS (SELECT DISTINCT user_id, 'signup' AS path, 'signup' AS here, 0::BIGINT AS score FROM events)"]
    for i in (1, 2, 3):
        steps.append(f"s{i} AS ({_STEP.format(prev=f'b{i - 1}')})")
        steps.append(f"b{i} AS (SELECT user_id, path, here, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, path) AS n FROM s{i}) WHERE n <= 4)")
    return f"""WITH e AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
t AS (SELECT user_id, a, b, count(*) AS w FROM e WHERE b IS NOT NULL GROUP BY ALL), {', '.join(steps)} SELECT user_id, path, score::BIGINT AS score FROM b3"""


@query(_beam_sql())
def beam_search(spark: SparkSession, d: str) -> DataFrame:
    """The four best paths of three steps of each user; a path that met an error has ended."""
    ev = table(spark, d, "events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b"))
    moves = ev.where("b IS NOT NULL").groupBy("user_id", "a", "b").agg(F.count("*").alias("weight"))
    starts = ev.select("user_id").distinct().withColumn("at", F.lit("signup"))
    return vector_search.beam(starts, moves, ["user_id"], steps=3, width=4, end="error").select("user_id", F.array_join("path", ">").alias("path"), "score")
