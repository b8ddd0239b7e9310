"""Queries on differences, trees, patterns, groups and the batch pipelines. What SQL cannot express has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import diff
from patchloom.functions import text as T
from patchloom.functions.vectors import HashingEmbedder, embed
from patchloom.operators import clustering, dendrogram, graph, patterns
from patchloom.session import table, written

from . import models, repair

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns of a conversation as old and new text."""
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    return turns.select("conv_id", "turn", F.col("text").alias("old")).join(after, ["conv_id", "turn"])


#: Line ends of other kinds than the line feed, which the differ splits at and SQL does not.
_ENDS = r"[\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
_LINES = f"""l AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{_ENDS}', ' ', 'g'), '\\n$', ''), chr(10)) AS l FROM documents))"""


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, old: the lines of every text, each with its number in front, so that no two are equal."""
    lines = T.lines(F.regexp_replace("text", _ENDS, " "))
    return table(spark, d, "documents").select("doc_id", F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit("| "), x)).alias("lines"))


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Numbered texts and what an edit makes of them: some lines go, some change, after some comes a new one."""

    def edit(x, i):  # noqa: ANN001, ANN202
        own = F.when((i + 1) % 7 == 3, F.array().cast("array<string>")).when((i + 1) % 5 == 2, F.array(F.concat((i + 1).cast("string"), F.lit("| changed")))).otherwise(F.array(x))
        return F.when((i + 1) % 11 == 4, F.concat(own, F.array(F.concat(F.lit("new "), (i + 1).cast("string"))))).otherwise(own)

    rows = _numbered(spark, d)
    return rows.select("doc_id", F.array_join("lines", "\n").alias("old"), F.array_join(F.flatten(F.transform("lines", edit)), "\n").alias("new"))


@query(f"""
WITH {_LINES}, k AS (SELECT doc_id, i, i % 7 <> 3 AND i % 5 <> 2 AS kept, i % 7 <> 3 AND i % 5 = 2 AS changed, i % 11 = 4 AS grown FROM l),
g AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM k),
s AS (SELECT doc_id, gap, count(*) FILTER (changed OR grown) AS n_new FROM g GROUP BY ALL)
SELECT g.doc_id, coalesce(string_agg(CASE WHEN NOT kept AND n_new > 0 THEN i END, ',' ORDER BY i), '') AS modified, coalesce(string_agg(CASE WHEN NOT kept AND n_new = 0 THEN i END, ',' ORDER BY i), '') AS deleted,
       coalesce(string_agg(CASE WHEN NOT kept THEN i END, ',' ORDER BY i), '') AS touched, count(*) FILTER (changed)::BIGINT + count(*) FILTER (grown)::BIGINT AS added
FROM g JOIN s USING (doc_id, gap) GROUP BY g.doc_id
""")
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Changed line sets of every text under a known edit."""
    found = _edited(spark, d).select("doc_id", diff.changed_lines_udf("old", "new").alias("c"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    touched = F.array_sort(F.array_union("c.modified", "c.deleted"))
    return found.select("doc_id", text(F.col("c.modified")).alias("modified"), text(F.col("c.deleted")).alias("deleted"), text(touched).alias("touched"), F.size("c.added").cast("long").alias("added"))


@query("""
SELECT doc_id, ''::VARCHAR AS same_touched, 0::BIGINT AS same_added, '' AS gone_added, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))::BIGINT AS gone_deleted FROM documents
""")
def changed_lines_shortcuts(spark: SparkSession, d: str) -> DataFrame:
    """A text and itself, a text and nothing."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\r|\u0085| | |\x0b|\x0c|\x1c|\x1d|\x1e", " ").alias("text"))
    found = docs.select("doc_id", diff.changed_lines_udf("text", "text").alias("s"), diff.changed_lines_udf("text", F.lit("")).alias("g"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return found.select(
        "doc_id",
        text(F.array_union("s.modified", "s.deleted")).alias("same_touched"),
        F.size("s.added").cast("long").alias("same_added"),
        text(F.col("g.added")).alias("gone_added"),
        F.size("g.deleted").cast("long").alias("gone_deleted"),
    )


def _one_changed(spark: SparkSession, d: str) -> DataFrame:
    """Numbered texts with their middle line changed."""
    middle = F.floor(F.size("lines") / 2)
    new = F.transform("lines", lambda x, i: F.when(i == middle, F.lit("changed")).otherwise(x))
    return _numbered(spark, d).select("doc_id", F.array_join("lines", "\n").alias("old"), F.array_join(new, "\n").alias("new"))


_HUNK = f"""{_LINES}, p AS (SELECT *, 1 + n // 2 AS p, greatest(1, 1 + n // 2 - 3) AS s, least(n, 1 + n // 2 + 3) AS t FROM l)"""
_HEADER = "'@@ -' || any_value(s) || CASE WHEN any_value(t - s) = 0 THEN '' ELSE ',' || any_value(t - s + 1) END || ' +' || any_value(s) || CASE WHEN any_value(t - s) = 0 THEN '' ELSE ',' || any_value(t - s + 1) END || ' @@'"


@query(f"""
WITH {_HUNK} SELECT doc_id, '--- before' || chr(10) || '+++ after' || chr(10) || {_HEADER} || chr(10) ||
  string_agg(CASE WHEN i = p THEN '-' || i || '| ' || line || chr(10) || '+changed' ELSE ' ' || i || '| ' || line END, chr(10) ORDER BY i) FILTER (i BETWEEN s AND t) AS diff FROM p GROUP BY doc_id
""")
def unified_diff(spark: SparkSession, d: str) -> DataFrame:
    """Unified diff of every text with one line changed."""
    return _one_changed(spark, d).select("doc_id", diff.unified_udf("old", "new").alias("diff"))


@query(f"""
WITH {_HUNK} SELECT doc_id, '--- before' || chr(10) || chr(10) || '+++ after' || chr(10) || chr(10) || {_HEADER} || chr(10) || chr(10) ||
  string_agg(CASE WHEN i = p THEN '-' || i || '| ' || line || CASE WHEN i < n THEN chr(10) ELSE '' END || chr(10) || '+changed' ELSE ' ' || i || '| ' || line END || CASE WHEN i < n THEN chr(10) ELSE '' END, chr(10) ORDER BY i)
  FILTER (i BETWEEN s AND t) AS diff FROM p GROUP BY doc_id
""")
def unified_diff_doubled(spark: SparkSession, d: str) -> DataFrame:
    """T4: the same with line ends kept and doubled."""
    return _one_changed(spark, d).select("doc_id", diff.unified_doubled_udf("old", "new").alias("diff"))


@query(f"""
WITH {_HUNK} SELECT doc_id, string_agg(CASE WHEN i = p THEN '-' || i || '| ' || line || chr(10) || '+changed' ELSE ' ' || i || '| ' || line END, chr(10) ORDER BY i) FILTER (i BETWEEN greatest(s, p - 1) AND least(t, p + 1)) AS context
FROM p GROUP BY doc_id
""")
def diff_context(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines of a diff with their neighbours."""
    return unified_diff(spark, d).select("doc_id", diff.diff_context_udf("diff").alias("context"))


@query(f"""
WITH {_LINES} SELECT doc_id, CASE WHEN p = 0 THEN '1' WHEN p >= n THEN n::VARCHAR ELSE p || ',' || (p + 1) END AS places FROM (SELECT DISTINCT doc_id, n, doc_id % (n + 1) AS p FROM l)
""")
def insertion_points(spark: SparkSession, d: str) -> DataFrame:
    """Where one line was put into every text."""
    at = (F.col("doc_id") % (F.size("lines") + 1)).cast("int")
    rows = _numbered(spark, d).withColumn("new", F.concat(F.slice("lines", F.lit(1), at), F.array(F.lit("put in")), F.slice("lines", at + 1, F.size("lines"))))
    grown = rows.select("doc_id", diff.insertion_point_udf(F.array_join("lines", "\n"), F.array_join("new", "\n")).alias("at"))
    return grown.select("doc_id", F.array_join(F.col("at").cast("array<string>"), ",").alias("places"))


@query("SELECT doc_id, regexp_replace(text, '\\n(?:[ \\t]*\\n)+', chr(10) || chr(10), 'g') AS text FROM documents")
def blank_lines_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Runs of blank lines become one."""
    return table(spark, d, "documents").select("doc_id", T.collapse_blank_lines(F.col("text")).alias("text"))


@query(f"""
WITH {_LINES}, k AS (SELECT doc_id, i, i % 7 <> 3 AS here, i % 7 <> 3 AND i % 5 = 2 AS changed, i % 11 = 4 AS grown FROM l),
m AS (SELECT *, sum(here::INT + grown::INT) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM k),
a AS (SELECT doc_id, CASE WHEN grown THEN upto - 1 ELSE upto END AS p FROM m WHERE changed UNION ALL SELECT doc_id, upto FROM m WHERE grown),
s AS (SELECT doc_id, max(upto) AS n FROM m GROUP BY doc_id),
o AS (SELECT doc_id, max(p) FILTER (p % 2 = 0) AS even, max(p) FILTER (p % 2 = 1) AS odd FROM a GROUP BY doc_id)
SELECT doc_id, t.line::BIGINT AS line FROM o JOIN s USING (doc_id), LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS line) t WHERE (t.line % 2 = 0 AND t.line <= even) OR (t.line % 2 = 1 AND t.line <= odd)
""")
def changed_line_slice(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an edited text that its added lines depend on, if every line depends on the last but one."""
    rows = _edited(spark, d)
    seeds = rows.select(F.col("doc_id").alias("grp"), F.explode(diff.changed_lines_udf("old", "new")["added"]).alias("node"))
    lines = rows.select(F.col("doc_id").alias("grp"), F.posexplode(T.lines(F.col("new"))).alias("i", "text"))
    edges = lines.where("i >= 2").select("grp", (F.col("i") - 1).alias("src"), (F.col("i") + 1).alias("dst"))
    return graph.slices(edges, seeds, "backward").select(F.col("grp").alias("doc_id"), F.col("node").cast("long").alias("line"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'trigger_path' WHEN old <> new THEN 'diff' ELSE 'skipped_no_line_numbers' END AS method FROM (SELECT c.conv_id, c.turn, c.text AS old, n.text AS new FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)")
def line_source(spark: SparkSession, d: str) -> DataFrame:
    """Given lines before changed lines before insertion points."""
    rows = _pairs(spark, d).withColumn("c", diff.changed_lines_udf("old", "new")).withColumn("at", diff.insertion_point_udf("old", "new"))
    touched = F.array_union("c.modified", "c.deleted")
    method = F.when(F.col("turn") % 3 == 0, "trigger_path").when(F.size(touched) > 0, "diff").when(F.size("at") > 0, "insertion").otherwise("skipped_no_line_numbers")
    return rows.select("conv_id", "turn", method.alias("method"))


@query()
def agglomerative_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups within small problems: vectors of one label whose ids share their hundreds."""
    rows = table(spark, d, "embeddings").withColumn("problem", F.floor(F.col("vec_id") / 100))
    return clustering.group_vectors(rows, ["label", "problem"], "vec_id", "embedding")


@query("""
WITH v AS (SELECT vec_id // 3 AS problem, vec_id % 3 AS i, vec_id, embedding FROM embeddings),
s AS (SELECT a.problem, a.i AS i, b.i AS j, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
  / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS sim FROM v a JOIN v b ON a.problem = b.problem AND a.i < b.i),
m AS (SELECT problem, count(*) AS pairs, max_by(i * 10 + j, (sim, -i, -j)) AS pair, max(sim) AS sim FROM s GROUP BY problem)
SELECT vec_id, (CASE WHEN pairs = 3 AND pair = 12 AND m.sim >= 0 AND i > 0 THEN 1 ELSE 0 END)::BIGINT AS group_id FROM v LEFT JOIN m USING (problem)
""")
def triple_groups(spark: SparkSession, d: str) -> DataFrame:
    """Problems of three: the nearest two form a group, and what is left alone joins the largest group so far."""
    rows = table(spark, d, "embeddings").withColumn("problem", F.floor(F.col("vec_id") / 3))
    return clustering.group_vectors(rows, ["problem"], "vec_id", "embedding").select("vec_id", F.col("group_id").cast("long").alias("group_id"))


@query()
def patch_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns of a conversation grouped by their vectors; groups of two or more give a joint candidate."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", F.lit("plain").alias("strategy"), F.col("role").alias("cause"))
    grouped = clustering.group_vectors(rows.withColumn("v", embed(HashingEmbedder())(F.col("text"))), ["conv_id"], "turn", "v")
    return repair.synthesised(rows.join(grouped, ["conv_id", "turn"]), ["conv_id"], "turn", models.StandIn()).select("conv_id", "group_id", "size", "text", "strategy")


#: How tables of trees are written: their texts repeat each other, and of patterns this leaves a third of what the default does.
_SMALL = {"compression": "zstd"}


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return written(patterns.parse_pages(table(spark, d, "pages")), "trees", **_SMALL)


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(?:script|style)[^>]*>).*?</(?:script|style)>', '\1', 'g') AS html FROM pages),
t AS (SELECT page_id AS tree_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS type FROM h)
SELECT tree_id, type, count(*)::BIGINT AS n FROM t GROUP BY ALL
""")
def dom_tree_parse(spark: SparkSession, d: str) -> DataFrame:
    """Elements of every page by type."""
    elements = patterns.node_rows(_trees(spark, d)).where("type NOT IN ('document', 'text')")
    return elements.groupBy("tree_id", "type").agg(F.count("*").alias("n"))


@query()
def tree_anti_unify(spark: SparkSession, d: str) -> DataFrame:
    """Generalisation of neighbouring pages."""
    return patterns.generalised(patterns.consecutive(_trees(spark, d)))


@query()
def tree_edit_script(spark: SparkSession, d: str) -> DataFrame:
    """node map and changed nodes of neighbouring pages."""
    return patterns.edit_scripts(patterns.consecutive(_trees(spark, d)))


@query()
def pattern_match_apply(spark: SparkSession, d: str) -> DataFrame:
    """patterns of a pair applied to its first page and held against the second."""
    return patterns.mined_and_applied(written(patterns.consecutive(_trees(spark, d)), "pairs", **_SMALL))


def _mined(trees: DataFrame) -> DataFrame:
    return written(patterns.mine(patterns.consecutive(trees)), "patterns", **_SMALL)


@query()
def pattern_dendrogram(spark: SparkSession, d: str) -> DataFrame:
    """Dendrograms of edit patterns by root type."""
    return patterns.clustered(_mined(_trees(spark, d)), text=False)


@query()
def repair_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All stages over user turns, with the benchmark texts as knowledge."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    rows = turns.select(F.concat_ws("/", "conv_id", "turn").alias("row_id"), (F.col("conv_id") % 5).cast("int").alias("key"), F.col("text").alias("code"))
    texts = table(spark, d, "benchmark")
    base = texts.select(F.col("item_id").alias("vec_id"), embed(HashingEmbedder())(F.col("text")).alias("embedding"), (F.col("item_id") % 4).cast("int").alias("partition"), "text")
    return repair.with_status(rows, repair.run(rows, written(base, "knowledge")))


def _dendrogram(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.clustered(_mined(_trees(spark, d)), text=False)
    return written(found.withColumn("tree", F.concat_ws("/", "root_type", "block")), "dendrograms", **_SMALL)


@query()
def dendrogram_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Level and number of leaves of every node."""
    nodes = _dendrogram(spark, d)
    return dendrogram.counted(nodes.select("tree", "node", "left", "right"))


#: Matches in one tree beyond which a pattern is too general for it.
MOST_MATCHES = 2


@query()
def hierarchical_apply(spark: SparkSession, d: str) -> DataFrame:
    """Of each dendrogram's patterns that apply to a page, those at the deepest level, if they match it twice at most."""
    pages = _trees(spark, d)
    mined = _mined(pages)
    # the right side of no mined or merged pattern has unbound holes, so the left side tells what applies
    nodes = patterns.clustered(mined, left_id=True).withColumn("kind", F.concat_ws("/", "root_type", "block"))
    linked = nodes.select(F.col("kind").alias("tree"), "node", "left", "right")
    # a kind holds many dendrograms; the root tells them apart
    level = dendrogram.levels(linked).select(F.col("tree").alias("kind"), "node", "level", F.concat_ws("/", "tree", "root").alias("tree"))
    placed = written(nodes.select("kind", "node", "left_id").join(level, ["kind", "node"]), "placed", **_SMALL)
    targets = pages.select(F.col("tree_id").alias("target"), F.col("tree").alias("page"))
    lefts = mined.select("before").unionByName(nodes.where("before IS NOT NULL").select("before"))
    hits = written(patterns.left_hits(lefts, placed.select("left_id"), targets), "hits", **_SMALL)
    return patterns.deepest_hits(placed, hits, MOST_MATCHES)
