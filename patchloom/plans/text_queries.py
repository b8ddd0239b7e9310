"""Queries on text scalars, filters, ranking and accounting, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import ranking
from patchloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""
SELECT doc_id, string_agg(i || ' | ' || line, chr(10) ORDER BY i) AS numbered, string_agg(lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, ' ') || ' | ' || line, chr(10) ORDER BY i) AS padded
FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents))
GROUP BY doc_id
""")
def line_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Both numbered forms of every text."""
    return table(spark, d, "documents").select("doc_id", T.number_lines(F.col("text")).alias("numbered"), T.number_lines(F.col("text"), 3).alias("padded"))


@query(r"""
SELECT doc_id, unnest(range(1, len(l) + 1))::BIGINT AS line_no, trim(regexp_replace(unnest(l), '//.*$', '')) AS line
FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents)
""")
def line_explode(spark: SparkSession, d: str) -> DataFrame:
    """A row per line without comment."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.strip_line_comments(F.col("text"))).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(r"""
SELECT doc_id, coalesce(string_agg(n || ': ' || l[n], chr(10) ORDER BY n), '') AS picked
FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents)
LEFT JOIN (VALUES (1), (3), (9), (100000)) v(n) ON n <= len(l) GROUP BY doc_id
""")
def line_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3, 1, 3, 9 and one out of range, of every text."""
    wanted = F.array(*[F.lit(x) for x in (3, 1, 3, 9, -2, 100000)], F.lit(None).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.pick_lines(F.col("text"), wanted).alias("picked"))


@query("""
SELECT doc_id, CASE WHEN b > 0 AND e > 0 THEN b ELSE 0 END::BIGINT AS modified, CASE WHEN b > 0 AND e = 0 THEN b ELSE 0 END::BIGINT AS deleted, e::BIGINT AS added,
       CASE WHEN b > 0 THEN a END::BIGINT AS first_old, CASE WHEN e > 0 THEN c + e - 1 END::BIGINT AS last_new
FROM (SELECT doc_id, doc_id + 1 AS a, n_chars % 4 AS b, doc_id + 3 AS c, (n_chars // 4) % 3 AS e FROM documents)
""")
def hunk_parse(spark: SparkSession, d: str) -> DataFrame:
    """T5: line sets of a hunk header made from each document's numbers; counts of 1 are left out of it."""
    b, e = F.col("n_chars") % 4, F.floor(F.col("n_chars") / 4) % 3
    part = lambda start, n: F.when(n == 1, start.cast("string")).otherwise(F.concat_ws(",", start.cast("string"), n.cast("string")))
    header = F.concat(F.lit("@@ -"), part(F.col("doc_id") + 1, b), F.lit(" +"), part(F.col("doc_id") + 3, e), F.lit(" @@"))
    rows = table(spark, d, "documents").select("doc_id", header.alias("header"))
    modified, deleted, added = T.hunk_lines(F.col("header"))
    return rows.select(
        "doc_id",
        F.size(modified).cast("long").alias("modified"),
        F.size(deleted).cast("long").alias("deleted"),
        F.size(added).cast("long").alias("added"),
        F.array_min(F.array_union(modified, deleted)).cast("long").alias("first_old"),
        F.array_max(added).cast("long").alias("last_new"),
    )


_MARKED = "'PATCH_DIFF_START:' || chr(10) || text || chr(10) || 'PATCH_DIFF_END:' || CASE WHEN turn % 2 = 0 THEN ' KEY_VARIABLES_START: ' || role || ', , ' || conv_id || ',x KEY_VARIABLES_END:' ELSE '' END"


@query(f"""
SELECT conv_id, turn, regexp_extract(m, '(?s)PATCH_DIFF_START:\\s*(.*?)\\s*PATCH_DIFF_END:', 1) AS patch,
       CASE WHEN turn % 2 = 0 THEN role || '|' || conv_id || '|x' END AS variables
FROM (SELECT conv_id, turn, role, {_MARKED} AS m FROM conversations)
""")
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    """Marked sections and a comma list, from answers composed of each turn."""
    rows = table(spark, d, "conversations").withColumn("m", F.expr(_MARKED.replace("chr(10)", "char(10)")))
    variables = T.comma_list(T.marked_section(F.col("m"), "KEY_VARIABLES"))
    return rows.select("conv_id", "turn", T.marked_section(F.col("m"), "PATCH_DIFF").alias("patch"), F.array_join(variables, "|").alias("variables"))


def _labelled(concat_char: str) -> str:
    parts = [f"CASE WHEN turn % 3 <> 2 THEN 'CWE-Specific Repair Strategy: a' || conv_id || {concat_char} ELSE '' END"]
    parts += [f"CASE WHEN turn % 3 = 0 THEN 'Pre-Repair State: b' || turn || {concat_char} || 'Abstract Repair Strategy: c' || {concat_char} ELSE '' END"]
    parts += [f"CASE WHEN turn % 3 = 0 THEN 'Concrete Repair Strategy: d' || role || {concat_char} || 'Post-Repair State: e' || conv_id ELSE '' END"]
    return " || ".join(parts)


@query(f"""
SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN trim(split_part(split_part(m, 'CWE-Specific Repair Strategy:', 2), chr(10), 1)) ELSE 'N/A' END AS specific,
       CASE WHEN turn % 3 = 0 THEN trim(split_part(split_part(m, 'Pre-Repair State:', 2), chr(10), 1)) ELSE 'N/A' END AS pre_state,
       CASE WHEN turn % 3 = 0 THEN trim(split_part(m, 'Post-Repair State:', 2)) ELSE 'N/A' END AS post_state, 'N/A' AS source,
       CASE turn % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'failed' END AS status
FROM (SELECT conv_id, turn, {_labelled("chr(10)")} AS m FROM conversations)
""")
def labelled_sections(spark: SparkSession, d: str) -> DataFrame:
    """Labelled sections and parsing status."""
    found = T.labelled_sections(F.col("m"))
    rows = table(spark, d, "conversations").withColumn("m", F.expr(_labelled("char(10)")))
    return rows.select("conv_id", "turn", *[found[n].alias(n) for n in ("specific", "pre_state", "post_state", "source", "status")])


@query("""
SELECT conv_id, turn, role = 'user' AS correct, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE 'none given' END AS feedback FROM conversations
""")
def verdict_extract(spark: SparkSession, d: str) -> DataFrame:
    """Verdict lines composed of each turn."""
    answer = "'Some words. RESULT: ' || CASE WHEN role = 'user' THEN 'correct' ELSE 'Incorrect' END || CASE WHEN turn % 2 = 0 THEN char(10) || 'Feedback: ' || text ELSE '' END"
    correct, feedback = T.verdict(F.expr(answer), "none given")
    return table(spark, d, "conversations").select("conv_id", "turn", correct.alias("correct"), feedback.alias("feedback"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events
""")
def json_from_prose(spark: SparkSession, d: str) -> DataFrame:
    """JSON in a fence, bare in prose, twice, or broken."""
    fence = "'Here it is: ```json ' || props || ' ``` as {asked}'"
    kinds = f"CASE event_id % 4 WHEN 0 THEN {fence} WHEN 1 THEN 'result ' || props || ' done' WHEN 2 THEN '```' || char(10) || props || char(10) || '```' ELSE 'no json (' || event_id END"
    rows = table(spark, d, "events").select("event_id", T.json_in_prose(F.expr(kinds)).alias("found"))
    return rows.select("event_id", F.from_json("found", "k long")["k"].alias("k"))


@query("""
SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'N/A_in_summary') AS quality,
       coalesce(l.toxic::VARCHAR, 'N/A_in_summary') AS toxic, coalesce(d.source, 'N/A_in_summary') AS source, 'N/A_in_summary' AS sliced
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def summary_projection(spark: SparkSession, d: str) -> DataFrame:
    """Projection with defaults; a field that no stage produces is always the default."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    fill = lambda c: T.first_present([c], T.MISSING_IN_SUMMARY)
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return rows.select(
        "doc_id", fill(quality).alias("quality"), fill(F.col("toxic").cast("string")).alias("toxic"), fill(F.col("source")).alias("source"), fill(F.lit(None).cast("string")).alias("sliced")
    )


@query("""
SELECT event_id, level, confidence FROM (
  SELECT event_id, CASE WHEN value IS NULL THEN 'Missing' WHEN value < 25 THEN 'Inconsistent' WHEN value < 50 THEN 'Low' WHEN value < 75 THEN 'Medium' ELSE 'High' END AS level,
         round(((value * 7) % 100) / 100, 6) AS confidence FROM events)
WHERE level IN ('Medium', 'High') AND confidence >= 0.6
""")
def consistency_filter(spark: SparkSession, d: str) -> DataFrame:
    """At least Medium and at least 0.6 sure."""
    return ranking.consistent(_judged(spark, d), "level", "confidence", "Medium", 0.6).select("event_id", "level", "confidence")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    level = F.when(v.isNull(), "Missing").when(v < 25, "Inconsistent").when(v < 50, "Low").when(v < 75, "Medium").otherwise("High")
    return table(spark, d, "events").select("event_id", level.alias("level"), F.round(((v * 7) % 100) / 100, 6).alias("confidence"))


@query("""
SELECT CASE WHEN value IS NULL THEN 'Missing' WHEN value < 25 THEN 'Inconsistent' WHEN value < 50 THEN 'Low' WHEN value < 75 THEN 'Medium' ELSE 'High' END AS level, count(*)::BIGINT AS n
FROM events GROUP BY 1
""")
def level_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A4: rows by consistency level."""
    return _judged(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, score, rank FROM (
  SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, distance NULLS LAST, turn) AS rank FROM (
    SELECT conv_id, turn, (length(text) % 3)::BIGINT AS score, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) END AS distance FROM conversations WHERE trim(text) <> '') WHERE score > 0)
WHERE rank <= 5
""")
def select_top_n(spark: SparkSession, d: str) -> DataFrame:
    """Five best suggestions of each conversation; score 0 and empty ones are dropped."""
    n = F.length("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", (n % 3).cast("long").alias("score"), F.when(F.col("turn") % 5 != 4, n.cast("double")).alias("distance"))
    best = ranking.select_top(rows.where(F.trim("text") != ""), ["conv_id"], 5, "turn")
    return best.select("conv_id", "turn", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT source, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, source)::BIGINT AS place FROM documents GROUP BY source")
def group_order_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Groups by number of members. One row per source is ranked."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long"))


@query("""
SELECT quality, toxic, n, (CASE WHEN quality = 1 AND toxic = 0 THEN n ELSE 0 END)::BIGINT AS success, (CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE n END)::BIGINT AS failure,
  sum(n) OVER ()::BIGINT AS total FROM (SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY ALL)
""")
def status_accounting(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3: counts by class, with successes and failures."""
    counts = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return counts.select(
        "quality", "toxic", "n", F.when(good, F.col("n")).otherwise(0).alias("success"), F.when(good, 0).otherwise(F.col("n")).alias("failure"), F.sum("n").over(Window.partitionBy()).alias("total")
    )


@query("""
SELECT source, avg((quality = 1)::INT)::DOUBLE AS success_rate, count(*) FILTER (toxic = 0)::BIGINT AS yes, count(*)::BIGINT AS votes,
       count(*) FILTER (toxic = 0) >= ceil(count(*) * 0.5) AS half, count(*) FILTER (toxic = 0) >= ceil(count(*) * 0.6) AS three_fifths
FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Success rate and votes against both majorities."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    yes, votes = F.count_if(F.col("toxic") == 0), F.count("*")
    return rows.groupBy("source").agg(
        F.avg((F.col("quality") == 1).cast("int")).alias("success_rate"), yes.alias("yes"), votes.alias("votes"), ranking.majority(yes, votes, 0.5).alias("half"), ranking.majority(yes, votes, 0.6).alias("three_fifths")
    )


@query("""
SELECT text_hash, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*)::BIGINT AS copies FROM (SELECT md5(text) AS text_hash, doc_id FROM documents) GROUP BY text_hash
""")
def dedupe_first_last(spark: SparkSession, d: str) -> DataFrame:
    """Of equal items a working set keeps the first and a final set the last."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("text_hash"), "doc_id")
    return rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("copies"))


@query(r"""
WITH v AS (SELECT conv_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4)) AS names FROM conversations WHERE turn = 0)
SELECT c.conv_id, c.turn, count(*) FILTER (contains(lower(regexp_replace(c.text, '\s+', '', 'g')), name))::BIGINT AS matched
FROM conversations c JOIN (SELECT conv_id, unnest(names) AS name FROM v) v USING (conv_id) WHERE c.turn > 0 GROUP BY ALL HAVING matched > 0
""")
def key_var_match(spark: SparkSession, d: str) -> DataFrame:
    """Turns that hold key names of their conversation's first turn, without regard to case and white space."""
    turns = table(spark, d, "conversations")
    names = F.array_distinct(F.filter(T.word_tokens(F.col("text")), lambda x: F.length(x) >= 4))
    first = turns.where("turn = 0").select("conv_id", names.alias("names"))
    code = F.lower(T.squeeze(F.col("text")))
    matched = F.size(F.filter("names", lambda n: F.contains(code, n))).cast("long")
    return turns.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", matched.alias("matched")).where("matched > 0")


@query(r"""
SELECT conv_id, turn, contains(regexp_replace(text, '\s+', '', 'g'), regexp_replace(prev, '\s+', '', 'g')) OR contains(regexp_replace(prev, '\s+', '', 'g'), regexp_replace(text, '\s+', '', 'g')) AS focused,
  starts_with(regexp_replace(text, '\s+', '', 'g'), regexp_replace(left(prev, 3), '\s+', '', 'g')) AS prefixed
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL
""")
def focus_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Whitespace-free containment and prefix of consecutive turns."""
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("prev", prev).where("prev IS NOT NULL")
    starts = F.startswith(T.squeeze(F.col("text")), T.squeeze(F.substring("prev", 1, 3)))
    return rows.select("conv_id", "turn", T.contains_either_way(F.col("text"), F.col("prev")).alias("focused"), starts.alias("prefixed"))


@query("""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'failed' WHEN source IS NULL THEN 'error' WHEN quality IS NULL THEN 'skipped_no_line_numbers' WHEN toxic = 1 THEN 'no_suggestion_found' ELSE 'success' END AS status
FROM documents LEFT JOIN labels USING (doc_id)
""")
def row_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of a row by the first guard that it fails."""
    rows = table(spark, d, "documents").select("doc_id", "text", "source").join(table(spark, d, "labels"), "doc_id", "left")
    status = (
        F.when(T.blank(F.col("text")), "failed")
        .when(F.col("source").isNull(), "error")
        .when(F.col("quality").isNull(), "skipped_no_line_numbers")
        .when(F.col("toxic") == 1, "no_suggestion_found")
        .otherwise("success")
    )
    return rows.select("doc_id", status.alias("status"))


@query("""
SELECT conv_id, min(text) AS least_text, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(DISTINCT role)::BIGINT AS n_roles, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id
""")
def group_rows(spark: SparkSession, d: str) -> DataFrame:
    """Groups with set-union aggregates."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.min("text").alias("least_text"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("role").alias("n_roles"), F.count("*").alias("n")
    )


@query("""
SELECT doc_id, dense_rank() OVER (PARTITION BY n_chars ORDER BY md5('1000/' || doc_id), doc_id)::BIGINT AS place FROM documents
""")
def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    """By size, ties in a seeded order."""
    return ranking.seeded_order(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1000).select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, count(*) FILTER (turn % 3 = 0)::BIGINT AS yes, count(*) FILTER (turn % 3 = 0) >= ceil(count(*) * 0.5) AS carried FROM conversations GROUP BY conv_id")
def yes_no_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes read from JSON in prose."""
    answer = F.expr("CASE turn % 3 WHEN 0 THEN 'I say {\"answer\": \"Yes\"} here' WHEN 1 THEN '```json {\"answer\": \"no\"} ```' ELSE 'yes' END")
    rows = table(spark, d, "conversations").select("conv_id", T.yes_no(answer).alias("said"))
    yes, votes = F.count_if("said"), F.count("*")
    return rows.groupBy("conv_id").agg(yes.alias("yes"), ranking.majority(yes, votes, 0.5).alias("carried"))
