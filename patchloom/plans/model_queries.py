"""Queries on the model stages, run with the stand-in. Its answers follow from an MD5 of their inputs, so SQL can state them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.session import table, written

from . import models, repair
from .models import hash_sql as h

QUERIES: dict = {}
ORACLE: dict = {}
MODEL = models.StandIn()
LIMITS = repair.Limits()


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def _followed(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the text of the next turn."""
    turns = _turns(spark, d)
    return turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])


_FOLLOWED = "(SELECT c.conv_id, c.turn, c.role, c.text, n.text AS next FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"


def _text(numbers) -> F.Column:  # noqa: ANN001
    return F.array_join(F.col(numbers).cast("array<string>"), ",")


@query(f"""
SELECT conv_id, turn, CASE WHEN h % 11 < 2 THEN '' ELSE array_to_string(list_sort(list_distinct([1 + h % 7, 1 + h % 5])), ',') END AS sources,
       CASE WHEN h % 11 < 2 OR h % 3 = 0 THEN '' ELSE (h % 3)::VARCHAR END AS sinks FROM (SELECT conv_id, turn, {h('text', 'role')} AS h FROM conversations)
""")
def source_sink_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lines of sources and sinks, or none."""
    return repair.candidate_lines(_turns(spark, d), MODEL, "text", "role").select("conv_id", "turn", _text("sources").alias("sources"), _text("sinks").alias("sinks"))


@query(f"""
SELECT conv_id, turn, CASE WHEN h % 6 = 0 THEN '' ELSE 'v' || (h % 9) END AS names, CASE WHEN h % 6 = 0 THEN '1,2' ELSE (1 + h % 4) || ',' || (2 + h % 4) END AS lines,
       CASE WHEN h % 6 = 0 THEN text ELSE concat_ws(chr(10), CASE WHEN 1 + h % 4 <= len(l) THEN (1 + h % 4) || ': ' || l[1 + h % 4] END, CASE WHEN 2 + h % 4 <= len(l) THEN (2 + h % 4) || ': ' || l[2 + h % 4] END) END AS slice
FROM (SELECT conv_id, turn, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l, {h('text', "'1,2'")} AS h FROM conversations)
""")
def key_elements(spark: SparkSession, d: str) -> DataFrame:
    """M5: key elements with their lines; else the given lines and the whole text."""
    found = repair.key_elements(_turns(spark, d).withColumn("given", F.array(F.lit(1), F.lit(2))), MODEL, "text", "given")
    return found.select("conv_id", "turn", F.array_join("names", ",").alias("names"), _text("element_lines").alias("lines"), "slice")


_CAUSES = f"""r AS (SELECT conv_id, conv_id || '/' || turn AS row_id, text AS code, {h('text')} AS h FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, row_id, code, h, i, CASE WHEN i > 2 AND h % 3 = 0 THEN i - 1 ELSE i END AS cause_no FROM r, range(0, 7) t(i) WHERE h % 19 <> 0 AND i <= h % 7 AND (i <> 2 OR h % 3 <> 0)),
c AS (SELECT conv_id, row_id, code, cause_no, 'cause ' || ((h + i) % 50) AS cause, 'logic ' || i AS logic, 'effect ' || ((h + i) % 3) AS effect, 'v' || i || ',w' AS variables,
  (CASE WHEN i = 1 AND h % 4 = 0 THEN 1 ELSE 1 + (h + i) % 5 END)::VARCHAR AS lines FROM k WHERE cause_no < 5),
q AS (SELECT *, {h('cause', 'code')} AS g FROM c),
causes AS (SELECT conv_id, row_id, cause_no::BIGINT AS cause_no, CASE WHEN g % 5 = 0 THEN cause ELSE 'refined ' || cause END AS cause, CASE WHEN g % 5 = 0 THEN logic ELSE 'l' || (g % 5) END AS logic,
  CASE WHEN g % 5 = 0 THEN effect ELSE 'e' || (g % 6) END AS effect, variables, lines, CASE WHEN g % 5 <> 0 THEN 'f' || (g % 7) END AS flow, CASE WHEN g % 5 <> 0 THEN 'c' || (g % 4) END AS conditions,
  CASE WHEN g % 5 = 0 THEN 'Low' ELSE ['High', 'Medium', 'Low'][1 + g % 3] END AS confidence FROM q)"""


def _causes(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).where("role = 'user'")
    rows = rows.select(F.concat_ws("/", "conv_id", "turn").alias("row_id"), F.col("conv_id").alias("key"), F.col("text").alias("code"))
    return repair.root_causes(rows, MODEL, LIMITS)


@query(f"WITH {_CAUSES} SELECT * EXCLUDE (conv_id) FROM causes")
def root_causes(spark: SparkSession, d: str) -> DataFrame:
    """At most five hypotheses a row, each refined."""
    found = _causes(spark, d).withColumn("cause_no", F.col("cause_no").cast("long"))
    return found.withColumns({"variables": F.array_join("variables", ","), "lines": _text("lines")}).drop("key")


_KEPT = f"""{_CAUSES},
p AS (SELECT row_id, cause_no, cause, item_id, text AS example, {h('cause', 'text')} AS j FROM causes JOIN benchmark ON item_id % 20 = conv_id % 20),
kept AS (SELECT row_id, cause_no, cause, item_id, example, ['High', 'Medium'][1 + j % 4] AS level, j // 4 % 11 / 10 AS confidence, 'x' || (j % 8) AS explanation
  FROM p WHERE j % 13 <> 0 AND j % 4 < 2 AND j // 4 % 11 >= 6)"""


def _kept(spark: SparkSession, d: str, causes: DataFrame) -> DataFrame:
    base = table(spark, d, "benchmark").select((F.col("item_id") % 20).alias("part"), F.col("item_id").alias("vec_id"), F.col("text").alias("example"))
    pairs = causes.select("row_id", "cause_no", "cause", (F.col("key") % 20).alias("part")).join(base, "part").drop("part")
    return repair.consistent_examples(pairs, MODEL, LIMITS)


@query(f"WITH {_KEPT} SELECT row_id, cause_no, item_id, level, confidence, explanation FROM kept")
def cause_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Causes meet the examples of their part; what is consistent stays."""
    kept = _kept(spark, d, _causes(spark, d))
    return kept.select("row_id", F.col("cause_no").cast("long").alias("cause_no"), F.col("vec_id").alias("item_id"), "level", "confidence", "explanation")


@query(f"""WITH {_KEPT}, s AS (
  SELECT row_id, cause_no, item_id, 'example' AS method, {h('cause', 'example')} AS j, example AS post_state FROM kept
  UNION ALL SELECT row_id, cause_no, -1, 'direct', j, 'analysis ' || (j % 30) FROM (SELECT *, {h('cause')} AS j FROM causes) WHERE j % 4 <> 0)
SELECT row_id, cause_no, item_id, method, '+ fix ' || (j % 1000) AS patch, 'strategy ' || (j % 40) AS strategy, 'a' || (j % 3) || ',b' AS variables, post_state,
       method = 'direct' AS sentinel FROM s WHERE j % 7 <> 0 AND j % 5 <> 0""")
def cause_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions by example, then direct ones with the sentinel distance."""
    causes = written(_causes(spark, d), "causes")
    found = repair.suggestions(causes, _kept(spark, d, causes).withColumn("distance", F.lit(0.5)), MODEL)
    return found.select(
        "row_id", F.col("cause_no").cast("long").alias("cause_no"), F.col("vec_id").alias("item_id"), "method", F.col("text").alias("patch"), "strategy", F.col("name").alias("variables"), "post_state",
        (F.col("distance") == repair.DIRECT_DISTANCE).alias("sentinel"),
    )


@query(f"""WITH m AS (SELECT conv_id, turn % 2 AS group_id, string_agg(text, chr(10) ORDER BY turn) AS patches, string_agg('s' || (turn % 3), chr(10) ORDER BY turn) AS strategies,
  array_to_string(list_sort(list(DISTINCT role)), chr(10)) AS causes, count(*) AS size FROM conversations GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_groups, {h('causes', 'patches', 'strategies')} AS h FROM m)
SELECT conv_id, group_id::BIGINT AS group_id, size::BIGINT AS size, '+ merged ' || (h % 100) AS patch, 'joint ' || (h % 10) AS strategy, 'key_variables ' || (h % 6) AS variables,
       'specific_cause ' || (h % 6) AS specific_cause, 'pre_state ' || (h % 6) AS pre_state, 'post_state ' || (h % 6) AS post_state FROM g WHERE n_groups > 1 AND size > 1 AND h % 9 <> 0""")
def group_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """One joint candidate for each group of a problem that has several."""
    turns = _turns(spark, d)
    members = turns.select("conv_id", "turn", (F.col("turn") % 2).cast("long").alias("group_id"), "text", F.concat(F.lit("s"), F.col("turn") % 3).alias("strategy"), F.col("role").alias("cause"))
    found = repair.synthesised(members, ["conv_id"], "turn", MODEL)
    return found.select("conv_id", "group_id", "size", F.col("text").alias("patch"), "strategy", F.col("name").alias("variables"), "specific_cause", "pre_state", "post_state")


@query(f"""SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS place
FROM (SELECT *, {h('turn::VARCHAR', 'text')} AS h FROM conversations) WHERE h % 3 = 0) WHERE place <= 3""")
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest candidates that the judge calls literally true."""
    rows = _turns(spark, d).withColumn("distance", F.length("text").cast("double"))
    return repair.selected(rows, ["conv_id"], "turn", MODEL, 3).select("conv_id", "turn", F.col("rank").cast("long").alias("place"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'Error_Missed' WHEN h % 10 = 0 THEN 'Unknown' ELSE ['SynPatchEq', 'SemEq', 'Plausible', 'Incorrect'][1 + h % 4] END AS grade,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, {h('text')} AS h FROM conversations)""")
def graded_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Grades come back to the candidates, in their order; one that got lost leaves a placeholder."""
    rows = _turns(spark, d)
    graded = repair.grades(rows, MODEL).where("turn % 7 <> 6")
    found = repair.with_grades(rows, graded, ["conv_id", "turn"])
    from pyspark.sql import Window

    return found.select("conv_id", "turn", "grade", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query(f"""SELECT conv_id, turn, 'both ' || (b % 20) AS before, 'both ' || (a % 20) AS after FROM (
  SELECT conv_id, turn, {h('text', 'next')} AS b, {h('next', 'text')} AS a FROM {_FOLLOWED}) WHERE a % 5 <> 0 AND b % 5 <> 0""")
def condition_merge(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of both sides merged; a None on either vetoes the merge."""
    rows = _followed(spark, d).select("conv_id", "turn", F.col("text").alias("before_a"), F.col("next").alias("before_b"), F.col("next").alias("after_a"), F.col("text").alias("after_b"))
    return repair.merged_conditions(rows, MODEL, ("before", "after")).select("conv_id", "turn", "before", "after")


@query(f"""SELECT conv_id, turn, count(*) FILTER (h % 7 <> 0 AND h % 2 = 1)::BIGINT AS yes, count(*) FILTER (h % 7 <> 0 AND h % 2 = 1) >= 2 AS carried FROM (
  SELECT conv_id, turn, {h('next', 'text', 'round::VARCHAR')} AS h FROM {_FOLLOWED}, range(1, 4) t(round)) GROUP BY ALL""")
def entailment_votes(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of a yes or no, carried by half."""
    rows = _followed(spark, d).select("conv_id", "turn", F.col("next").alias("claim"), F.col("text").alias("premise"))
    return repair.entailed(rows, MODEL, ["conv_id", "turn"], 3, 0.5)


@query(f"SELECT conv_id, turn, {h('text', 'next')} % 3 <> 0 AS same FROM {_FOLLOWED}")
def same_domain(spark: SparkSession, d: str) -> DataFrame:
    """Whether two texts are of one domain; no, where that cannot be read."""
    answered = models.model_map(_followed(spark, d), MODEL, "same_domain", {"a": "text", "b": "next"}, "answer")
    return answered.select("conv_id", "turn", T.yes_no(F.col("answer")).alias("same"))


@query(f"""SELECT conv_id, 'in short ' || ({h('texts')} % 12) AS summary FROM (
  SELECT conv_id, string_agg('because ' || ({h('text')} % 12), chr(10) ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)""")
def consensus_summary(spark: SparkSession, d: str) -> DataFrame:
    """An explanation of each turn, and one summary of a conversation's explanations."""
    told = models.model_map(_turns(spark, d), MODEL, "explain", {"code": "text"}, "why")
    listed = F.array_sort(F.collect_list(F.struct("turn", "why")))
    joined = told.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["why"]), "\n").alias("texts"))
    return models.model_map(joined, MODEL, "consensus", {"texts": "texts"}, "summary").select("conv_id", "summary")


@query(f"SELECT conv_id, turn, CASE WHEN h % 8 = 0 THEN '' ELSE 'return ' || (h % 100) || ';' END AS code FROM (SELECT conv_id, turn, {h('text')} AS h FROM conversations)")
def zero_shot_repair(spark: SparkSession, d: str) -> DataFrame:
    """The first fenced block of an answer, or nothing."""
    answered = models.model_map(_turns(spark, d), MODEL, "zero_shot", {"code": "text"}, "answer")
    return answered.select("conv_id", "turn", T.first_code_block(F.col("answer")).alias("code"))


@query("""SELECT conv_id, turn, concat_ws(chr(10) || chr(10), 'You mend programs.', CASE WHEN trim(text) <> '' THEN '### code' || chr(10) || text END, CASE WHEN turn % 2 = 0 THEN '### kind' || chr(10) || role END,
  'Answer with: PATCH_DIFF_START: ... PATCH_DIFF_END:, REPAIR_STRATEGY_START: ... REPAIR_STRATEGY_END:') AS prompt FROM conversations""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A prompt with a section for each input that is there."""
    inputs = {"code": F.col("text"), "kind": F.when(F.col("turn") % 2 == 0, F.col("role"))}
    return _turns(spark, d).select("conv_id", "turn", models.prompt("You mend programs.", inputs, ("PATCH_DIFF", "REPAIR_STRATEGY")).alias("prompt"))


@query(f"""SELECT role, count(*)::BIGINT AS calls, sum(length(text))::BIGINT AS sent, sum(CASE h % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 13 END)::BIGINT AS received
FROM (SELECT role, text, {h('text')} AS h FROM conversations) GROUP BY role""")
def model_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and their volume, four at a time, with a back-end by name."""
    answered = models.model_map(_turns(spark, d), models.backend("stand-in"), "judge", {"patch": "text"}, "answer", parallel=4)
    return models.usage(answered, ["role"], "text", "answer")


def _round(i: int, feedback: str) -> str:
    """One round of the loop over table w{i - 1} (doc_id, text, feedback of the round before)."""
    return f"""s{i} AS (SELECT *, {h('text', feedback, f"'{i}'")} AS hs FROM w{i - 1}),
a{i} AS (SELECT *, {h('text', "'specific ' || (hs % 100)")} AS ha, {h("'+ specific ' || (hs % 100)", f"'{i}'")} AS hv FROM s{i}),
w{i} AS (SELECT doc_id, text, 'try ' || (hv % 10) AS feedback FROM a{i} WHERE hs % 17 <> 0 AND ha % 23 > 1 AND hv % 2 = 0)"""


_VERDICT = "CASE WHEN hs % 17 = 0 OR ha % 23 < 2 THEN '' WHEN hv % 2 = 1 THEN 'correct' ELSE 'incorrect' END"


@query(f"""WITH w0 AS (SELECT doc_id, text, '' AS feedback FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''), {', '.join(_round(i, 'feedback') for i in (1, 2, 3))},
every AS (SELECT doc_id, 1 AS i, hs, ha, hv FROM a1 UNION ALL SELECT doc_id, 2, hs, ha, hv FROM a2 UNION ALL SELECT doc_id, 3, hs, ha, hv FROM a3),
v AS (SELECT doc_id, i, hs, {_VERDICT} AS verdict FROM every)
SELECT doc_id, max(i)::BIGINT AS attempts, CASE WHEN max_by(verdict, i) = 'correct' THEN 'success' ELSE 'failed' END AS status,
  coalesce(string_agg(CASE WHEN verdict <> '' THEN verdict END, ',' ORDER BY i), '') AS verdicts,
  coalesce('specific ' || (max_by(CASE WHEN hs % 17 <> 0 THEN hs END, CASE WHEN hs % 17 <> 0 THEN i END) % 100), '') AS strategy FROM v GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 'failed', '', '' FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') = ''""")
def feedback_loop(spark: SparkSession, d: str) -> DataFrame:
    """Bounded loop with a stand-in model, over all documents."""
    return models.feedback_loop(table(spark, d, "documents"), MODEL, "doc_id", "text")
