"""The batch that proposes, groups, ranks and grades changes, as a chain of DataFrames.

Every stage keeps explicit ordinals (row_id, cause, example), so results do not depend on the order in which tasks end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.functions.vectors import Embedder, HashingEmbedder, embed
from patchloom.operators import clustering, ranking, vector_search
from patchloom.session import written

from .models import StandIn, TextModel, model_map

#: Distance and score of a suggestion that no example backs, and of one that stands for a group.
DIRECT_DISTANCE, DIRECT_SCORE = 999.0, 1.0
GROUP_DISTANCE, GROUP_SCORE = -2.0, 1.1
#: Classes of a grade, and the one of a suggestion that was never graded.
GRADES = ("SynPatchEq", "SemEq", "Plausible", "Incorrect", "Unknown")
MISSING_GRADE = "Error_Missed"


@dataclass(frozen=True)
class Limits:
    """Fixed values of a run."""

    causes: int = 5
    examples: int = 5
    top: int = 5
    least_level: str = "Medium"
    least_confidence: float = 0.6


def candidate_lines(rows: DataFrame, model: TextModel, code: str, kind: str) -> DataFrame:
    """rows with sources and sinks: sorted lines of both; an answer that cannot be read has none."""
    answered = model_map(rows, model, "candidates", {"code": code, "kind": kind}, "answer")
    found = T.json_in_prose(F.col("answer"))
    none = F.array().cast("array<bigint>")
    lines = lambda name: F.coalesce(T.valid_line_numbers(F.get_json_object(found, f"$.{name}"), "array<struct<name:string,lines:array<string>>>"), none)
    return answered.withColumns({"sources": lines("sources"), "sinks": lines("sinks")}).drop("answer")


def key_elements(rows: DataFrame, model: TextModel, code: str, lines: str) -> DataFrame:
    """rows with names, element_lines and slice; without a readable answer the given lines and the whole code."""
    answered = model_map(rows.withColumn("__lines", F.array_join(F.col(lines).cast("array<string>"), ",")), model, "elements", {"code": code, "lines": "__lines"}, "answer")
    found = F.from_json(T.json_in_prose(F.col("answer")), "struct<key_elements:array<struct<name:string,lines:array<int>,type:string,relevance:string>>>")["key_elements"]
    read = answered.withColumn("__found", found)
    own = F.array_sort(F.array_distinct(F.flatten(F.transform("__found", lambda e: F.coalesce(e["lines"], F.array().cast("array<int>"))))))
    usable = F.coalesce(F.size(own) > 0, F.lit(False))
    return read.withColumns(
        {
            "names": F.coalesce(F.transform("__found", lambda e: e["name"]), F.array().cast("array<string>")),
            "element_lines": F.when(usable, own).otherwise(F.col(lines)),
            "slice": F.when(usable, T.pick_lines(F.col(code), own)).otherwise(F.col(code)),
        }
    ).drop("__lines", "__found", "answer")


_CAUSE = "struct<root_causes:array<struct<specific:string,logic:string,effect:string,key_variables:array<string>,lines:array<string>>>>"


def root_causes(rows: DataFrame, model: TextModel, limits: Limits) -> DataFrame:
    """row_id, key, cause_no, cause, logic, effect, variables, lines, flow, conditions, confidence: hypotheses, refined one by one.

    rows: row_id, key, code, optional lines. Entries without a cause or lines are dropped, lines that are no numbers give way to the
    row's own; an unreadable refinement leaves the original, with confidence Low.
    """
    given = rows if "lines" in rows.columns else rows.withColumn("lines", F.array(F.lit(1)))
    asked = model_map(given.select("row_id", "key", "code", "lines"), model, "hypothesise", {"code": "code"}, "answer")
    entries = F.from_json(T.json_in_prose(F.col("answer")), _CAUSE)["root_causes"]
    usable = F.slice(F.filter(entries, lambda e: e["specific"].isNotNull() & (F.size(e["lines"]) > 0)), 1, limits.causes)
    causes = asked.select("row_id", "key", "code", F.col("lines").alias("own"), F.posexplode(usable).alias("cause_no", "e"))
    whole = F.transform("e.lines", lambda x: x.try_cast("int"))
    lines = F.when(F.exists(whole, lambda x: x.isNull()), F.col("own")).otherwise(whole)
    causes = causes.select("row_id", "key", "code", "cause_no", F.col("e.specific").alias("cause"), "e.logic", "e.effect", F.col("e.key_variables").alias("variables"), lines.alias("lines"))
    refined = model_map(causes, model, "refine", {"cause": "cause", "code": "code"}, "answer")
    r = F.from_json(T.json_in_prose(F.col("answer")), "cause string, logic string, effect string, flow string, conditions string, confidence string")
    refined = refined.withColumn("r", r)
    better = lambda name: F.coalesce(f"r.{name}", name).alias(name)
    fields = [better("cause"), better("logic"), better("effect"), "variables", "lines", "r.flow", "r.conditions", F.coalesce("r.confidence", F.lit("Low")).alias("confidence")]
    return refined.select("row_id", "key", "cause_no", *fields)


def consistent_examples(pairs: DataFrame, model: TextModel, limits: Limits) -> DataFrame:
    """Pairs (cause, example) that the model finds consistent, with level, confidence and explanation; blank examples are not asked about."""
    judged = model_map(pairs.where(~T.blank(F.col("example"))), model, "consistency", {"cause": "cause", "example": "example"}, "answer")
    parsed = F.from_json(T.json_in_prose(F.col("answer")), "level string, confidence double, explanation string")
    judged = judged.withColumns({"level": F.coalesce(parsed["level"], F.lit("Inconsistent")), "confidence": F.coalesce(parsed["confidence"], F.lit(0.0)), "explanation": parsed["explanation"]})
    return ranking.consistent(judged.drop("answer"), "level", "confidence", limits.least_level, limits.least_confidence)


def examples(causes: DataFrame, base: DataFrame, model: TextModel, embedder: Embedder, limits: Limits) -> DataFrame:
    """Causes with the knowledge that is near and consistent with them. base: vec_id, embedding, partition, text."""
    asked = causes.select(F.struct("row_id", "cause_no").alias("query_id"), embed(embedder)(F.col("cause")).alias("query"), "key")
    found = vector_search.search(written(asked, "causes"), base.select("vec_id", "embedding", "partition"), limits.examples)
    hits = found.select("query_id.*", "vec_id", "distance").join(base.select("vec_id", F.col("text").alias("example")), "vec_id")
    kept = consistent_examples(hits.join(causes.select("row_id", "cause_no", "cause"), ["row_id", "cause_no"]), model, limits)
    return kept.select("row_id", "cause_no", "cause", "vec_id", "example", "distance")


def _sections(answer: Column) -> dict[str, Column]:
    return {
        "text": T.marked_section(answer, "PATCH_DIFF"),
        "strategy": T.marked_section(answer, "REPAIR_STRATEGY"),
        "name": F.array_join(T.comma_list(T.marked_section(answer, "KEY_VARIABLES")), ","),
    }


def suggestions(causes: DataFrame, hits: DataFrame, model: TextModel) -> DataFrame:
    """Patches by example, then direct ones: text, strategy, name (key variables), post_state, method, distance.

    One that lacks a patch or a strategy is dropped; a direct one also needs its analysis, which is its state after the repair.
    """
    by_example = model_map(hits.select("row_id", "cause_no", "cause", "vec_id", "example", "distance"), model, "suggest", {"cause": "cause", "example": "example"}, "answer")
    by_example = by_example.withColumns({**_sections(F.col("answer")), "post_state": F.col("example"), "method": F.lit("example")})
    plain = causes.select("row_id", "cause_no", "cause", F.lit(-1).cast("long").alias("vec_id"), F.lit(DIRECT_DISTANCE).alias("distance"))
    direct = model_map(plain, model, "direct", {"cause": "cause"}, "answer")
    direct = direct.withColumns({**_sections(F.col("answer")), "post_state": T.marked_section(F.col("answer"), "VULNERABILITY_ANALYSIS"), "method": F.lit("direct")})
    columns = ["row_id", "cause_no", "cause", "vec_id", "distance", "text", "strategy", "name", "post_state", "method"]
    every = by_example.select(columns).unionByName(direct.select(columns))
    return every.where(~T.blank(F.col("text")) & ~T.blank(F.col("strategy")) & F.col("post_state").isNotNull())


#: Sections of a synthesis that are read besides patch, strategy and variables.
SYNTHESIS = ("SPECIFIC_CAUSE", "LOGIC", "EFFECT", "PRE_STATE", "POST_STATE")


def synthesised(members: DataFrame, keys: list[str], order: str, model: TextModel) -> DataFrame:
    """keys, group_id, text, strategy, name, the sections of SYNTHESIS, size: one candidate for each group with two members or more.

    members: keys, order, group_id, text, strategy, cause. Problems with one group have none; a group's patches and strategies go to the model in
    order, its causes once each; an answer without patch or strategy gives none.
    """
    listed = F.array_sort(F.collect_list(F.struct(order, "text", "strategy")))
    grouped = members.groupBy(*keys, "group_id").agg(listed.alias("m"), F.array_sort(F.collect_set("cause")).alias("causes"), F.count("*").alias("size"))
    n_groups = members.groupBy(*keys).agg(F.count_distinct("group_id").alias("n_groups"))
    chosen = grouped.join(n_groups, keys).where("n_groups > 1 AND size > 1")
    join = lambda field: F.array_join(F.transform("m", lambda x: x[field]), "\n")
    chosen = chosen.select(*keys, "group_id", "size", join("text").alias("patches"), join("strategy").alias("strategies"), F.array_join("causes", "\n").alias("causes"))
    answered = model_map(chosen, model, "synthesise", {"causes": "causes", "patches": "patches", "strategies": "strategies"}, "answer")
    read = answered.withColumns({**_sections(F.col("answer")), **{n.lower(): F.coalesce(T.marked_section(F.col("answer"), n), F.lit(T.MISSING)) for n in SYNTHESIS}})
    return read.where(~T.blank(F.col("text")) & ~T.blank(F.col("strategy"))).drop("answer", "patches", "strategies", "causes")


def selected(candidates: DataFrame, keys: list[str], order: str, model: TextModel, top: int) -> DataFrame:
    """The best candidates (keys, order, text, distance) that the model says are true, ranked; what it says replaces their score."""
    judged = model_map(candidates, model, "judge", {"patch": "text", "member": order}, "answer")
    scored = judged.withColumn("score", F.when(F.trim("answer") == "true", 1.0).otherwise(0.0)).drop("answer")
    return ranking.select_top(scored, keys, top, order)


def grades(candidates: DataFrame, model: TextModel) -> DataFrame:
    """Candidates with grade, explanation and grade_confidence; what cannot be read is Unknown."""
    graded = model_map(candidates, model, "grade", {"patch": "text"}, "answer")
    read = F.from_json(T.json_in_prose(F.col("answer")), "class string, explanation string, confidence double")
    return graded.withColumns({"grade": F.coalesce(read["class"], F.lit("Unknown")), "explanation": read["explanation"], "grade_confidence": F.coalesce(read["confidence"], F.lit(0.0))}).drop("answer")


def with_grades(candidates: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """Every candidate with its grade, in its own place; one that no grade came back for says so."""
    return candidates.join(graded.select(*keys, "grade"), keys, "left").withColumn("grade", F.coalesce("grade", F.lit(MISSING_GRADE)))


def merged_conditions(pairs: DataFrame, model: TextModel, fields: tuple[str, ...]) -> DataFrame:
    """pairs with a merged text for each field (field_a, field_b); a missing side, or an answer of None, vetoes the pair."""
    out = pairs
    for f in fields:
        out = model_map(out, model, "merge_condition", {"a": f"{f}_a", "b": f"{f}_b"}, f)
        out = out.withColumn(f, F.when((F.trim(f) != "None") & F.col(f"{f}_a").isNotNull() & F.col(f"{f}_b").isNotNull(), F.col(f)))
    kept = F.lit(True)
    for f in fields:
        kept = kept & F.col(f).isNotNull()
    return out.where(kept)


def entailed(pairs: DataFrame, model: TextModel, keys: list[str], rounds: int, share: float) -> DataFrame:
    """keys, yes, carried: rounds of asking whether premise entails claim; carried by a share of yes."""
    asked = pairs.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    answered = model_map(asked, model, "entails", {"claim": "claim", "premise": "premise", "round": "round"}, "answer")
    yes = F.count_if(T.yes_no(F.col("answer")))
    return answered.groupBy(*keys).agg(yes.alias("yes"), ranking.majority(yes, F.count("*"), share).alias("carried"))


def run(rows: DataFrame, base: DataFrame, model: TextModel | None = None, embedder: Embedder | None = None, limits: Limits | None = None) -> DataFrame:
    """row_id, rank, method, score, distance, grade: the best suggestions of each row (row_id, key, code)."""
    model, embedder, limits = model or StandIn(), embedder or HashingEmbedder(), limits or Limits()
    causes = written(root_causes(rows, model, limits), "causes")
    found = written(suggestions(causes, examples(causes, base, model, embedder, limits), model), "suggestions")
    found = found.withColumn("member", F.concat_ws("/", "cause_no", "method", "vec_id"))
    # suggestions of a row are bounded by Limits, so a row is one small problem
    grouped = clustering.group_vectors(found.withColumn("vector", embed(embedder)(F.col("text"))), ["row_id"], "member", "vector")
    enhanced = synthesised(found.join(grouped, ["row_id", "member"]), ["row_id"], "member", model)
    enhanced = enhanced.select("row_id", F.concat(F.lit("group/"), "group_id").alias("member"), "text", F.lit(GROUP_DISTANCE).alias("distance"), F.lit("group_enhanced").alias("method"))
    every = enhanced.unionByName(found.select(enhanced.columns))
    best = grades(selected(every, ["row_id"], "member", model, limits.top), model)
    return best.select("row_id", "rank", "method", "score", "distance", "grade")


def with_status(rows: DataFrame, results: DataFrame) -> DataFrame:
    """row_id, status, counts of each grade: a row without suggestion says so."""
    counts = results.groupBy("row_id").agg(*[F.count_if(F.col("grade") == g).alias(g.lower()) for g in GRADES], F.count("*").alias("total"))
    joined = rows.select("row_id", "code").join(counts, "row_id", "left")
    status = F.when(T.blank(F.col("code")), "error").when(F.col("total").isNull(), "no_suggestion_found").otherwise("success")
    return joined.select("row_id", status.alias("status"), *[F.coalesce(g.lower(), F.lit(0)).cast("long").alias(g.lower()) for g in GRADES], F.coalesce("total", F.lit(0)).cast("long").alias("total"))
