"""Operator 7, mixing sources to target weights by hash thresholds.

Every document has a fixed hash. Per source, words are summed by hash bucket; the bucket in which the running sum passes
the budget is the boundary, and only that bucket is summed again over the next hash bits, until single documents are
told apart. What lies below the threshold is taken: a filter, without sorting documents. The words that the boundary
document leaves open are a smaller budget for a further, nested pass over the untaken documents that still fit it.
Everything runs on DataFrame functions, and the state between the steps is one row per source.

A target of r times a source's size takes every document floor(r) times and the thresholds choose the fraction. Targets
are reached from below, by whole documents.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; documents that repeat a
doc_id share its hash and are taken or left together (a null doc_id is replaced by the text); a source without
words has target 0; an empty table gives an empty result; further columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hash bits: five levels of twelve, 60 in all.
LEVELS, LEVEL_BITS = 5, 12
PASSES = 3


def word_count(text: F.Column) -> F.Column:
    """Number of runs of non-blank characters."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def document_hash() -> F.Column:
    """60 bits of MD5 over doc_id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash().alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> also target: shares by weight of all words, none above cap times its source's size.

    Reshared excess is a common level L with target = min(cap * size, weight * L). Sources reach their cap in the order
    of cap * size / weight, so L follows from running sums over that order. One row per source passes here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * cap).alias("most"))
    rising = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    run = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("capped"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open_w"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("open_w")
    # the level holds at the first source whose cap it does not reach
    held = run.withColumn("try", F.when(level * F.col("w") <= F.col("most"), level))
    held = held.withColumn("level", F.first("try", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("most").cast("double")))
    return held.select("source", "source_size", target.alias("target"))


def _cut(scratch: Scratch, rows: DataFrame, budgets: DataFrame, name: str) -> DataFrame:
    """source, budget -> also threshold and used: rows with h < threshold add up to used <= budget, the next one would not.

    rows: source_key, size, h. A level sums the boundary bucket of the one before by the next hash bits.
    """
    zero, total_bits = F.lit(0).cast("long"), LEVELS * LEVEL_BITS
    state = budgets.select("source_key", "budget", zero.alias("threshold"), zero.alias("used"), F.lit(True).alias("open"))
    for level in range(LEVELS):
        shift = total_bits - LEVEL_BITS * (level + 1)
        inside = rows
        if level:
            at_edge = state.where("open").select("source_key", F.shiftright("threshold", shift + LEVEL_BITS).alias("edge"))
            inside = rows.join(at_edge, "source_key").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("edge"))
        sums = inside.groupBy("source_key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = Window.partitionBy("source_key").orderBy("bucket")
        walked = sums.join(state, "source_key").withColumn("upto", F.sum("words").over(run) + F.col("used"))
        over = F.col("upto") > F.col("budget")
        edge = walked.groupBy("source_key").agg(
            F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("used"), "n"))).alias("edge"),
            F.max("upto").alias("all"),
        )
        seen = state.join(edge, "source_key", "left")
        settled = ~F.col("open") | F.col("all").isNull()
        no_edge = F.col("edge").isNull()
        end = F.lit(1 << total_bits).cast("long")
        state = scratch.save(
            seen.select(
                "source_key",
                "budget",
                F.when(settled, F.col("threshold")).when(no_edge, end).otherwise(F.shiftleft("edge.bucket", shift)).alias("threshold"),
                F.when(settled, F.col("used")).when(no_edge, F.col("all")).otherwise(F.col("edge.used")).alias("used"),
                F.coalesce(~settled & ~no_edge & (F.col("edge.n") > 1), F.lit(False)).alias("open"),
            ),
            f"{name}-{level}",
        )
        if state.where("open").isEmpty():
            break
    return state


def mixing_plan(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(measured documents, plan); plan has per source its target, whole repeats and, by pass, a budget and a threshold."""
    rows = scratch.save(measured(docs), "measured")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes).withColumn("source_key", source_key())
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("budget0", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.save(plan, "targets")
    keyed = rows.where("size > 0").select(source_key().alias("source_key"), "size", "h")
    for i in range(PASSES):
        open_rows = keyed
        if i:  # what no earlier pass took and what fits the words left over
            at = plan.select("source_key", *[f"{c}{j}" for j in range(i) for c in ("budget", "threshold")], f"budget{i}")
            open_rows = keyed.join(at, "source_key").where(~taken_by(i) & (F.col("size") <= F.col(f"budget{i}"))).select(*keyed.columns)
        cut = _cut(scratch, open_rows, plan.select("source_key", F.col(f"budget{i}").alias("budget")), f"pass{i}")
        cut = cut.select("source_key", F.col("threshold").alias(f"threshold{i}"), (F.col("budget") - F.col("used")).alias(f"budget{i + 1}"))
        plan = scratch.save(plan.join(cut, "source_key"), f"plan{i}")
    return rows, plan


def source_key() -> F.Column:
    """A non-null form of source."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def taken_by(passes: int) -> F.Column:
    """Whether one of the first passes takes the document."""
    hit = F.lit(False)
    for i in range(passes):
        hit = hit | ((F.col("size") <= F.col(f"budget{i}")) & (F.col("h") < F.col(f"threshold{i}")))
    return hit


def copies() -> F.Column:
    return F.when(F.col("size") > 0, F.col("whole") + taken_by(PASSES).cast("long")).otherwise(F.lit(0)).cast("long")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words, repeats counted) and copies."""
    rows, plan = mixing_plan(spark, docs, Scratch(spark, "mixing"))
    joined = rows.withColumn("source_key", source_key()).join(plan.drop("source"), "source_key")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), copies().alias("copies"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, a row for each repeat, with all their columns."""
    _, plan = mixing_plan(spark, docs, Scratch(spark, "mixing"))
    plan = plan.select("source_key", "whole", *[f"{c}{i}" for i in range(PASSES) for c in ("budget", "threshold")])
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    names = {f"__{c}": c for c in ("whole", *[f"{k}{i}" for i in range(PASSES) for k in ("budget", "threshold")])}
    size, h = word_count(F.col("text")), document_hash()
    marked = docs.select(F.struct(*docs.columns).alias("doc"), size.alias("size"), h.alias("h"), source_key().alias("__source_key"))
    repeats = marked.join(plan, "__source_key").withColumnsRenamed(names).withColumn("n", copies()).where("n > 0")
    return repeats.select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("doc.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _pass_sql(i: int) -> str:
    """One greedy pass over the untaken documents that fit: those below the first overflow in hash order."""
    return f"""
, c{i} AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM p{i} d WHERE size > 0 AND NOT hit AND size <= budget
), t{i} AS (
  SELECT source, coalesce(sum(size) FILTER (upto <= budget), 0) AS used, max(h) FILTER (upto <= budget) AS top FROM c{i} GROUP BY source
), p{i + 1} AS (
  SELECT p.doc_id, p.source, p.size, p.h, p.source_size, p.target, p.whole,
         p.hit OR coalesce(p.size > 0 AND p.size <= p.budget AND p.h <= t.top, false) AS hit, p.budget - coalesce(t.used, 0) AS budget
  FROM p{i} p LEFT JOIN t{i} t ON p.source IS NOT DISTINCT FROM t.source
)"""


OP7_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::BIGINT AS most,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w
  FROM s
), l AS (
  SELECT (total - capped) / open_w AS level FROM r WHERE (total - capped) / open_w * w <= most ORDER BY most / w, source NULLS LAST LIMIT 1
), g AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(w * level, most::DOUBLE)) AS target FROM r, l
), p0 AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole, false AS hit,
         g.target - CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END * g.source_size AS budget
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)"""
    + "".join(_pass_sql(i) for i in range(PASSES))
    + f"""
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * (whole + hit::INT) ELSE 0 END::BIGINT AS taken,
       CASE WHEN size > 0 THEN whole + hit::INT ELSE 0 END::BIGINT AS copies
FROM p{PASSES}
"""
)
