"""Operator 5, license scan: ordered signature rules behind a keyword prefilter, on DataFrame functions only.

Texts that hold none of the rules' keywords, as whole words, are counted and done. The rest are written as words parted by two spaces, so that
neighbouring matches never share a blank; each is met with the rules of the keywords that it holds, and every match
becomes an interval of words. An interval inside another one of a rule with higher priority is suppressed (of equal
intervals the rule that ranks first stays); what remains gives the labels. The base phrases are reported whatever suppresses them.

Work is spread by (document, rule), and detections are compared only with those that start within LONGEST words before
them, so a document with many detections costs in proportion to them.

Defined cases: a null or empty text has no words and no labels; a repeated doc_id is scanned row by row; a null doc_id
is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .license_rules import rules

#: Word characters before lower-casing A-Z; what lies between words is their complement.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that a match covers at most.
LONGEST = 32


def words_of(text: F.Column) -> F.Column:
    """The words parted by one space, nothing at the ends; case as given."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " "))


def word_number(words: F.Column) -> F.Column:
    """How many words a text of single-spaced words has."""
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def rule_table(spark: SparkSession) -> DataFrame:
    """Keywords stand between blanks, as they are looked for."""
    rows = [(-1 - i, label, f" {words.split()[0]} ", f" {words.replace(' ', '  ')} ", True) for i, (words, label) in enumerate(BASE.items())]
    rows += [(priority, label, f" {keyword} ", pattern, False) for priority, label, keyword, pattern in rules()]
    return spark.createDataFrame(rows, "priority int, label string, keyword string, pattern string, base boolean")


def any_of(keywords: list[str]) -> str:
    """A pattern of all keywords, one branch per first letter."""
    return "|".join(f"{letter}(?:{'|'.join(k[1:] for k in group)})" for letter, group in groupby(sorted(keywords), key=lambda k: k[0]))


def detections(spark: SparkSession, candidates: DataFrame, keywords: list[str]) -> DataFrame:
    """row, first, last (words), priority, label, base: every match of every rule whose keyword the words hold."""
    held = F.filter(F.array(*(F.lit(f" {k} ") for k in keywords)), lambda k: F.contains(F.col("spaced"), k))
    spaced = F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" "))
    keyed = candidates.select("row", spaced.alias("spaced")).select("row", "spaced", F.explode(held).alias("keyword"))
    tried = keyed.join(F.broadcast(rule_table(spark)), "keyword").where("spaced RLIKE pattern")
    # between matches lie the parts that a split leaves; a word opens with a space and closes with one
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    parts = F.transform(F.split("spaced", F.col("pattern")), spaces)
    hits = F.transform(F.regexp_extract_all("spaced", F.col("pattern"), F.lit(0)), spaces)
    found = tried.select("row", "priority", "label", "base", parts.alias("parts"), F.posexplode(hits).alias("n", "hit_spaces"), hits.alias("hits"))
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)
    first = (total("parts", F.col("n") + 1) + total("hits", F.col("n"))) / 2
    return found.select(
        "row", first.cast("long").alias("first"), (first + F.col("hit_spaces") / 2 - 1).cast("long").alias("last"), "priority", "label", "base"
    )


def unsuppressed(found: DataFrame) -> DataFrame:
    """Detections that no higher-ranking one contains. Base ones are compared like the rest and kept elsewhere."""
    merged = found.where("NOT base")
    near = Window.partitionBy("row").orderBy("first").rangeBetween(-LONGEST, 0)
    around = F.collect_list(F.struct("first", "last", "priority")).over(near)
    inside = F.exists("around", lambda x: (x["first"] <= F.col("first")) & (x["last"] >= F.col("last")) & (x["priority"] < F.col("priority")))
    return merged.withColumn("around", around).where(~inside).drop("around")


def license_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is n / (n + 1) for n detections that are left, base ones included.
    """
    scratch = Scratch(spark, "license-scan")
    listed = rules()
    keywords = sorted({r[2] for r in listed} | {w.split()[0] for w in BASE})
    # (?i) folds ASCII only, as wanted; most texts hold no keyword and are never lower-cased
    gate = F.concat(F.lit(" "), "words", F.lit(" ")).rlike(f"(?i) (?:{any_of(keywords)}) ")
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words"))
    counted = words.select("doc_id", "row", word_number(F.col("words")).alias("n_words"), F.when(gate, ascii_lower(F.col("words"))).alias("words"))
    rows = scratch.save(counted, "words")
    found = scratch.save(detections(spark, rows.where("words IS NOT NULL").select("row", "words"), keywords), "detections")
    base = found.where("base").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    left = unsuppressed(found).groupBy("row").agg(F.count("*").alias("n_left"), F.collect_set("label").alias("label_set"))
    joined = rows.drop("words").join(scratch.save(base.join(left, "row", "full_outer"), "by-row"), "row", "left")
    none = F.array().cast("array<string>")
    base_set, label_set = F.coalesce("base_set", none), F.coalesce("label_set", none)
    n = F.coalesce("n_left", F.lit(0)) + F.coalesce("n_base", F.lit(0))
    listing = lambda x: F.array_join(F.array_sort(x), ",")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        listing(base_set).alias("base_labels"),
        listing(F.array_union(base_set, label_set)).alias("labels"),
        (n / (n + 1)).alias("score"),
    )


def ascii_lower(text: F.Column) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    """The same scan over lists of words; RE2 shares the dialect that the rules use."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({p}, {quoted(label)}, {quoted(k)}, {quoted(pattern)})" for p, label, k, pattern in rules())
    places = " UNION ALL ".join(
        f"SELECT row, unnest(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {j}] = {quoted(x)}' for j, x in enumerate(words.split()))})) - 1 AS f, {quoted(label)} AS label FROM d"
        for words, label in BASE.items()
    )
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS ({places}), base AS (
  SELECT row, count(*) AS n_base, min(f) AS first_word, max(f) AS last_word, list(DISTINCT label) AS base_set FROM places GROUP BY row
), rules(priority, label, keyword, pattern) AS (VALUES
{values}
), s AS (SELECT row, ' ' || array_to_string(w, '  ') || ' ' AS spaced FROM d), tried AS (
  SELECT row, spaced, priority, label, pattern FROM s JOIN rules ON contains(spaced, keyword) AND regexp_matches(spaced, pattern)
), cut AS (
  SELECT *, regexp_extract_all(spaced, pattern) AS hits, regexp_split_to_array(spaced, pattern) AS parts FROM tried
), hit AS (
  SELECT row, priority, label, unnest(range(1, len(hits) + 1)) AS n, hits, parts FROM cut
), found AS (
  SELECT row, priority, label,
         (list_sum(list_transform(parts[1:n], lambda x: len(x) - len(replace(x, ' ', '')))) + coalesce(list_sum(list_transform(hits[1:n - 1], lambda x: len(x) - len(replace(x, ' ', '')))), 0)) // 2 AS f,
         f + (len(hits[n]) - len(replace(hits[n], ' ', ''))) // 2 - 1 AS l
  FROM hit
), kept AS (
  SELECT row, label FROM found x
  WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.row = x.row AND y.f <= x.f AND y.l >= x.l AND y.priority < x.priority)
), lefts AS (SELECT row, count(*) AS n_left, list(DISTINCT label) AS label_set FROM kept GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(base_set, []) || coalesce(label_set, []))), ','), '') AS labels,
       (coalesce(n_left, 0) + coalesce(n_base, 0)) / (coalesce(n_left, 0) + coalesce(n_base, 0) + 1) AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN lefts USING (row)
"""


OP5_SQL = _sql()
