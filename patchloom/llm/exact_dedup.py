"""Operator 2, exact deduplication: a persistent digest index, bucketed and sorted by digest.

A batch of new rows is reduced to one row per digest, compared with the index by a sort-merge anti-join (the index is
read bucket by bucket, so only the batch is shuffled), and what the index lacks is appended to it. Everything runs on
DataFrame functions.

A bucket gets a file with every batch, each sorted; Spark takes a bucket for sorted only while it has one file, so from the second
batch on the join sorts the buckets it reads, each in one task.

Defined cases: a null text counts as empty, and empty texts are equal to each other; of rows with the same digest the one
with the smallest doc_id stays, a null doc_id coming last; of rows that repeat doc_id and text exactly one stays. An
empty table gives an empty result. Columns besides doc_id and text are carried by the stage and ignored by the query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup, shuffle_partitions, table

BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text: F.Column) -> F.Column:
    """SHA-256 of the text with every run of blanks made one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256))


class DigestIndex:
    """A catalog table digest -> (keep_id, keep_uid, group_size, batch), bucketed and sorted by digest.

    batch tells which batch brought the digest in: keep_uid is a row of that batch, and group_size counts its rows. buckets
    defaults to the session's number of shuffle partitions, so that the anti-join and the append need no exchange of their own.
    """

    SCHEMA = "digest binary, keep_id long, keep_uid long, group_size long, batch string"

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], self.SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the groups of rows (digest, doc_id, uid) whose digest is new; all groups of rows, with their sizes."""
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
        groups = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        # written first: else the optimizer moves the anti-join below the aggregate, and copies are shuffled unreduced
        groups = Scratch(self.spark, "digest-groups").save(groups, "groups")
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size", F.lit(batch or uuid.uuid4().hex).alias("batch")))
        return groups.select("digest", "group_size")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a number of each row, to be written once before use."""
    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("uid"))


def exact_dedup(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """A row per document of docs: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the rows of docs. With an index of earlier batches, nothing is kept whose digest it has already.
    """
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.save(digests(docs), "digests")
    own, index = index is None, index or DigestIndex(spark)
    batch = uuid.uuid4().hex
    sizes = index.add(rows, batch)
    groups = scratch.save(index.read().drop("group_size").join(sizes, "digest"), "groups")
    if own:
        index.drop()
    found = lookup(rows, groups, "digest", "group_size", rows.count())
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == batch) & (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    The kept ids are joined on digest and doc_id together, so a group of copies is spread over the partitions.
    """
    scratch = Scratch(spark, "exact-dedup")
    index = DigestIndex(spark)
    index.add(scratch.save(digests(docs), "digests"))
    # all-null keys cannot meet in an equi-join, so a null doc_id is compared as the largest long
    key = lambda c: F.coalesce(c, F.lit(2**63 - 1))
    kept = scratch.save(index.read().select(F.col("digest").alias("__digest"), key(F.col("keep_id")).alias("__key")), "kept")
    index.drop()
    # the row travels as one struct, so that no column of docs can clash with the keys
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("row"), text_digest(F.col("text")).alias("__digest"), key(F.col("doc_id")).alias("__key"))
    one = F.row_number().over(Window.partitionBy("__digest", "__key").orderBy("__key"))
    stay = marked.join(kept.hint("shuffle_hash"), ["__digest", "__key"], "left_semi")
    return stay.withColumn("place", one).where("place = 1").select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
