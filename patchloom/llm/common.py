"""Shared pieces of the training-data operators: table access, scratch tables, skew-proof lookups."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy from this share of all rows; so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1 / 500

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the cluster names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="patchloom-"))
    return _OWN_DIR[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch, so that Python workers hold little of long texts at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES; it stays so for later queries."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables in the shared folder.

    A written table cuts the lineage, survives lost executors, and gives Spark the true size for its own choice
    between a broadcast and a shuffle join.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        bound_batches(spark)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps now, not when the driver happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for df in tables:
            delete(self.spark, df._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lookup(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to one group row per key, where a few keys may own a large share of the rows.

    groups holds the exact number of rows of each key in column size. Keys with at least HEAVY_SHARE of all rows are
    at most 1 / HEAVY_SHARE in number whatever the input, so they are broadcast; the rest is joined by a shuffle whose
    largest key is under that share. Both tables should be written ones: each is read twice.
    """
    keys = [key] if isinstance(key, str) else key
    extra = [c for c in groups.columns if c not in keys]
    least = max(2, int(total * HEAVY_SHARE))
    heavy = groups.where(F.col(size) >= least)
    light = groups.where(F.col(size) < least)
    hot = rows.join(F.broadcast(heavy), keys).select(*rows.columns, *extra)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "left").select(*rows.columns, *extra)
    return hot.unionByName(cold)
