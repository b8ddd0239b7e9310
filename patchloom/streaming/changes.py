"""Streams of change records: row-local work as they arrive, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changes(spark: SparkSession, folder: str, schema: str, form: str = "parquet") -> DataFrame:
    return spark.readStream.format(form).schema(schema).load(folder)


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append the results of a row-local step as files, each input file once."""
    return step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by key and time window; a window closes once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select("window.start", key, "n")
