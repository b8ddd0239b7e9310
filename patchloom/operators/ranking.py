"""Filters and rankings of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import level_rank


def consistent(df: DataFrame, level: str, confidence: str, least_level: str, least_confidence: float) -> DataFrame:
    """Rows of a level and a confidence at least as high as asked."""
    return df.where((level_rank(F.col(level)) >= level_rank(F.lit(least_level))) & (F.col(confidence) >= least_confidence))


def select_top(df: DataFrame, keys: list[str], n: int, order: str, score: str = "score", distance: str = "distance") -> DataFrame:
    """The n best rows of each key with a positive score, with their rank: higher scores, then nearer, then input order.

    The rank limit is applied before the shuffle too, so a key with many candidates costs n rows per task.
    """
    by = Window.partitionBy(*keys).orderBy(F.desc(score), F.coalesce(F.col(distance), F.lit(float("inf"))), order)
    return df.where(F.col(score) > 0).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def majority(yes: Column, votes: Column, share: float) -> Column:
    return yes >= F.ceil(votes * share)


def seeded_order(df: DataFrame, key: str, size: str, seed: int) -> DataFrame:
    """place of each row by size, ties in an order that the seed fixes: the same everywhere and at any partitioning."""
    mixed = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("tie", mixed).withColumn("place", F.dense_rank().over(Window.partitionBy(size).orderBy("tie", key)))
