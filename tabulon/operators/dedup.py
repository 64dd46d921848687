"""Keep-first and keep-best: one row of each key, by an order that leaves no ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark filters by rank before it shuffles, so a task sends n rows of a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def best_value(df: DataFrame, keys: list[str], value: Column, score: Column, name: str) -> DataFrame:
    """The value with the largest score of each key: an aggregate, combined before it is shuffled."""
    return df.groupBy(*keys).agg(F.max_by(value, score).alias(name))


def mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key, the smallest of the most frequent."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))
