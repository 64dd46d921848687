"""Named queries: a function of the tables, and, where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder as DataFrames, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


PLANS: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def plan(sql: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        PLANS[function.__name__] = (function, sql)
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
