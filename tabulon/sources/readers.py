"""Readers of files as sources: listings, JSON lines that may be broken, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(name, path, size, modified) of files, without reading their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, compressed or not; ``_corrupt_record`` holds lines that aren't JSON."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def lines(texts: DataFrame, text: str, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of each text, counted from 1, both included."""
    every = texts.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return every.where(F.col("line_no").between(first, last))


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows of, and leaves the others: staged by Spark, then moved in place."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
