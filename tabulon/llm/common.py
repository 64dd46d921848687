"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be no more than this many longs.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 400, 4 << 20

_LOCAL_BASE: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode, where it is unset, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="tabulon-")
        atexit.register(shutil.rmtree, _LOCAL_BASE[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_LOCAL_BASE[app]}/rdd")
    return f"file://{_LOCAL_BASE[app]}"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of bounded rows and bytes, so that a batch stays small on either side.

    The limits are settings of the session, since Spark reads them when a job starts; smaller ones are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if int(spark.conf.get(key).rstrip("b")) not in range(1, most + 1):
            spark.conf.set(key, str(most))


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` over batches; when a task ends its worker forgets what it remembers and gives its memory back, since Spark
    keeps workers for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(items: list, size: int) -> Iterator[list]:
    """The items in order, up to ``size`` at a time."""
    for at in range(0, len(items), size):
        yield items[at : at + size]


def cut(text: bytes, between: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end where ``between`` matches, so that no word is cut."""
    at = 0
    while at < len(text):
        end = between.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def content_key(*columns: str) -> Column:
    """16 bytes that stand for the values: enough that no two unlike rows of any corpus share them."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])))


def work_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors. ``options`` are the
    writer's."""
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
    del df  # while anything remembers how it was made, its shuffle files stay
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of a finished step once the driver has
    forgotten the step, which without memory pressure it would not for a long time. What the first round frees holds
    what the second finds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def restrict(df: DataFrame, keys: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Left semi join of ``df`` with the distinct longs ``keys``.

    ``keys`` goes to every executor only if its counted rows are within BROADCAST_ROWS; beyond that Spark joins by
    shuffle.
    """
    rows = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, column, "left_semi")


def without(df: DataFrame, keys: DataFrame, column: str | list[str], rows: int) -> DataFrame:
    """Left anti join, by the same rule as ``restrict``; ``rows``: how many keys there are."""
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, column, "left_anti")


def components(edges: DataFrame, path: str) -> DataFrame:
    """Connected components of ``edges(a, b)``, of longs or bytes -> ``(node, root)`` with the smallest node as root.

    Every round contracts each node into the smallest of its neighbourhood, so the edge table at least halves its
    components per round and is empty after a logarithmic number of rounds. Each round's tables are written.
    """
    edges = edges.where("a <> b")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, f"{path}/edges-0")
    roots, step = None, 0
    while not both.isEmpty():
        step += 1
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        smallest = stored(smallest, f"{path}/smallest-{step}")
        if roots is None:
            roots = smallest.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            up = smallest.select(F.col("a").alias("root"), "to")
            roots = roots.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = stored(roots, f"{path}/roots-{step}")
        left, right = smallest.select("a", F.col("to").alias("x")), smallest.select(F.col("a").alias("b"), F.col("to").alias("y"))
        both = both.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        both = stored(both, f"{path}/edges-{step}")
    if roots is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
