"""Exact dedup by a stateful stream over content digests.

The stream keeps one state row per digest in RocksDB, without expiry: how many rows had the digest, and of the row that
stays its length, stable identifier and content locator. State is built by Spark's own streaming aggregation, which
combines the rows of a digest before they are shuffled, so a group with a third of all rows costs a few rows a task.
A second reading compares the full bytes of every hit with those of its group's row; digests whose bytes differ are
grouped anew by the bytes themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, content_key, restrict, stored, work_dir

#: Characters that don't count when texts are compared: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: State is kept on disk, its changes are written rather than snapshots, no disk is set aside beforehand, and all the
#: stores of an executor together have a bounded part of its memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
}
#: Copies of one text that are compared with the same replica of the row that stays.
COPIES_A_REPLICA = 1_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_of(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def content_of() -> Column:
    """Finds a row's content again: a key of its identifier and text."""
    return content_key("doc_id", "text")


def signatures(docs: DataFrame, digest=digest_of) -> DataFrame:
    """(digest, doc_id, n_chars, locator, row): the locator names the file and the row's content in it, row tells rows
    apart that are alike."""
    locator = F.struct(F.input_file_name().alias("file"), content_of().alias("content"))
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long"), n_chars.alias("n_chars"), locator.alias("locator"), F.monotonically_increasing_id().alias("row"))


def best(n_chars: str = "n_chars") -> Column:
    """The row that stays is the smallest of these: most code points first, then the smallest doc_id."""
    return F.struct((-F.col(n_chars)).alias("shorter"), F.col("doc_id"), F.col("locator"), F.col("row"))


def keep_state(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs the stateful stream over the signatures until its source is read: (digest, group_size, stays).

    A batch writes the state of the digests that it changed; the last such state of a digest holds.
    """
    spark = stream.sparkSession
    state = stream.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(best()).alias("stays"))
    written: list[int] = []

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch-{batch}")
        written.append(batch)

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not written:
        return spark.createDataFrame([], state.schema)
    found = spark.read.parquet(*[f"{out}/batch-{b}" for b in sorted(set(written))])
    if len(set(written)) == 1:
        return found.drop("batch")
    return found.groupBy("digest").agg(F.max_by(F.struct("group_size", "stays"), "batch").alias("s")).select("digest", "s.group_size", "s.stays")


def exact_dedup(docs: DataFrame, digest=digest_of, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, content, n_chars, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after their blanks are deleted; null counts as empty. Of equal texts the row with the
    most code points in the original text stays, then that with the smallest doc_id (a null one sorts first). Repeated
    rows count one by one, and one of them is ``kept``. An empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "exact-dedup")
    rows = stored(signatures(docs, digest), f"{path}/signatures")
    stream = spark.readStream.schema(rows.schema)
    stream = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(f"{path}/signatures")
    state = keep_state(stream, f"{path}/state", f"{path}/checkpoint")
    groups = stored(state, f"{path}/groups")

    differing = stored(differing_hits(docs, groups.where("group_size > 1"), digest), f"{path}/differing")
    if differing.isEmpty():
        groups, rows = groups.withColumnRenamed("digest", "key"), rows.withColumn("key", F.col("digest"))
    else:
        rows = stored(keyed_by_bytes(docs, rows, differing, digest), f"{path}/keyed")
        again = rows.join(differing, "digest", "left_semi").groupBy("key").agg(F.count("*").alias("group_size"), F.min(best()).alias("stays"))
        groups = groups.join(differing, "digest", "left_anti").withColumnRenamed("digest", "key").unionByName(again)
    return rows.join(groups, "key").select(
        "doc_id",
        F.col("locator.content").alias("content"),
        "n_chars",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def with_bytes(docs: DataFrame, digest) -> DataFrame:
    normal = normalised(F.col("text"))
    return docs.select(digest(normal).alias("digest"), content_of().alias("content"), normal.alias("normal"))


def differing_hits(docs: DataFrame, several: DataFrame, digest) -> DataFrame:
    """Digests under which some row's normalised bytes aren't those of the row that stays. Copies are dealt over
    replicas of that row, one for each COPIES_A_REPLICA of them."""
    n = several.count()
    short = F.xxhash64("digest").alias("short")
    found = restrict(with_bytes(docs, digest).withColumn("short", short), several.select(short).distinct(), "short", n)
    small = several.select("digest", F.col("stays.locator.content").alias("first"), F.floor(F.col("group_size") / COPIES_A_REPLICA).cast("long").alias("last"))
    found = found.join(F.broadcast(small) if n <= BROADCAST_ROWS // 10 else small, "digest")
    firsts = found.where("content = first").dropDuplicates(["digest"])
    firsts = firsts.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("replica"), F.col("normal").alias("bytes"))
    copies = found.withColumn("replica", F.pmod(F.xxhash64("content"), F.col("last") + 1)).select("digest", "replica", "normal")
    return copies.join(firsts, ["digest", "replica"]).where("normal <> bytes").select("digest").distinct()


def keyed_by_bytes(docs: DataFrame, rows: DataFrame, differing: DataFrame, digest) -> DataFrame:
    """The rows with ``key``: their digest, and for differing digests their bytes too."""
    texts = with_bytes(docs, digest).join(differing, "digest", "left_semi").select("content", "normal").dropDuplicates(["content"])
    named = rows.withColumn("content", F.col("locator.content")).join(texts, "content", "left").drop("content")
    return named.withColumn("key", F.concat_ws("|", "digest", "normal")).drop("normal")
