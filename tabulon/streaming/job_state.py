"""Jobs as keyed state of a stream: progress with the last issues, requests that join a job under way, expiry after the end.

Both keep their state in Spark's state store on disk (set STORE before the stream starts), one key for a job or a request, and run on event time, so that a
stream that is replayed gives the same. Events may come late (within the watermark), out of order and more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Issues that a job remembers, minutes that an ended job is remembered, states of a job under way.
ISSUES, MINUTES = 5, 60
RUNNING, ENDED, FAILED = "running", ("succeeded", "failed", "cancelled"), "failed"

EVENTS = "job string, event_id long, ts timestamp, kind string, detail string"
SNAPSHOT = "job string, status string, stage string, completed long, failed long, issues array<string>, finished_us long"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def status_of(kind: str) -> str:
    return kind if kind in ENDED else RUNNING


class Progress(StatefulProcessor):
    """Counters and the latest event as a value, the last issues as a list; both go ``MINUTES`` after the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "stage string, at long, event_id long, completed long, failed long, status string, finished long, ended long")
        self.issues = handle.getListState("issues", "at long, event_id long, detail string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.job.get()
        stage, at, completed, failed, status, finished, ended = (held[0], (held[1], held[2]), *held[3:]) if held else (None, None, 0, 0, RUNNING, None, None)
        ring = [tuple(x) for x in self.issues.get()]
        for r in rows:
            here = (r["at"], r["event_id"])
            completed += r["kind"] in ("completed", "item_failed")
            if r["kind"] == "item_failed":
                failed += 1
                ring.append((*here, r["detail"]))
            if at is None or here > at:
                stage, at = r["kind"], here
            if r["kind"] in ENDED and (finished is None or here < (finished, ended)):
                status, (finished, ended) = r["kind"], here
        ring = sorted(ring)[-ISSUES:]
        self.job.update((stage, *at, completed, failed, status, finished, ended))
        if ring:
            self.issues.put(ring)
        if finished:
            self.handle.registerTimer(finished // 1000 + MINUTES * 60_000)
        yield Row(job=key[0], status=status, stage=stage, completed=completed, failed=failed, issues=[detail for *_, detail in ring], finished_us=finished)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.job.clear()
        self.issues.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """A stream of EVENTS -> SNAPSHOT of each job that a batch has touched (update mode).

    An event that comes again within ``late`` counts once. The stage is that of the latest event, the issues are the last
    ISSUES by time, and the first event that ends a job decides its status. A job is forgotten MINUTES after its end.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "event_id"]).withColumn("at", F.unix_micros("ts"))
    states = once.groupBy("job").transformWithState(Progress(), SNAPSHOT, "Update", "EventTime")
    return states.withColumn("finished_at", F.timestamp_micros("finished_us")).drop("finished_us")


def progress_of_all(events: DataFrame) -> DataFrame:
    """The same of all events at once: what a stream's last snapshot of each job is, if none was forgotten before."""
    once = events.dropDuplicates(["job", "event_id"])
    order = F.struct("ts", "event_id")
    of_job = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id"))
    issues = once.where("kind = 'item_failed'").withColumn("n", F.row_number().over(of_job)).where(F.col("n") <= ISSUES)
    issues = issues.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "detail"))).alias("i")).select("job", F.col("i.detail").alias("issues"))
    ending = F.when(F.col("kind").isin(list(ENDED)), order)
    jobs = once.groupBy("job").agg(
        F.coalesce(F.min_by("kind", ending), F.lit(RUNNING)).alias("status"), F.max_by("kind", order).alias("stage"),
        F.count_if(F.col("kind").isin("completed", "item_failed")).alias("completed"), F.count_if(F.col("kind") == "item_failed").alias("failed"), F.min(ending)["ts"].alias("finished_at"),
    )
    return jobs.join(issues, "job", "left").select("job", "status", "stage", "completed", "failed", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), "finished_at")


def fingerprint(kind: Column, payload: Column) -> Column:
    """What two requests for the same have in common: the kind and the payload with its keys in order."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))))
    return F.sha2(F.concat_ws("\x1f", kind, F.coalesce(ordered, payload, F.lit(""))), 256)


REQUESTS = "fingerprint string, event_id long, ts timestamp, ends boolean"
ANSWERS = "fingerprint string, event_id long, job long, outcome string"


class Requests(StatefulProcessor):
    """The job under way of a fingerprint: a request starts one or joins it, an end closes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "job long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.active.get()
        job = held[0] if held else None
        for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            if r["ends"]:
                job = None
            elif job is None:
                job = r["event_id"]
                yield Row(fingerprint=key[0], event_id=r["event_id"], job=job, outcome="started")
            else:
                yield Row(fingerprint=key[0], event_id=r["event_id"], job=job, outcome="reused_active_job")
        if job is None:
            self.active.clear()
        else:
            self.active.update((job,))

    def close(self) -> None:
        pass


def answered(requests: DataFrame) -> DataFrame:
    """A stream of REQUESTS -> ANSWERS: whether a request started a job or joined the one under way of its fingerprint.

    Requests and ends of a batch are taken in the order of their time; a job without an end stays under way.
    """
    return requests.groupBy("fingerprint").transformWithState(Requests(), ANSWERS, "Append", "None")


def answered_at_once(requests: DataFrame) -> DataFrame:
    """The same of all requests: the first one, or the first one behind an end, starts a job."""
    by_time = Window.partitionBy("fingerprint").orderBy("ts", "event_id")
    marked = requests.withColumn("starts", ~F.col("ends") & F.coalesce(F.lag("ends").over(by_time), F.lit(True)))
    job = F.last(F.when(F.col("starts"), F.col("event_id")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("job", job).where("NOT ends")
    return found.select("fingerprint", "event_id", "job", F.when(F.col("starts"), "started").otherwise("reused_active_job").alias("outcome"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what its source has now; each batch is written as a folder of its own, so that one that is run
    again replaces itself, and all are read back with their number as ``batch``."""
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema.add("batch", "long")).option("basePath", path).parquet(path)


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each job."""
    columns = [c for c in snapshots.columns if c != "batch"]
    return snapshots.groupBy("job").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("s.*")
