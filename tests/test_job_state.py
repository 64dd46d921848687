"""Streams with keyed state against batches over the same events, late and repeated ones included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulon.streaming import job_state


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in job_state.STORE}
    for k, v in job_state.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def moment(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def files(spark, tmp_path, rows, schema, parts):
    """A stream that takes one file at a time."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts < 0 else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_progress_is_the_fold_of_all_events(spark, tmp_path, store):
    rng = random.Random(3)
    rows = []
    for job in range(12):
        n = rng.choice([1, 4, 15])
        kinds = ["started", *rng.choices(["completed", "item_failed", "skipped"], k=n), *rng.choice([["succeeded"], ["failed"], []])]
        rows += [(f"j{job}", job * 100 + k, moment(k + rng.random()), kind, f"d{k}") for k, kind in enumerate(kinds)]
    rows += rng.choices(rows, k=30)  # some come again
    rng.shuffle(rows)  # and out of order
    stream = files(spark, tmp_path, rows, job_state.EVENTS, 4)
    snapshots = job_state.run_to_table(job_state.progress(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = job_state.latest(snapshots).collect()
    want = job_state.progress_of_all(spark.createDataFrame(rows, job_state.EVENTS)).collect()
    assert len(got) == 12 and sorted(map(tuple, got)) == sorted(map(tuple, want)) and snapshots.select("batch").distinct().count() >= 4
    assert max(len(r["issues"]) for r in got) == job_state.ISSUES


def test_an_ended_job_is_forgotten_after_an_hour(spark, tmp_path, store):
    first = [("a", 1, moment(0), "item_failed", "x"), ("a", 2, moment(1), "succeeded", None)]
    later = [("other", 3, moment(400), "started", None)]
    again = [("a", 4, moment(401), "completed", None)]
    for k, rows in enumerate((first, later, later, again)):
        spark.createDataFrame([(j, e + 10 * k, t + dt.timedelta(seconds=k), kind, x) for j, e, t, kind, x in rows], job_state.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(job_state.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = job_state.latest(job_state.run_to_table(job_state.progress(stream), f"{tmp_path}/out", f"{tmp_path}/check"))
    assert [(r["status"], r["completed"], r["issues"]) for r in got.where("job = 'a'").collect()] == [("running", 1, [])]


def test_requests_join_the_job_under_way(spark, tmp_path, store):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(4)}", k, moment(k), rng.random() < 0.25) for k in range(80)]
    stream = files(spark, tmp_path, rows, job_state.REQUESTS, 3)
    got = job_state.run_to_table(job_state.answered(stream), f"{tmp_path}/out", f"{tmp_path}/check", "append").drop("batch").collect()
    want = job_state.answered_at_once(spark.createDataFrame(rows, job_state.REQUESTS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["outcome"] for r in got} == {"started", "reused_active_job"}


def test_fingerprints(spark):
    rows = [("download", '{"b": 1, "a": 2}'), ("download", '{"a": 2, "b": 1}'), ("process", '{"a": 2, "b": 1}'), ("download", None), ("download", "not json")]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, p string").select(job_state.fingerprint(F.col("k"), F.col("p"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 4
