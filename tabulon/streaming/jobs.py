"""Streams of pipeline events: progress per job, first requests, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame) -> DataFrame:
    """State of each job so far: counters, the latest event, and whether it has ended."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"),
        F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id")))["event_id"].alias("last_issue"),
    )


def first_requests(events: DataFrame, ttl: str = "60 minutes") -> DataFrame:
    """Requests without those that repeat one within ``ttl``."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["user_id", "event_type", "props"])


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n")


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events with every subscription on their user, or on their type; two equi-joins, since Spark can't hash an OR."""
    by_user = events.join(subscriptions.where("by_user IS NOT NULL"), F.col("user_id") == F.col("by_user"))
    by_type = events.join(subscriptions.where("by_user IS NULL"), F.col("event_type") == F.col("by_type"))
    return by_user.unionByName(by_type)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what its source has now, and gives its result."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
