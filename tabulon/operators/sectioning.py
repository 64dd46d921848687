"""Sections of a filing from the headings in its text: markers, tables of contents, ordered picks, and what lies between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters between two headings that are no more than lines of a table of contents, and how many of them make one.
CONTENTS_SPAN, CONTENTS_RUN, LEAST = 120, 4, 3


def placed_lines(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, position, line)`` with ``at``, the characters before each of its document's lines."""
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def markers(lines: DataFrame, item: Column, order: Column) -> DataFrame:
    """(doc_id, idx, at, line) of the lines that head an item of ``order``, an array; idx counts from 0."""
    found = lines.withColumn("idx", F.array_position(order, item).cast("int") - 1).where("idx >= 0")
    return found.select("doc_id", "idx", "at", "line")


def contents_end(found: DataFrame) -> DataFrame:
    """(doc_id, cursor): where the table of contents ends, -1 without one.

    It is a run of ``CONTENTS_RUN`` markers or more from the first one on, each close to the next. The marker behind the
    run is the last entry, unless items begin again with it.
    """
    order = Window.partitionBy("doc_id").orderBy("at", "idx")
    near = found.withColumns({"n": F.row_number().over(order), "gap": F.lead("at").over(order) - F.col("at"), "before": F.lag("idx").over(order), "last": F.lag("at").over(order)})
    stop = near.where((F.col("gap") >= CONTENTS_SPAN) | F.col("gap").isNull()).groupBy("doc_id").agg(F.min_by(F.struct("n", "at", "idx", "before", "last"), "n").alias("s"))
    again = F.col("s.idx") <= F.col("s.before")
    end = F.when(F.col("s.n") <= CONTENTS_RUN, -1).when(again, F.col("s.last")).otherwise(F.col("s.at"))
    return stop.select("doc_id", F.coalesce(end, F.lit(-1)).cast("long").alias("cursor"))


def ordered_picks(found: DataFrame, cursors: DataFrame | None, least: int = LEAST) -> DataFrame:
    """(doc_id, idx, at): of each item in order the first marker behind the last one picked; documents with fewer than
    ``least`` picks have none. A fold over the items; a document's markers are one array."""
    every = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "idx"))).alias("m"), F.max("idx").alias("top"))
    every = every.withColumn("cursor", F.lit(-1).cast("long")) if cursors is None else every.join(cursors, "doc_id", "left").withColumn("cursor", F.coalesce("cursor", F.lit(-1)))
    begin = F.struct(F.col("cursor").alias("at"), F.array().cast("array<struct<idx:int,at:bigint>>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        nearest = F.array_min(F.transform(F.filter("m", lambda x: (x["idx"] == k) & (x["at"] > s["at"])), lambda x: x["at"]))
        return F.struct(F.coalesce(nearest, s["at"]).alias("at"), F.when(nearest.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(k.alias("idx"), nearest.alias("at"))))).alias("out"))

    picked = every.select("doc_id", F.aggregate(F.sequence(F.lit(0), "top"), begin, step)["out"].alias("out")).where(F.size("out") >= least)
    return picked.select("doc_id", F.explode("out").alias("o")).select("doc_id", "o.idx", "o.at")


def first_picks(found: DataFrame) -> DataFrame:
    """(doc_id, idx, at): the first marker of each item, whatever their order."""
    return found.groupBy("doc_id", "idx").agg(F.min("at").alias("at"))


def spans(picks: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, idx, start, end): each section up to the next one, the last up to ``ends(doc_id, end)``."""
    following = F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))
    return picks.withColumn("next", following).join(ends, "doc_id", "left").select("doc_id", "idx", F.col("at").alias("start"), F.coalesce("next", "end").alias("end"))
