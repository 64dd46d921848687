"""Order-dependent operators: streaks, next events, budgets, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(df: DataFrame, key: str, order: list[str], hit: Column, least: int = 2) -> DataFrame:
    """(key, streak_start, streak_len) of consecutive rows where ``hit`` holds, of ``least`` rows or more."""
    all_rows = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(all_rows)).where(hit)
    island = numbered.withColumn("__island", F.col("__n") - F.row_number().over(all_rows))
    found = island.groupBy(key, "__island").agg(F.min("__n").alias("streak_start"), F.count("*").alias("streak_len"))
    return found.where(F.col("streak_len") >= least).drop("__island")


def water_fill(sizes: DataFrame, keys: list[str], size: str, budget: int, least: int) -> DataFrame:
    """(keys, given, capped): a budget shared out over the sizes of each key in ascending order, each getting its size, or
    an equal part of what is left, but that part no less than ``least``; what is given in all, and how many get less
    than their size.

    Equal sizes are counted first, so a task orders the distinct sizes of a key. From the first size on that is larger
    than ``least`` and than an equal part, every size gets an equal part: rounded down, and one more at the end for as
    many as the rest makes up.
    """
    counted = sizes.groupBy(*keys, size).agg(F.count("*").alias("c"))
    before = Window.partitionBy(*keys).orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    placed = counted.withColumns({"spent": F.coalesce(F.sum(F.col(size) * F.col("c")).over(before), F.lit(0)), "n": F.sum("c").over(every) - F.coalesce(F.sum("c").over(before), F.lit(0))})
    placed = placed.withColumn("left", F.greatest(F.lit(0), budget - F.col("spent"))).withColumn("over", (F.col(size) > least) & (F.col(size) * F.col("n") > F.col("left")))
    first = placed.where("over").groupBy(*keys).agg(F.min_by(F.struct("left", "n"), size).alias("f"))
    full = placed.where("NOT over").groupBy(*keys).agg(F.sum(F.col(size) * F.col("c")).alias("whole"))
    part, rest = F.floor(F.col("f.left") / F.col("f.n")), F.col("f.left") % F.col("f.n")
    # With a part of one less than the size, the last ones of that size may still get all of it.
    late = placed.where("over").groupBy(*keys, size).agg(F.sum("c").alias("c"), F.max("n").alias("n")).join(first, keys)
    reached = F.when((part >= least) & (F.col(size) == part + 1), F.greatest(F.lit(0), F.least(F.col("c"), F.col("c") - F.greatest(F.lit(0), F.col("n") - rest))))
    capped = late.groupBy(*keys).agg(F.sum(F.col("c") - F.coalesce(reached, F.lit(0))).alias("capped"))
    shared = F.when(part >= least, F.col("f.left")).otherwise(least * F.col("f.n"))
    out = sizes.select(*keys).distinct().join(full, keys, "left").join(first, keys, "left").join(capped, keys, "left")
    return out.select(*keys, (F.coalesce("whole", F.lit(0)) + F.coalesce(shared, F.lit(0))).cast("long").alias("given"), F.coalesce("capped", F.lit(0)).cast("long").alias("capped"))


def value_at(counted: DataFrame, keys: list[str], value: str, n: str, rank, name: str) -> DataFrame:
    """(keys, name): the value at a rank, counted from 1, of each key's values in order; ``rank`` is a function of how
    many there are, ``counted`` has each distinct value once with its number. A task orders distinct values."""
    up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"__to": F.sum(n).over(up_to), "__n": F.sum(n).over(Window.partitionBy(*keys))})
    hit = placed.where(F.col("__to") >= rank(F.col("__n")))
    return hit.groupBy(*keys).agg(F.min(value).alias(name)) if keys else hit.agg(F.min(value).alias(name))


def newest_within(df: DataFrame, key: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """Rows from the newest back, while their costs fit the budget and they are no more than ``most``; the newest always."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    spent = F.sum(cost).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = df.withColumn("__rank", F.row_number().over(back)).withColumn("__spent", spent)
    return ranked.where((F.col("__rank") == 1) | ((F.col("__spent") <= budget) & (F.col("__rank") <= most))).drop("__rank", "__spent")


def page(df: DataFrame, order: list[Column], after: Column, size: int) -> DataFrame:
    """Keyset paging: rows after a key, in order."""
    return df.where(after).orderBy(*order).limit(size)


def ceil_percentile(values: Column, p: float) -> Column:
    """The value at the ceiling of the rank (n - 1) * p, of an array that needn't be sorted."""
    return F.element_at(F.sort_array(values), (F.ceil((F.size(values) - 1) * p) + 1).cast("int"))


def ordered_markers(text: Column, markers: list[str]) -> Column:
    """Places (from 1) of each marker's first occurrence after the last one picked; 0, and no move, where there is none."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))

    def step(s: Column, marker: Column) -> Column:
        place = F.call_function("locate", marker, text, s["at"] + 1)
        return F.struct(F.greatest(s["at"], place).alias("at"), F.concat(s["places"], F.array(place)).alias("places"))

    return F.aggregate(F.array(*map(F.lit, markers)), start, step)["places"]
