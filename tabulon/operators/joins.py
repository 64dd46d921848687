"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points with every range that holds them (both ends included): an equi-join on buckets of ``width``, then the exact
    test. A range is there once for each bucket that it touches, a point once."""
    cut = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(cut(low), cut(high))))
    return points.withColumn("__bucket", cut(at)).join(spread, "__bucket").where(F.col(at).between(F.col(low), F.col(high))).drop("__bucket")


def asof(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its key at or before its time: one union and one window,
    where a join would pair every row with all that came before."""
    kept = [c for c in left.columns]
    mine = left.select(*kept, F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values])
    other = right.select(*[F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept], F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    past = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = mine.unionByName(other).select(*kept, "__side", *[F.last(f"__{v}", ignorenulls=True).over(past).alias(v) for v in values])
    return filled.where("__side = 1").drop("__side")


def containing(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, by: str, words: int = 3) -> DataFrame:
    """Texts with every phrase that they contain literally, whatever the case; ``by`` names a text, once each.

    A phrase's key is a run of ``words`` of its inner words, since the first and last may be parts of longer words in a
    text. A shorter phrase goes by its longest word: the texts' distinct words that hold it are found by a piece of up to
    three letters. One without any word goes by its first character. Only names and keys are joined; what passes is
    tested on the texts.
    """
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    numbered = phrases.withColumns({"__w": split(phrase), "__p": F.xxhash64(*phrases.columns)})
    keyed = numbered.where(F.size("__w") >= words + 2).select("__p", F.array_join(F.slice("__w", 2, words), " ").alias("__key"))
    source = texts.select(by, split(text).alias("__w"), F.lower(text).alias("__t"))
    runs = F.transform(F.sequence(F.lit(0), F.size("__w") - words), lambda i: F.array_join(F.slice("__w", i + 1, words), " "))
    long = source.where(F.size("__w") >= words).select(by, F.explode(F.array_distinct(runs)).alias("__key")).join(keyed, "__key").select(by, "__p")

    longest = F.array_max(F.transform("__w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = numbered.where((F.size("__w") < words + 2) & (F.size("__w") > 0)).select("__p", longest.alias("__long"))
    short = short.withColumn("__piece", F.substring("__long", 1, 3))
    each = source.select(by, F.explode(F.array_distinct("__w")).alias("__word"))
    pieces = F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__word") - n + 1)), lambda i, n=n: F.substring("__word", i, F.lit(n))) for n in (1, 2, 3)])))
    holding = each.select("__word").distinct().withColumn("__piece", F.explode(pieces)).join(short, "__piece").where(F.contains("__word", "__long")).select("__word", "__p")
    brief = each.join(holding, "__word").select(by, "__p")
    bare = numbered.where((F.size("__w") == 0) & (F.length(phrase) > 0)).select("__p", F.substring(F.lower(phrase), 1, 1).alias("__c"))
    odd = source.select(by, F.explode(F.array_distinct(F.split("__t", ""))).alias("__c")).join(bare, "__c").select(by, "__p")

    pairs = long.unionByName(brief).unionByName(odd).distinct()
    found = texts.join(pairs, by).join(numbered.drop("__w"), "__p").where(F.contains(F.lower(text), F.lower(phrase)))
    return found.drop("__p")


def digits(c: Column) -> Column:
    """An identifier's digits without leading zeros."""
    return F.regexp_replace(F.regexp_replace(c, r"\D", ""), "^0+", "")


def directed(roles: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """Rows of ``roles(…, subject, filed_by)`` whose subject is a target and that someone else has filed."""
    keyed = targets.withColumn("__key", digits(F.col(target)))
    found = roles.withColumn("__key", digits(F.col("subject"))).where((F.col("__key") != "") & (F.col("__key") != digits(F.col("filed_by"))))
    return found.join(keyed, "__key").drop("__key")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
