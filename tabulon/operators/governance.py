"""Ingest decisions and guarded state tables: what to skip, reject, update or hand on, as joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import dedup

#: States that a run can be in, and where it may go from each.
MOVES = {"created": ("queued", "running", "cancelled", "failed"), "queued": ("running", "cancelled", "failed"), "running": ("succeeded", "failed", "cancelled", "unsettled")}
ACTIVE = tuple(MOVES)


def equivalent(remote: DataFrame, recorded: DataFrame, by: list[str]) -> DataFrame:
    """(by, equivalent): whether the files of each document are those that were recorded: the same names, and of each
    the same etag, or where one is missing the same date, or where one is missing the same size.

    Both sides: (by, name, etag, modified, size).
    """
    old = recorded.select(*by, "name", *[F.col(c).alias(f"old_{c}") for c in ("etag", "modified", "size")], F.lit(True).alias("was"))
    both = remote.withColumn("is", F.lit(True)).join(old, [*by, "name"], "full")
    given = lambda c: F.col(c).isNotNull() & F.col(f"old_{c}").isNotNull()
    same = lambda c: F.col(c) == F.col(f"old_{c}")
    alike = F.when(given("etag"), same("etag")).when(given("modified"), same("modified")).when(given("size"), same("size")).otherwise(True)
    return both.groupBy(*by).agg(F.bool_and(F.col("is").isNotNull() & F.col("was").isNotNull() & F.coalesce(alike, F.lit(True))).alias("equivalent"))


def skip_reason(previous_complete: Column, previous_version: Column, version: str, previous_fingerprint: Column, fingerprint: Column, same_files: Column, overwrite: bool = False) -> Column:
    """Why a download needn't be made again; null where it must."""
    blank = F.coalesce(F.trim(previous_fingerprint), F.lit("")) == ""
    known = F.coalesce(previous_complete, F.lit(False)) & (F.coalesce(previous_version, F.lit("")) == version)
    reason = F.when(~blank & (previous_fingerprint == fingerprint), "source_fingerprint_matched").when(F.coalesce(same_files, F.lit(False)), "remote_files_equivalent")
    return F.lit(None).cast("string") if overwrite else F.when(known, reason)


def unrejected(found: DataFrame, registry: DataFrame, key: str, version: str) -> DataFrame:
    """Rows that weren't rejected by this version of the rules."""
    return found.join(registry.where(F.col("download_version") == version).select(key).distinct(), key, "left_anti")


def unchanged(a: str, b: str, columns: list[str]) -> Column:
    """All columns of two joined rows agree, nulls with nulls."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def settle(runs: DataFrame, now: Column, alive: DataFrame, least_age: str) -> DataFrame:
    """Active runs whose owner is gone, if they are old enough, become unsettled; all others stay as they are."""
    living = alive.select(F.col("owner"), F.lit(True).alias("__alive")).distinct()
    old = (now - F.coalesce("started_at", "created_at")) >= F.expr(f"INTERVAL {least_age}")
    lost = F.col("state").isin(*ACTIVE) & F.col("__alive").isNull() & old
    return runs.join(living, "owner", "left").withColumns({"error": F.when(lost, "orphan").otherwise(F.col("error")), "completed_at": F.when(lost, now).otherwise(F.col("completed_at")), "state": F.when(lost, "unsettled").otherwise(F.col("state"))}).drop("__alive")


def transition(rows: DataFrame, wanted: Column) -> DataFrame:
    """``state`` after an asked-for move, and ``moved``: whether the guard let it through."""
    allowed = F.create_map(*[F.lit(x) for a, to in MOVES.items() for b in to for x in (f"{a}>{b}", True)])
    ok = F.coalesce(F.try_element_at(allowed, F.concat(F.col("state"), F.lit(">"), wanted)), F.lit(False))
    return rows.withColumns({"moved": ok, "state": F.when(ok, wanted).otherwise(F.col("state"))})


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table with those new rows whose key isn't there yet, the first of each key."""
    first = dedup.keep_best(new, keys, order)
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti").select(table.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The table with changed values in place of the old ones and with the new keys; a null value changes nothing. One
    full join; rows that no change names go through it unchanged."""
    both = table.alias("a").join(changes.alias("b"), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"b.{v}"), F.col(f"a.{v}")).alias(v) for v in values])


def fresh(cache: DataFrame, now: Column, at: str, hours: int = 24) -> DataFrame:
    """Cached rows that aren't older than their time to live."""
    return cache.where(F.col(at) > now - F.make_dt_interval(hours=F.lit(hours)))


def truncated(value: Column, strategy: str, most: int) -> Column:
    """A result cut to its limit: characters, lines, list items, or bytes."""
    if strategy == "text_chars":
        return F.substring(value, 1, most)
    if strategy == "text_lines":
        return F.array_join(F.slice(F.split(value, "\n"), 1, most), "\n")
    if strategy == "list_items":
        return F.slice(value, 1, most)
    if strategy == "binary_bytes":
        return F.substring(value.cast("binary"), 1, most)
    raise ValueError(f"no such way to cut: {strategy}")
