"""Substring dedup by the common-prefix interval tree of an enhanced suffix array.

A window of ``length`` bytes holds an anchor, an n-gram whose hash is the smallest in the window; equal windows hold
equal anchors at equal places. So it is enough to compare places around anchors that recur. The context of an anchor is
all windows that it is the anchor of. Contexts that are the same bytes are one row from then on. Contexts of one anchor
form an enhanced suffix array: suffixes that begin at the anchor, sorted, with the common prefixes of neighbours. A
stack scan yields its interval tree; within an interval, whose members share that many bytes from the anchor on, members
are sorted by what stands left of the anchor, and a member is a repeat if what it shares to the left with some other
member makes up the length. All members of an interval are tested, not just neighbours in the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import restrict, small_batches, stored, tidy, without, work_dir
from tabulon.llm.shingles import anchors, mixed, ngram_hashes, runs

GRAM = 64
#: Unlike contexts of one anchor that are compared in one task; of more, every pair of blocks is.
CONTEXTS = 40_000
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def contexts(data: bytes, length: int) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(anchor, context's 128-bit hash, position, from, to) for every anchor of the bytes."""
    if len(data) < length:
        return
    grams = ngram_hashes(_BYTES[np.frombuffer(data, np.uint8)], GRAM)
    at = anchors(grams, length - GRAM + 1)
    for pos, anchor in zip(at.tolist(), grams[at].view(np.int64).tolist()):
        low, high = max(0, pos - length + GRAM), min(len(data), pos + length)
        yield anchor, xxhash.xxh3_128_digest(data[low:high], pos - low), pos, low, high


def halves(digests: list[bytes]) -> list[pa.Array]:
    """Two columns of longs for 128-bit hashes."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def rows_of(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), np.array([len(s) for s in strings])


def shared(table: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows x and y."""
    (held, lengths), out = table, []
    for i in range(0, len(x), 4096):
        a, b = x[i : i + 4096], y[i : i + 4096]
        unlike = held[a] != held[b]
        out.append(np.minimum(np.where(unlike.any(axis=1), unlike.argmax(axis=1), held.shape[1]), np.minimum(lengths[a], lengths[b])))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def intervals(prefixes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the array whose members share ``least`` or more, inner ones
    first; prefixes[i]: what suffixes i and i + 1 share."""
    stack: list[tuple[int, int]] = []
    for i, common in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > common:
            height, first = stack.pop()
            if height >= least:
                yield height, first, i
        if common >= 0 and (not stack or stack[-1][0] < common):
            stack.append((common, first))


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context how far its repeats reach to the left and to the right of the anchor; 0, 0: none.

    lefts: what stands before the anchor, backwards; rights: from the anchor on.
    """
    order = np.array(sorted(range(len(rights)), key=rights.__getitem__))
    rank = np.empty(len(lefts), np.int64)
    rank[sorted(range(len(lefts)), key=lefts.__getitem__)] = np.arange(len(lefts))
    left, right = rows_of(lefts, length), rows_of(rights, length)
    reach_left, reach_right = np.zeros(len(lefts), np.int64), np.zeros(len(lefts), np.int64)
    for common, first, last in intervals(shared(right, order[:-1], order[1:]).tolist(), GRAM):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        beside = shared(left, members[:-1], members[1:])
        most = np.maximum(np.append(0, beside), np.append(beside, 0))
        own = members[most + common >= length]
        reach_left[own] = np.maximum(reach_left[own], most[most + common >= length])
        reach_right[own] = np.maximum(reach_right[own], common)
    return reach_left, reach_right


def repeat_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(row, check, spans array<struct<start, end>>): where the whole texts repeat a string of ``length`` bytes, anywhere.

    ``docs(row long, check long, data binary)``: row and check together name a text; data is null for none. Rows with the
    same name have the same bytes. Spans may overlap and are not in order. Texts without a repeat have no row. Contexts
    and texts are told apart by 128 bits, contexts of one anchor that differ in them by their bytes.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "repeats")
    small_batches(spark)
    side = length - GRAM
    context = ["anchor", "c1", "c2"]

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [list(contexts(data, length)) if data else [] for data in part.column(2).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = [c for f in found for c in f]
                columns = [pa.array([c[0] for c in flat], pa.int64()), *halves([c[1] for c in flat]), part.column(0).take(owner), part.column(1).take(owner), pa.array([c[2] for c in flat], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*context, "row", "check", "pos"])

    seen = stored(docs.select("row", "check", "data").mapInArrow(tidy(see), "anchor long, c1 long, c2 long, row long, check long, pos long"), f"{path}/seen")
    each = seen.groupBy(*context).agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by("check", "row").alias("check"))
    unlike = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    recurring = seen.groupBy("anchor").agg(F.count("*").alias("total"), unlike.alias("unlike")).where("total > 1")
    each = stored(each.join(recurring.select("anchor", "unlike"), "anchor"), f"{path}/contexts")

    compared = each.where("unlike")
    blocks = compared.groupBy("anchor").agg(F.ceil(F.count("*") / CONTEXTS).alias("n_blocks")).where("n_blocks > 1")
    compared = compared.join(blocks, "anchor", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).withColumn("block", F.pmod("c1", "n_blocks"))
    compared = compared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    wanted = compared.groupBy("row", "check").agg(F.collect_list(F.struct(*context, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))).alias("wanted"))
    wanted = stored(wanted, f"{path}/wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for data, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = {(anchor, *np.frombuffer(c, np.int64).tolist()): (data[low:pos][::-1], data[pos:high]) for anchor, c, pos, low, high in contexts(data, length)}
                    out += [(w["anchor"], w["i"], w["j"], w["c1"], w["c2"], *own[w["anchor"], w["c1"], w["c2"]]) for w in asked]
                kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(7)], names=["anchor", "i", "j", "c1", "c2", "left", "right"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (anchor, _, _), (c1, c2, lefts, rights) in runs(batches, 3):
            reach = extents(list(lefts), list(rights), length)
            out += [(anchor, a, b, x, y) for a, b, x, y in zip(c1, c2, *map(np.ndarray.tolist, reach)) if y]
            if len(out) > 20_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*context, "left", "right"])

    texts = restrict(docs.select("row", "check", "data"), wanted.select("row"), "row").dropDuplicates(["row", "check"])
    fetched = texts.join(wanted, ["row", "check"]).select("data", "wanted").mapInArrow(tidy(fetch), "anchor long, i long, j long, c1 long, c2 long, left binary, right binary")
    fetched = fetched.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    partly = fetched.mapInArrow(tidy(scan), "anchor long, c1 long, c2 long, left long, right long")
    copied = each.where("n > 1").select(*context, F.lit(side).cast("long").alias("left"), F.lit(length).cast("long").alias("right"))
    reach = partly.unionByName(copied).groupBy(*context).agg(F.max("left").alias("left"), F.max("right").alias("right"))
    reach = stored(reach, f"{path}/reach")
    spans = seen.join(reach, context).select("row", "check", F.struct(F.greatest(F.lit(0), F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")).alias("span"))
    return stored(spans.groupBy("row", "check").agg(F.collect_set("span").alias("spans")), f"{path}/spans")


def cut(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many went, and in how many runs."""
    kept, at, n, removed = [], 0, 0, 0
    end = -1
    for span in sorted(spans, key=lambda s: s["start"]):
        if span["start"] > end:
            n += 1
            kept.append(data[max(end, 0) : span["start"]])
            end = span["start"]
        upto = min(span["end"], len(data))
        removed += max(0, upto - end)
        end = max(end, upto)
    kept.append(data[max(end, 0) :])
    return b"".join(kept), removed, n


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept binary`` for every row: its text without the bytes that a string
    of ``length`` bytes covers which also starts anywhere else.

    A null text is an empty one. Matches never cross rows; rows repeated under one doc_id with the same text are places
    of their own. Texts shorter than ``length`` stay as they are. An empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumns({"row": F.xxhash64("doc_id", "data"), "check": F.xxhash64(F.lit(1), "data", "doc_id")})
    spans = repeat_spans(rows, length)
    n = spans.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                data = part.column(1).to_pylist()
                done = [cut(d, s) for d, s in zip(data, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    touched = restrict(rows, spans.select("row"), "row", n).join(spans, ["row", "check"]).select("doc_id", "data", "spans").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    whole = without(rows, spans.select("row", "check"), ["row", "check"], n).select("doc_id", F.length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept"))
    return touched.unionByName(whole)
