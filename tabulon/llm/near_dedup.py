"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams are one class and go on as one row. Each class gets a MinHash signature cut
into bands; classes are shuffled on their band hashes, and pairs that share one are verified on their full n-gram sets.
Buckets of many classes are cut into blocks and compared block by block, so that no task holds more than two blocks,
and what leaves a task is a row for each class, not for each pair.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, components, content_key, restrict, small_batches, stored, tidy, work_dir
from tabulon.llm.shingles import HASHES, forget, mixed, ngram_hashes, runs

_WORD = re.compile(r"\w+")


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which ``recall`` is reached at the threshold within ``most`` hashes."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; a text of fewer words has one n-gram of all its words, if any."""
    words = _WORD.findall(text.lower()) if text else []
    return np.unique(ngram_hashes(HASHES.of(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def minhash_bands(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band."""
    draw = np.random.default_rng(5)
    a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024, None]
        np.minimum(least, (part * a + b).min(axis=0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out ^ least[k::rows])
    return out.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of n-grams that two sets share."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for start in range(0, (column[-1] + 1) if len(column) else 0, width):
        i, j = np.searchsorted(column, [start, start + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[i:j], column[i:j] - start] = 1
        shared += held @ held.T
    return shared


def compare_blocks(threshold: float):
    """For groups (band, key, i, j) of rows (block, digest, size, bands, shingles): digest, links, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, i, j), (block, names, size, bands, shingles) in runs(batches, 4):
            sets = [np.frombuffer(s, np.uint64) for s in shingles]
            lengths, block = np.array([len(s) for s in sets], np.float32), np.array(block)
            shared = overlaps(sets)
            linked = shared >= threshold * (lengths[:, None] + lengths[None, :] - shared) - 1e-4
            if i != j:
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            earlier = np.array(bands, np.int64).reshape(len(sets), -1)[:, :band]
            for k in range(band):  # a pair counts in the first band that it shares, and in no later one
                linked &= earlier[:, None, k] != earlier[None, :, k]
            found = np.flatnonzero(linked.any(axis=1))
            if len(found):
                links = linked[np.ix_(found, found)]
                weight, root = np.array(size)[found], np.arange(len(found))
                while True:
                    least = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (least == root).all():
                        break
                    root = least
                own = pa.array([names[i] for i in found.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array(links @ weight), own.take(pa.array(root))], names=["digest", "links", "root"])

    return run


def near_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 1024, block_grams: int = 1_000_000) -> DataFrame:
    """doc_id, content, group, class_id and n_links for every row of ``docs``, as ``jaccard_join`` has them; content is a
    key of (doc_id, text), and group, the same for all rows that links connect, is null for texts without a word.

    ``block`` and ``block_grams`` bound the classes, and on average the n-grams, of a block of a bucket.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "jaccard")
    small_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long"), content_key("doc_id", "text").alias("content"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sets = [shingle_set(t, n) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([minhash_bands(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "content", "digest", "n_grams", "bands"])

    signed = stored(texts.mapInArrow(tidy(sign, forget), "doc_id long, content binary, digest binary, n_grams long, bands array<long>"), f"{path}/signed")
    known = signed.where("digest IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("content").alias("content"), F.count("*").alias("size"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = stored(classes, f"{path}/classes")

    banded = classes.select("digest", "n_grams", F.posexplode("bands").alias("band", "key"))
    one, two = F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("h1"), F.bit_xor(F.xxhash64("digest", F.lit(2))).alias("h2")
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"), one, two).where("n > 1")
    # Buckets of the same classes would compare the same pairs: the one of the first band stands for all.
    n_blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("grams") / block_grams)).alias("n_blocks")
    buckets = buckets.groupBy("n", "grams", "h1", "h2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", n_blocks)
    buckets = stored(buckets, f"{path}/buckets")
    members = classes.select("digest", "content", "size", "bands", F.posexplode("bands").alias("band", "key"))
    members = members.join(F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets, ["band", "key"])
    members = stored(members.withColumn("block", F.pmod(F.xxhash64("digest"), "n_blocks")), f"{path}/members")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                sets = [shingle_set(t, n) for t in batch.column(0).slice(start, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    # The n-grams of a class are those of one text of it; copies of that row, if there are any, are one.
    wanted = stored(members.select("content").distinct(), f"{path}/wanted")
    sets = restrict(texts, wanted, "content").dropDuplicates(["content"]).select("text").mapInArrow(tidy(full, forget), "digest binary, shingles binary")
    paired = members.join(sets, "digest").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    paired = paired.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "size", "bands", "shingles")
    paired = paired.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    links = stored(paired.mapInArrow(tidy(compare_blocks(threshold)), "digest binary, links long, root binary"), f"{path}/links")

    roots = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")), f"{path}/components")
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    found = classes.select("digest", "first_id", "size").join(counted, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    found = stored(found.select("digest", F.coalesce("root", "digest").alias("group"), "first_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), f"{path}/found")
    ids = found.groupBy("group").agg(F.min("first_id").alias("class_id"))
    named = found.select("digest", "group", "n_links").join(ids, "group")
    out = signed.select("doc_id", "content", "digest").join(named, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return out.select("doc_id", "content", "group", own, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 1024) -> DataFrame:
    """doc_id, class_id and n_links for every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of ``n`` lower-cased words is at least ``threshold``;
    n_links counts the other rows that a row is linked to, and class_id is the smallest doc_id that links lead to.
    Pairs at the threshold are found with probability ``recall``, more similar ones with more.

    A null text, an empty one and one without words is linked to none. Texts shorter than ``n`` words count as one
    n-gram. Repeated rows are copies of each other; rows of one doc_id with unlike texts are told apart by their
    texts. Rows with a null doc_id take part; a class of such rows alone has a null class_id. An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    return near_groups(docs, n, threshold, recall, block).select("doc_id", "class_id", "n_links")
