"""Corpus-wide counts of n-grams for tasks that each hold a chunk of the corpus.

A chunk numbers its distinct n-grams and sends their keys and own counts, as sorted arrays, to shards. A shard adds up
what all chunks sent of a key and answers each of them with the totals in the order of its keys. So no n-gram becomes a
row, a key in every chunk costs one entry for each, and a task holds one chunk or one shard. Chunks and shards have
about CHUNK_TOKENS and SHARD_TOKENS tokens, parameters to be raised with the memory of an executor, since there is a
row for each chunk and shard.

A word is known by 64 bits within its shard, and its shard follows from 64 further bits. Callers may do with fewer
``bits`` for longer n-grams: with 48 bits and shards of 3,000,000 n-grams, one in 10^8 is counted with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shingles import STEP, mixed

CHUNK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 21
#: Writer's options of tables with a row for each chunk or answer: row groups of about 8 MB, whose size is looked at after
#: each row, not after a hundred, since a task holds a whole one when it writes and when it reads; and no least and greatest
#: values, since the writer holds those of all row groups, here whole chunks, until its file ends.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.column.statistics.enabled": "false"}

SENT = "chunk long, size int, shard int, keys binary, n binary"
TOTALS = "chunk long, size int, shard int, totals binary, known long"


def packed(values: np.ndarray) -> bytes:
    """64-bit values, byte planes apart, so that leading zeros cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


class Numbers(dict):
    """Numbers things in the order in which they are first met."""

    def __missing__(self, thing) -> int:
        self[thing] = n = len(self)
        return n

    def of(self, things: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, things), np.int32, len(things))


def word_keys(words: list[bytes], seeds: list[int] | None = None) -> np.ndarray:
    """Two columns of 64 bits for each word: key and spread."""
    found = map(xxhash.xxh3_128_digest, words, seeds) if seeds else map(xxhash.xxh3_128_digest, words)
    return np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, 2)


def joined_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(left * STEP + right + STEP)


def _ordered(keys: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by shard and key in which n-grams are sent, where each shard starts in it, and the keys so ordered."""
    shard = (keys[:, 1] % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    key = keys[:, 0] >> np.uint64(64 - bits)
    order = np.argsort(key)
    order = order[np.argsort(shard[order], kind="stable")]
    return order, np.searchsorted(shard[order], np.arange(shards + 1)), key[order]


def sent(chunk: int, size: int, keys: np.ndarray, n: np.ndarray, shards: int, bits: int = 64) -> pa.RecordBatch:
    """Rows of SENT: the distinct n-grams of ``size`` words of a chunk and how often it counts each."""
    order, start, key = _ordered(keys, shards, bits)
    n = n[order]
    to = np.flatnonzero(np.diff(start))
    own = [slice(start[shard], start[shard + 1]) for shard in to.tolist()]
    blobs = [[packed(np.diff(key[x], prepend=np.uint64(0))) for x in own], [packed(n[x]) for x in own]]
    constants = [pa.array([chunk] * len(to), pa.int64()), pa.array([size] * len(to), pa.int32()), pa.array(to, pa.int32())]
    return pa.RecordBatch.from_arrays([*constants, *[pa.array(x, pa.binary()) for x in blobs]], ["chunk", "size", "shard", "keys", "n"])


def received(keys: np.ndarray, answers: dict[int, bytes], shards: int, bits: int = 64) -> np.ndarray:
    """The totals of a chunk's n-grams from the shards' answers."""
    order, start, _ = _ordered(keys, shards, bits)
    totals = np.zeros(len(keys), np.int64)
    for shard in np.flatnonzero(np.diff(start)).tolist():
        totals[order[start[shard] : start[shard + 1]]] = unpacked(answers[shard])
    return totals


def _added_up(rows: pa.Table) -> pa.Table:
    with np.errstate(over="ignore"):
        keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in rows["keys"].to_pylist()]
    n = np.concatenate([unpacked(x) for x in rows["n"].to_pylist()]).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    per_key = np.add.reduceat(n[order], first)
    totals = np.empty(len(keys), np.int64)
    totals[order] = np.repeat(per_key, np.diff(first, append=len(keys)))
    answers = [packed(x) for x in np.split(totals, ends[:-1])]
    known = pa.array([int((per_key > 0).sum())] + [0] * (len(answers) - 1), pa.int64())
    return pa.table({"chunk": rows["chunk"], "size": rows["size"], "shard": rows["shard"], "totals": pa.array(answers, pa.binary()), "known": known})


def totals(counts: DataFrame) -> DataFrame:
    """Rows of SENT -> rows of TOTALS; ``known`` adds up to the n-grams of a size that were counted at all."""
    return counts.groupBy("size", "shard").applyInArrow(_added_up, TOTALS)


def shards_for(tokens: int, shard_tokens: int = SHARD_TOKENS) -> int:
    return max(1, -(-tokens // shard_tokens))
