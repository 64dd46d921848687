"""Hashes of words and n-grams, computed for whole documents at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tabulon.llm.common import cut

STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Maps a word to its 64-bit hash; forgets all when too many are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def forget() -> None:
    HASHES.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are hashed at a time; words beyond that are hashed by themselves.
PIECE = 1 << 16
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[[32, *range(9, 14)]] = 0
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE - 1, STEP)]), dtype=np.uint64)


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and lengths of a text's words, the runs without ASCII white space, with no object for each word."""
    found, at = [], 0
    for piece in cut(text, SPACE, PIECE):
        found += [(hashes, at + starts, lengths) for hashes, starts, lengths in _hashed(piece)]
        at += len(piece)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(f) for f in zip(*found)) if len(found) > 1 else found[0]


def _hashed(piece: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if len(piece) > 2 * PIECE:  # it ends in a word longer than all before
        *before, giant = piece.rsplit(None, 1)
        if before:
            yield from _hashed(piece[: len(piece) - len(giant)])
        yield np.array([xxhash.xxh64_intdigest(giant)], np.uint64), np.array([len(piece) - len(giant)]), np.array([len(giant)])
        return
    values = _BYTES.take(np.frombuffer(piece, np.uint8))
    inside = np.zeros(len(values) + 2, bool)
    inside[1:-1] = values != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return
    at = np.arange(starts[0], len(values)) - np.repeat(starts, np.append(starts[1:], len(values)) - starts)
    hashes = mixed(np.add.reduceat(values[starts[0] :] * _POWERS.take(at, mode="clip"), starts - starts[0]))
    for k in np.flatnonzero(lengths > PIECE).tolist():
        hashes[k] = xxhash.xxh64_intdigest(piece[starts[k] : starts[k] + lengths[k]])
    yield hashes, starts, lengths


def ngram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` units, by joining runs of doubled length."""
    length = len(units) - n + 1
    if length <= 0:
        return np.zeros(0, np.uint64)
    out, done, runs, size, factor = np.zeros(length, np.uint64), 0, units, 1, STEP
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out, done = out * factor + runs[done : done + length], done + size
            if size * 2 > n:
                return mixed(out)
            runs = runs[: len(runs) - size] * factor + runs[size:]
            factor, size = factor * factor, size * 2


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over every window of ``width`` values, in time that doesn't depend on the width."""
    n = len(values)
    rest = -n % width
    padded = np.concatenate([values, np.full(rest, values[-1], values.dtype)]).reshape(-1, width)
    forward = op.accumulate(padded, axis=1).ravel()
    backward = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(backward[: n - width + 1], forward[width - 1 : n])


def anchors(grams: np.ndarray, width: int, windows: np.ndarray | None = None) -> np.ndarray:
    """Positions of n-grams that are the smallest of some window of ``width`` positions, or of one of those that
    ``windows`` allows. Equal windows hold equal anchors at equal places, whatever surrounds them."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    least = sliding(grams, width, np.minimum)
    if windows is not None:
        least = np.where(windows, least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of rows whose first ``n_keys`` columns agree, from batches sorted by these: (key, columns)."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:n_keys] != key:
                if held:
                    yield key, list(zip(*held))
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, list(zip(*held))
