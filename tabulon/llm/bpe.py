"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent bytes that occurs inside no token of the vocabulary can't be merged across, so it is a certain cut.
A text is cut at such pairs, the fragments are encoded independently, and their ids are concatenated. The encoder
pre-tokenises by a pattern, so a certain pair is used as a cut only where the pattern sees the same pieces on either
side: where white space begins, or after an ASCII letter or digit. Neither position is looked over by the pattern.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm.common import small_batches, tidy

#: Fragments remembered by a worker before it forgets them all, and the longest one that is remembered.
REMEMBERED, LONGEST = 150_000, 64
SPACES = b" \t\n\x0b\x0c\r"
_CODECS: dict[str, Codec] = {}


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec(dict):
    """Maps a fragment's bytes to its ids, as the bytes of 32-bit numbers; encodes what it hasn't seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("forced boundaries need a byte-level BPE without normaliser and prefix space")
        symbols, added = byte_of_symbol(), {t["content"] for t in spec["added_tokens"]}
        tokens = {i: t.encode() if t in added else bytes(symbols[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        inside = np.zeros(65536, bool)
        for token in self.bytes_of:
            for a, b in pairwise(token):
                inside[a << 8 | b] = True
        first, second = np.divmod(np.arange(65536), 256)
        alnum = (first < 128) & np.array([chr(c).isalnum() for c in first])
        self.cut = ~inside & (np.isin(second, list(SPACES)) | alnum)

    def __missing__(self, fragment: bytes) -> bytes:
        ids = array("i", self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids).tobytes()
        if len(fragment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = ids
        return ids

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode()
        raw = np.frombuffer(data, np.uint8).astype(np.uint16)
        at = np.flatnonzero(self.cut[raw[:-1] << 8 | raw[1:]]) + 1
        return [data[i:j] for i, j in pairwise([0, *at.tolist(), len(data)])] if data else []

    def packed(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.fragments(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def forget() -> None:
    for own in _CODECS.values():
        own.clear()


def encode_decode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of every row, ``ids array<int>`` of its whole text, and ``decoded`` from those ids.

    ``vocabulary`` is a tokenizer file that every executor can open. A null or empty text has no ids and decodes to an
    empty text; repeated rows stay repeated; no rows give no rows; other columns are ignored, and ``ids`` and
    ``decoded`` among ``keep`` are refused. A special token's string in a text becomes its id, as in the tokenizer.
    """
    if clash := {"ids", "decoded", "__text"} & set(keep):
        raise ValueError(f"keep can't hold {sorted(clash)}")
    source = docs.select(*keep) if text in keep else docs.select(*keep, docs[text].alias("__text"))
    at, n_kept = keep.index(text) if text in keep else len(keep), len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n_kept])

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [own.packed(t or "") for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                out = [*part.columns[:n_kept], lists, pa.array([own.decode(x.tolist()) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "ids", "decoded"])

    return source.mapInArrow(tidy(run, forget), f"{fields + ', ' if fields else ''}ids array<int>, decoded string")
