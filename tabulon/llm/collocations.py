"""Phrases whose words belong together, by growing frequent prefixes to the right.

Each chunk of the corpus learns how often its words and pairs occur in all of it (see ``grams``). A frequent pair is a
prefix: wherever it stands, what follows it, as far as pairs stay frequent, is projected to the task of that prefix. The
task holds the projected places of a bucket of prefixes and grows each depth-first: the places of a phrase are split by their next
word, and those of a longer phrase that is still frequent are split again. A prefix with very many places is shared by
several tasks, each with its own next words, so that every longer phrase still has all its places in one task; places
with the same following words are one entry with a count.

Defined results of odd rows: a null text counts as '', a null language as ``und``; every row counts, so repeated rows
count again; a piece without a second word has no phrase; an empty table gives no row. A piece of any length is read as
a whole: where a chunk ends within it, the words after a place come along. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import grams
from tabulon.llm.common import BROADCAST_ROWS, cut, small_batches, stored, tidy, work_dir
from tabulon.llm.shingles import runs

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate inside a longer one with at least so many hundredths of its places is dropped.
INSIDE_PERCENT = 80
SCALE = 2_000_000
#: A prefix with more places is shared by several tasks.
PLACES = 1_000_000
UNKNOWN_LANGUAGE = "und"

ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(ENDS) + b" " + bytes(range(97, 123)))
_BETWEEN = re.compile(rb"[ \t.,;:!?\n-\r]")
CHUNKS = "chunk long, langs array<string>, n_words array<int>, said array<long>, words binary, tokens binary, length binary, own binary"
PLACED = "bucket int, lang string, places binary"
#: Buckets of prefixes for each shard of tokens.
BUCKETS = 4
GROWN = "lang string, phrase binary, size int, a long, firsts array<long>"


def _sequences(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of each piece and at how many of them phrases start here; the last words of a piece that goes on in the next
    part of a very long text come again with it."""
    carried: list[bytes] = []
    before = None
    for part in [*cut(text, _BETWEEN), None]:
        if before is not None:
            pieces = before.translate(_PLAIN).split(b"\n")
            for k, piece in enumerate(pieces):
                words = carried + piece.split()
                carried = []
                if part is not None and k == len(pieces) - 1:
                    own = max(0, len(words) - LONGEST + 1)
                    carried = words[own:]
                else:
                    own = len(words)
                if own:
                    yield words, own
        before = part


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    partition = TaskContext.get().partitionId()
    made = count()
    numbers: defaultdict[str, grams.Numbers] = defaultdict(grams.Numbers)
    held: list[tuple[str, np.ndarray, list[int], list[int]]] = []
    size = 0

    def closed() -> pa.RecordBatch:
        nonlocal size
        langs = list(numbers)
        n_words = [len(numbers[lang]) for lang in langs]
        first = dict(zip(langs, np.cumsum([0, *n_words]).tolist()))
        said = Counter()
        for lang, _, _, own in held:
            said[lang] += sum(own)
        columns = [
            pa.array([partition << 32 | next(made)], pa.int64()),
            pa.array([langs], pa.list_(pa.string())),
            pa.array([n_words], pa.list_(pa.int32())),
            pa.array([[said[lang] for lang in langs]], pa.list_(pa.int64())),
            pa.array([b"\n".join(w for lang in langs for w in numbers[lang])], pa.binary()),
            pa.array([np.concatenate([tokens + np.int32(first[lang]) for lang, tokens, _, _ in held]).tobytes()], pa.binary()),
            *[pa.array([np.concatenate([np.array(x[k], np.int32) for x in held]).tobytes()], pa.binary()) for k in (2, 3)],
        ]
        numbers.clear(), held.clear()
        size = 0
        return pa.RecordBatch.from_arrays(columns, ["chunk", "langs", "n_words", "said", "words", "tokens", "length", "own"])

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            words, length, own = [], [], []
            for found, starts in _sequences(text):
                words += found
                length.append(len(found))
                own.append(starts)
                if len(words) >= most:
                    held.append((lang, numbers[lang].of(words), length, own))
                    words, length, own = [], [], []
                    yield closed()
            if words:
                held.append((lang, numbers[lang].of(words), length, own))
                size += len(words)
                if size >= most:
                    yield closed()
    if held:
        yield closed()


class Places:
    """Words and pairs of one chunk, and where they stand."""

    def __init__(self, row: dict):
        self.words = row["words"].split(b"\n")
        self.langs = np.repeat(np.arange(len(row["langs"])), row["n_words"])
        self.tokens = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
        length, own = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("length", "own"))
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(length) - length, length)
        self.left = np.repeat(length, length) - place - 1  # words that follow in the piece
        self.starts = place < np.repeat(own, length)
        size = len(self.words)
        at = np.flatnonzero(self.left > 0)
        pairs, which = np.unique(self.tokens[at] * size + self.tokens[at + 1], return_inverse=True)
        self.first, self.second = pairs // size, pairs % size
        self.pair = np.full(len(self.tokens), -1)
        self.pair[at] = which
        seeds = [xxhash.xxh64_intdigest(lang) for lang in row["langs"]]
        word = grams.word_keys(self.words, [seeds[k] for k in self.langs.tolist()])
        self.keys = [word, grams.joined_keys(word[self.first], word[self.second])]
        self.own = [np.bincount(self.tokens[self.starts], minlength=size), np.bincount(which[self.starts[at]], minlength=len(pairs))]


def _send(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = Places(row)
            for size, (keys, own) in enumerate(zip(found.keys, found.own), 1):
                yield grams.sent(row["chunk"], size, keys, own, shards)


def _project(chunks: pa.Table, answers: pa.Table, shards: int, buckets: int, least: int, places: int) -> pa.Table:
    """What follows each frequent pair in one chunk: for each bucket and language a packed text with a line ". w1 w2 part n
    n1 n2" for each prefix, and under it "w3 w4 n" for what follows. No word begins with a full stop."""
    row = chunks.to_pylist()[0]
    found = Places(row)
    by_size: list[dict[int, bytes]] = [{}, {}]
    for size, shard, blob in zip(*(answers[c].to_pylist() for c in ("size", "shard", "totals"))):
        by_size[size - 1][shard] = blob
    n1, n2 = (grams.received(keys, got, shards) for keys, got in zip(found.keys, by_size))
    none = len(found.words)
    frequent = np.append(n2 >= least, False)  # the last one: no pair
    pair, tokens = found.pair, found.tokens
    at = np.flatnonzero(found.starts & frequent[pair] & (found.left > 1))
    at = at[frequent[pair[at + 1]]]
    further = (found.left[at] > 2) & frequent[pair[np.minimum(at + 2, len(pair) - 1)]]
    fourth = np.where(further, tokens[np.minimum(at + 3, len(tokens) - 1)], none)
    parts = -(-n2 // places)
    tails = (pair[at] * (none + 1) + tokens[at + 2]) * (none + 1) + fourth
    tails, n = np.unique(tails, return_counts=True)
    tails, w4 = np.divmod(tails, none + 1)
    which, w3 = np.divmod(tails, none + 1)
    lines: defaultdict[tuple[int, int], list[bytes]] = defaultdict(list)
    names = [*found.words, b""]
    for p, third, last, times, shared in zip(which.tolist(), w3.tolist(), w4.tolist(), n.tolist(), (parts[which] > 1).tolist()):
        lines[p, zlib.crc32(names[third]) % int(parts[p]) if shared else 0].append(b"%b %b %d" % (names[third], names[last], times))
    for p in np.flatnonzero(frequent[:-1]).tolist():
        lines[p, 0]  # a prefix that nothing frequent follows is a phrase too
    key = found.keys[1][:, 0]
    out: defaultdict[tuple[int, int], list[bytes]] = defaultdict(list)
    for (p, part), theirs in lines.items():
        first, second = int(found.first[p]), int(found.second[p])
        out[(int(key[p]) + part) % buckets, int(found.langs[first])] += [b". %b %b %d %d %d %d" % (names[first], names[second], part, n2[p], n1[first], n1[second]), *theirs]
    packer = zstandard.ZstdCompressor(level=3)
    columns = [[bucket for bucket, _ in out], [row["langs"][lang] for _, lang in out], [packer.compress(b"\n".join(x)) for x in out.values()]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary()))], names=["bucket", "lang", "places"])


def _grow(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of each prefix of a bucket, from its projected places of all chunks."""
    out: list[tuple] = []

    def passed_on() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "a", "firsts"])

    unpacker = zstandard.ZstdDecompressor()
    for (_, lang), (blobs,) in runs(batches, 2):
        prefixes: defaultdict[bytes, dict[bytes, int]] = defaultdict(dict)
        for blob in blobs:
            tails: dict[bytes, int] = {}
            for line in unpacker.decompress(blob).split(b"\n"):
                if line[:1] == b".":
                    tails = prefixes[line]
                else:
                    tail, _, n = line.rpartition(b" ")
                    tails[tail] = tails.get(tail, 0) + int(n)
        for prefix in list(prefixes):
            out += grown(lang, prefix.split(b" ")[1:], prefixes.pop(prefix), least)
            if len(out) >= 2000:
                yield passed_on()
    if out:
        yield passed_on()


def grown(lang: str, prefix: list[bytes], places: dict[bytes, int], least: int) -> list[tuple]:
    """The prefix and the phrases that it grows to: (lang, phrase, words, places, places of its beginnings)."""
    w1, w2 = prefix[:2]
    part, total, n1, n2 = map(int, prefix[2:])
    out = [] if part else [(lang, w1, 1, n1, []), (lang, w2, 1, n2, []), (lang, w1 + b" " + w2, 2, total, [n1])]
    tails, n = [tail.split(b" ") for tail in places], list(places.values())

    def extend(phrase: bytes, pointers: list[int], depth: int, firsts: list[int]) -> None:
        by_word: defaultdict[bytes, list[int]] = defaultdict(list)
        for pointer in pointers:
            if word := tails[pointer][depth]:
                by_word[word].append(pointer)
        for word, theirs in by_word.items():
            if (f := sum(n[pointer] for pointer in theirs)) >= least:
                longer = phrase + b" " + word
                out.append((lang, longer, depth + 3, f, firsts))
                if depth + 3 < LONGEST:
                    extend(longer, theirs, depth + 1, [*firsts, f])

    extend(w1 + b" " + w2, list(range(len(tails))), 0, [n1, total])
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, chunk_tokens: int = grams.CHUNK_TOKENS, shard_tokens: int = grams.SHARD_TOKENS, places: int = PLACES) -> DataFrame:
    """``docs(text, lang)`` -> ``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to 4 words.

    ``a``: places of the phrase; ``l`` and ``r``: those of its two parts at the lowest-scoring cut; ``n``: all words of the
    language; ``score``: floor(SCALE * a / (l + r)).
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = work_dir(spark, "collocations")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = stored(texts.mapInArrow(tidy(lambda batches: _chunks(batches, chunk_tokens)), CHUNKS), f"{path}/chunks", **grams.ROW_GROUPS)
    words = chunks.select(F.explode(F.arrays_zip("langs", "said")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.said").alias("n"))
    words = stored(words, f"{path}/words")
    shards = grams.shards_for(words.agg(F.sum("n")).first()[0] or 0, shard_tokens)
    answers = stored(grams.totals(chunks.mapInArrow(tidy(lambda batches: _send(batches, shards)), grams.SENT)), f"{path}/totals", **grams.ROW_GROUPS)
    buckets = shards * BUCKETS
    projected = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda c, a: _project(c, a, shards, buckets, least, places), PLACED)
    # As many tasks as buckets, since each holds one bucket at a time.
    tasks = projected.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang")
    found = tasks.mapInArrow(tidy(lambda batches: _grow(batches, least)), GROWN).withColumn("phrase", F.col("phrase").cast("string"))
    found = stored(found, f"{path}/grown")

    candidates = found.where("size > 1")
    parts = candidates.select("lang", "phrase", "a").unionByName(found.where("size = 1").groupBy("lang", "phrase").agg(F.max("a").alias("a")))
    said = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", F.posexplode("firsts").alias("k", "l"), said.alias("said"))
    cuts = cuts.withColumn("rest", F.array_join(F.expr("slice(said, k + 2, size(said))"), " ")).drop("said")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.call_function("div", whole("a") * F.lit(SCALE).cast("decimal(10,0)"), whole("l") + whole("r"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    inside = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(F.expr(inner))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * INSIDE_PERCENT))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    kept = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    kept = kept.join(F.broadcast(words) if words.count() <= BROADCAST_ROWS else words, "lang")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def whole(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")
