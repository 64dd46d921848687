"""Substring dedup by repeated-phrase automata.

Every window of ``window`` words holds an anchor, a short word n-gram whose hash is the smallest in the window; equal
windows hold equal anchors. Anchors that recur leave few windows that can repeat; these are counted, and the recurring
ones, taken together where they stand in the first document that has them, are the passages. Passages are dealt over
shards by that document, and every shard compiles their words into an Aho-Corasick automaton. All documents are streamed
through the automata, but for those without a window that has the hash of one of a shard's: these can't hold a window of
it. A hit places a passage against the document, and what is equal there, word by word, for a window or more is an
occurrence; nothing is removed by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, discard, restrict, small_batches, stored, tidy, without, work_dir
from tabulon.llm.shingles import PIECE, anchors, hashed_words, ngram_hashes, sliding

GRAM = 6
#: Words of the passages in a shard, and documents that one copy of a shard's automaton streams.
SHARD_WORDS, SHARD_DOCS = 60_000, 4_000
NO_ID = -(1 << 63)


def words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, which is what splitting bytes goes by."""
    return text.split() if text else []


class Windows:
    """Hashes of the words, n-grams and windows of some texts, of which no window has words of two."""

    def __init__(self, texts: list[bytes | None], window: int):
        texts = [t or b"" for t in texts]
        self.hashes, starts, _ = hashed_words(b"\n".join(texts))
        self.owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        self.width = window - GRAM + 1
        some = len(self.hashes) >= window
        self.grams = ngram_hashes(self.hashes, GRAM) if some else np.zeros(0, np.uint64)
        self.whole = self.owner[: 1 - window] == self.owner[window - 1 :] if some else np.zeros(0, bool)

    @cached_property
    def at(self) -> np.ndarray:
        return anchors(self.grams, self.width, self.whole)

    def anchors(self) -> np.ndarray:
        return self.grams[self.at].view(np.int64)

    def windows(self, window: int) -> np.ndarray:
        return ngram_hashes(self.hashes, window).view(np.int64)

    def smallest(self) -> np.ndarray:
        """The anchor of each window."""
        return sliding(self.grams, self.width, np.minimum).view(np.int64)


def together(texts: list[bytes | None]) -> Iterator[slice]:
    """Texts that are hashed at once, since a call for each takes longer than the work on a short one."""
    first = size = 0
    for k, text in enumerate(texts, 1):
        size += len(text or b"")
        if size >= PIECE or k == len(texts):
            yield slice(first, k)
            first, size = k, 0


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(start, rows).columns]


def packed(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def counted(hashes: list[np.ndarray], ids: list[int]) -> list[np.ndarray]:
    """For each distinct hash: how often it is there, and the smallest id that has it."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    flat = np.concatenate([hashes[i] for i in order])
    owner = np.repeat(np.array([ids[i] for i in order], np.int64), [len(hashes[i]) for i in order])
    found, first, n = np.unique(flat, return_index=True, return_counts=True)
    return [found, owner[first], n]


def seen_anchors(ids: np.ndarray, texts: list[bytes | None], window: int) -> list[np.ndarray]:
    """The texts' distinct anchors, whose each is, and how often it has it."""
    w = Windows(texts, window)
    found, owner = w.anchors(), w.owner[w.at]
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))[: len(found)])
    return [found[first], ids[owner[first]], np.diff(np.append(first, len(found)))]


def recurring_anchors(texts: DataFrame, window: int, path: str) -> DataFrame:
    """(id, anchors): the anchors of each document that are there at two places of the table at least."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in batches_of(batches, 512):
            for some in together(own):
                yield packed(seen_anchors(np.array(ids[some], np.int64), own[some], window), ["anchor", "id", "n"])

    seen = stored(texts.mapInArrow(tidy(see), "anchor long, id long, n long"), f"{path}/anchors")
    recurring = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    found = seen.select("anchor", "id").join(recurring, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    found = stored(found, f"{path}/recurring")
    discard(texts.sparkSession, f"{path}/anchors")
    return found


def place(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values are in a sorted array, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def candidates(texts: list[bytes | None], known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' windows whose anchor recurs, and how many each text has. ``known``: the texts' anchors that
    recur; one that does is known of every text that has it, so all texts' may be looked up together."""
    w = Windows(texts, window)
    if not len(w.grams):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(w.whole & place(w.smallest(), np.unique(known))[0])
    return w.windows(window)[at], np.bincount(w.owner[at], minlength=len(texts))


def candidate_windows(held: DataFrame, window: int, path: str) -> DataFrame:
    """(id, hashes): each document's candidates, hashed once for the two steps that read them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for some in together(texts):
                part = batch.slice(some.start, some.stop - some.start)
                hashes, n = candidates(texts[some], part.column(2).flatten().to_numpy(), window)
                lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n)), hashes).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "hashes"])

    return stored(held.mapInArrow(tidy(each), "id long, hashes array<long>").where(F.size("hashes") > 0), f"{path}/hashes")


def recurring_windows(hashed: DataFrame, path: str) -> DataFrame:
    """(hash, source): windows that are at two places of ``hashed(id, hashes)`` at least, and the first document that
    has them. A hash only says what to look for: what is removed was found word by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            own = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            if len(lists):
                yield packed(counted(own, batch.column(0).to_pylist()), ["hash", "id", "n"])

    found = hashed.mapInArrow(tidy(count), "hash long, id long, n long").groupBy("hash").agg(F.min("id").alias("source"), F.sum("n").alias("n"))
    return stored(found.where("n > 1").select("hash", "source"), f"{path}/windows")


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64("source"), F.lit(n_shards)).alias("shard")


def routes(hashed: DataFrame, windows: DataFrame, n_shards: int, path: str) -> DataFrame:
    """(id, shard): the shards with a window that has the hash of one of the document's. One that has none of a shard's
    can't hold any of its windows, so every document that could is streamed through that shard, and no other: where
    shared anchors alone decided, a large group of near copies went to every shard, each of them in full."""
    shards = windows.select("hash", shard_of(n_shards))
    return stored(hashed.select("id", F.explode("hashes").alias("hash")).join(shards, "hash").select("id", "shard").distinct(), f"{path}/routes")


def passages(held: DataFrame, windows: DataFrame, window: int, path: str) -> DataFrame:
    """(source, start, passage, anchors): runs of recurring windows of which no document before ``source`` has one, nor
    an earlier place in it."""
    firsts = stored(windows.groupBy(F.col("source").alias("id")).agg(F.collect_list("hash").alias("hashes")), f"{path}/firsts")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, known, hashes in batches_of(batches, 128):
            out: list[tuple] = []
            for source, text, anchor, mine in zip(ids, texts, known, hashes):
                w = Windows([text], window)
                every, first = np.unique(w.windows(window), return_index=True)
                at = np.sort(first[np.isin(every, np.array(mine, np.int64))])
                own, inside, recurs = words(text), w.at, np.isin(w.anchors(), np.array(anchor, np.int64))
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    if len(run):
                        start, end = int(run[0]), int(run[-1]) + window
                        of = recurs & (inside >= start) & (inside <= end - GRAM)
                        out.append((source, start, b" ".join(own[start:end]), w.anchors()[of].tolist()))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(4)], names=["source", "start", "passage", "anchors"])

    return stored(restrict(held, firsts.select("id"), "id").join(firsts, "id").mapInArrow(tidy(join), "source long, start long, passage binary, anchors array<long>"), f"{path}/passages")


class Automaton:
    """Finds a shard's passages, and every part of them of a window or more, in a document.

    The passages' words, cut into pieces of which every window holds a whole one, are what is compiled. A hit says which
    passage lies how against the document. Hashes of the words of both are then compared all along, and the bytes of what
    is alike.
    """

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.piece = window, (window + 1) // 2
        self.automaton, self.places = ahocorasick.Automaton(), {}
        self.passages: list[tuple[int, int, bytes]] = []

    def add(self, source: int, start: int, passage: bytes) -> None:
        found = passage.split()
        for at in range(0, len(found) - self.piece + 1, self.piece):
            phrase = (b" " + b" ".join(found[at : at + self.piece]) + b" ").decode("latin-1")
            self.places.setdefault(phrase, []).append((len(self.passages), at))
        self.passages.append((source, start, b" ".join(found) + b" "))

    def compiled(self) -> Automaton:
        """All passages' words become one array, and so do all phrases' places, so that a document's hits are compared at
        once."""
        for k, phrase in enumerate(self.places):
            self.automaton.add_word(phrase, (len(phrase), k))
        self.automaton.make_automaton()
        self.first = np.cumsum([0, *map(len, self.places.values())])
        self.of, self.offset = np.array([p for places in self.places.values() for p in places], np.int64).reshape(-1, 2).T
        self.source, self.start = np.array([p[:2] for p in self.passages], np.int64).reshape(-1, 2).T
        self.text = b"".join(p[2] for p in self.passages)
        self.known, _, sizes = hashed_words(self.text)
        self.ends = np.cumsum(sizes + 1)
        self.length = np.array([p[2].count(b" ") for p in self.passages], np.int64)
        self.base = np.cumsum(self.length) - self.length
        return self

    def alignments(self, at: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each passage that one of the phrases, found at these words of a document, is in, and the word at which the passage
        would begin there; each pair once."""
        n = self.first[phrases + 1] - self.first[phrases]
        which = np.repeat(self.first[phrases] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique((self.of[which] << 32) | (np.repeat(at, n) - self.offset[which] + (1 << 31)))
        return both >> 32, (both & ((1 << 32) - 1)) - (1 << 31)

    def locate(self, doc: int, text: bytes) -> tuple[list[int], list[int]]:
        """Starts and ends of the runs of words that windows cover which also start earlier."""
        stream = b" ".join(words(text)) + b" "
        if not len(self.automaton) or stream.count(b" ") < self.window:
            return [], []
        hits = [(end - size + 1, k) for end, (size, k) in self.automaton.iter(" " + stream.decode("latin-1"))]
        if not hits:
            return [], []
        places, phrases = np.array(hits, np.int64).T
        own, _, sizes = hashed_words(stream)
        ends = np.cumsum(sizes + 1)
        passage, shift = self.alignments(np.searchsorted(ends, places, side="right"), phrases)
        low, high = np.maximum(0, shift), np.minimum(len(own), shift + self.length[passage])
        # Not the place that the passage was taken from.
        other = ((self.source[passage] != doc) | (self.start[passage] != shift)) & (high - low >= self.window)
        skip, low, size = (self.base[passage] - shift)[other], low[other], (high - low)[other]
        gone = np.zeros(len(own) + 1, np.int64)
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1):
            for start, end in self.alike(stream, own, ends, low[part], size[part], skip[part]):
                gone[start] += 1
                gone[end] -= 1
        covered = np.concatenate([[False], np.cumsum(gone)[:-1] > 0, [False]])
        return np.flatnonzero(covered[1:] & ~covered[:-1]).tolist(), np.flatnonzero(covered[:-1] & ~covered[1:]).tolist()

    def alike(self, stream: bytes, own: np.ndarray, ends: np.ndarray, low: np.ndarray, size: np.ndarray, skip: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of a window or more of a document's words that are those of a passage, ``skip`` words from there; words
        ``low`` to ``low + size`` are compared."""
        if not len(size):
            return
        upto = np.cumsum(size + 1)  # each alignment's words and one more, which parts it from the next
        word = np.arange(upto[-1]) + np.repeat(low - upto + size + 1, size + 1)
        there = word + np.repeat(skip, size + 1)
        same = own.take(word, mode="clip") == self.known.take(there, mode="clip")
        same[upto - 1] = False
        edges = np.flatnonzero(np.append(False, same[:-1]) != same)
        first, last = edges[::2], edges[1::2]
        long, done = last - first >= self.window, set()
        for start, at, n in zip(word[first[long]].tolist(), there[first[long]].tolist(), (last - first)[long].tolist()):
            if (start, n) in done:
                continue
            mine, passage = between(stream, ends, start, start + n), between(self.text, self.ends, at, at + n)
            if mine == passage:
                done.add((start, n))
                yield start, start + n
                continue
            unlike = [k for k, (a, b) in enumerate(zip(mine.split(), passage.split())) if a != b]
            for a, b in zip([-1, *unlike], [*unlike, n]):
                if b - a > self.window:
                    yield start + a + 1, start + b


def between(text: bytes, ends: np.ndarray, start: int, end: int) -> bytes:
    """Words start to end of a text with one space after each."""
    return text[ends[start - 1] if start else 0 : ends[end - 1]]


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(id, starts, ends): runs of words of ``docs(id, text binary)`` that a window covers which also starts earlier."""
    spark = docs.sparkSession
    path = work_dir(spark, "phrases")
    small_batches(spark)
    known = recurring_anchors(docs, window, path)
    held = stored(restrict(docs, known.select("id"), "id").join(known, "id").select("id", "text", "anchors"), f"{path}/held")
    hashed = candidate_windows(held, window, path)
    windows = recurring_windows(hashed, path)
    n_shards = 1 + windows.count() // SHARD_WORDS
    parts = passages(held, windows, window, path)
    ways = routes(hashed, windows, n_shards, path)
    parts = parts.withColumn("shard", shard_of(n_shards))
    discard(spark, f"{path}/hashes")
    discard(spark, f"{path}/windows")
    sizes = stored(ways.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).alias("n_copies")), f"{path}/sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    routed = ways.join(sizes, "shard").withColumn("copy", F.pmod(F.xxhash64("id"), "n_copies"))
    streamed = restrict(held.select("id", "text"), ways.select("id").distinct(), "id").join(routed, "id").select("shard", "copy", F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("start"), "text")
    compiled = parts.join(sizes, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    compiled = compiled.select("shard", "copy", F.lit(0).alias("kind"), F.col("source").alias("id"), "start", F.col("passage").alias("text"))
    both = streamed.unionByName(compiled).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, ready = None, Automaton(window), False
        for columns in batches_of(batches, 512):
            out = []
            for s, copy, kind, doc, start, text in zip(*columns):
                if (s, copy) != shard:
                    shard, automaton, ready = (s, copy), Automaton(window), False
                if kind == 0:
                    automaton.add(doc, start, text)
                    continue
                if not ready:
                    ready = bool(automaton.compiled())
                spans = automaton.locate(doc, text)
                if spans[0]:
                    out.append((doc, *spans))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(3)], names=["id", "starts", "ends"])

    spans = both.mapInArrow(tidy(stream), "id long, starts array<long>, ends array<long>")
    flat = spans.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    return stored(flat, f"{path}/spans")


def remove_phrases(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept string`` (words joined by one space) for every row of ``docs``: its text
    without the words that a window of ``window`` words covers which also starts earlier.

    Earlier: in a document of a smaller doc_id, a null one being the smallest, or before in the same document. Rows of
    one doc_id are versions of one document: what they have at the same place isn't a repeat. A null text has no words;
    texts of fewer words than a window stay. An empty table gives no rows; other columns, whatever their names, are
    ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    spans = repeated_spans(rows.select("id", "text"), window)
    n = spans.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, starts, ends in batches_of(batches, 512):
            out = []
            for doc, text, lows, highs in zip(ids, texts, starts, ends):
                own = words(text)
                gone = np.zeros(len(own) + 1, np.int64)
                inside = np.array(lows) < len(own)  # spans of another version of the document may lie beyond
                np.add.at(gone, np.array(lows)[inside], 1)
                np.add.at(gone, np.minimum(np.array(highs)[inside], len(own)), -1)
                stays = np.cumsum(gone)[:-1] == 0
                out.append((doc, len(own), int((~stays).sum()), b" ".join(w for w, s in zip(own, stays.tolist()) if s).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    touched = restrict(rows, spans.select("id"), "id", n).join(spans, "id").select(F.col("doc_id").cast("long"), "text", "starts", "ends")
    touched = touched.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept string")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches_of(batches, 512):
            own = [words(t) for t in texts]
            yield packed([pa.array(ids, pa.int64()), [len(w) for w in own], [0] * len(own), [b" ".join(w).decode() for w in own]], ["doc_id", "n_words", "n_removed", "kept"])

    whole = without(rows, spans.select("id"), "id", n).select(F.col("doc_id").cast("long"), "text")
    return touched.unionByName(whole.mapInArrow(tidy(plain), "doc_id long, n_words long, n_removed long, kept string"))
