"""Log-probabilities of texts by a backoff automaton over the n-grams of training texts.

The model has words, pairs and triples, each smoothed towards the next shorter one (Dirichlet prior): of a history h and
a word w, p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its first word and m one of PRIORS; a word
alone has (c + 0.5) / (N + 0.5 * (V + 1)). As an automaton, histories that training has seen are states, n-grams that it
has seen are arcs, and for any other word a state has a failure arc of weight m / (c(h) + m) to the state of h'. No n-gram
is left out, so the model grows with the corpus: a task compiles the part of the automaton that its chunk of texts can
reach, from counts over the whole corpus (see ``grams``), and reads each text once from left to right.

Defined results of odd rows: a null or empty text has the end alone as token; each row is scored by itself, whatever its
doc_id, so repeated rows and ids come back as often; a null in the training column counts as not in training; without
any row in training each word alone has probability 1 and all scores are 0; an empty table gives no row. A text longer
than a chunk continues in the next one from the state of its last two words. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import grams
from tabulon.llm.common import cut, small_batches, stored, tidy, work_dir

#: Strength of the priors of pairs and of triples, in tokens. Large: most texts don't repeat the phrases of others.
PRIORS = (1000.0, 8.0)
#: What stands for the start and the end of a text; no word holds a space.
START, END = b" start", b" end"

_BETWEEN = re.compile(rb"[\x20\x09-\x0D]")
CHUNKS = "chunk long, words binary, tokens binary, row array<long>, doc_id array<long>, train array<boolean>, lead array<int>, n array<int>"


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    partition = TaskContext.get().partitionId()
    made, numbers, tokens, pieces, size = count(), grams.Numbers(), [], [], 0

    def closed() -> pa.RecordBatch:
        nonlocal numbers, tokens, pieces, size
        lists = [pa.array([x], pa.list_(t)) for x, t in zip(zip(*pieces), (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()))]
        columns = [pa.array([partition << 32 | next(made)], pa.int64()), pa.array([b"\n".join(numbers)], pa.binary()), pa.array([np.concatenate(tokens).tobytes()], pa.binary()), *lists]
        numbers, tokens, pieces, size = grams.Numbers(), [], [], 0
        return pa.RecordBatch.from_arrays(columns, ["chunk", "words", "tokens", "row", "doc_id", "train", "lead", "n"])

    row = -1
    for batch in batches:
        for doc_id, text, train in zip(*(c.to_pylist() for c in batch.columns)):
            row, lead = row + 1, [START]
            for words in _parts(text):
                tokens.append(numbers.of(lead + words))
                pieces.append([partition << 32 | row, doc_id, train, len(lead), len(words)])
                size += len(words)
                lead = (lead + words)[-2:]
                if size >= most:
                    yield closed()
    if pieces:
        yield closed()


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text, a piece at a time; the last has the end."""
    words = []
    for part in cut(text, _BETWEEN):
        if words:
            yield words
        words = part.lower().split()  # of bytes: splits at ASCII blanks, lowers A to Z alone
    yield [*words, END]


class Ngrams:
    """The words, pairs and triples of one chunk: where each stands, its key, and how often training texts have it here.

    Of a pair ``left`` and ``right`` are its words; of a triple ``context`` is its first pair, ``lower`` its last one and
    ``last`` its last word.
    """

    def __init__(self, row: dict):
        self.words = row["words"].split(b"\n")
        self.tokens = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
        self.lead, self.n, size = np.array(row["lead"]), np.array(row["n"]), len(self.words)
        length = self.lead + self.n
        self.starts = np.cumsum(length) - length
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, length)
        counted = (place >= np.repeat(self.lead, length)) & np.repeat(np.array(row["train"], bool), length)
        at2, at3 = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        pairs, which = np.unique(self.tokens[at2 - 1] * size + self.tokens[at2], return_inverse=True)
        self.left, self.right = pairs // size, pairs % size
        self.pair = np.full(len(self.tokens), -1)
        self.pair[at2] = which
        triples, which3 = np.unique(self.pair[at3 - 1] * size + self.tokens[at3], return_inverse=True)
        self.triple = np.full(len(self.tokens), -1)
        self.triple[at3] = which3
        self.context, self.last = triples // size, triples % size
        self.lower = np.empty(len(triples), np.int64)
        self.lower[which3] = self.pair[at3]
        word = grams.word_keys(self.words)
        pair = grams.joined_keys(word[self.left], word[self.right])
        self.keys = [word, pair, grams.joined_keys(pair[self.context], word[self.last])]
        self.own = [np.bincount(at[counted[places]], minlength=k) for at, places, k in ((self.tokens, slice(None), size), (which, at2, len(pairs)), (which3, at3, len(triples)))]


def _send(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = Ngrams(row)
            for size, (keys, own) in enumerate(zip(found.keys, found.own), 1):
                yield grams.sent(row["chunk"], size, keys, own, shards, BITS[size - 1])


class Automaton:
    """The part of the model that a chunk can reach. State 0 has no history, then come words, then pairs.

    ``weight``, ``source`` and ``target`` have an arc for each word, pair and triple of the chunk; arcs that training has
    not seen start at state -1, so that no traversal takes them.
    """

    def __init__(self, found: Ngrams, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: int, known: int, priors: tuple[float, float]):
        size, (m2, m3) = len(found.words), priors
        if START in found.words:  # every training text starts and ends once
            c1[found.words.index(START)] = c1[found.words.index(END)] if END in found.words else 0
        self.found = found
        self.alone = (c1 + 0.5) / (total + 0.5 * (known + 1))
        p2 = (c2 + m2 * self.alone[found.right]) / (c1[found.left] + m2)
        p3 = (c3 + m3 * p2[found.lower]) / (c2[found.context] + m3)
        self.weight = [np.log10(p) for p in (self.alone, p2, p3)]
        self.word_state = np.where(c1 > 0, 1 + np.arange(size), 0)
        self.pair_state = np.where(c2 > 0, 1 + size + np.arange(len(c2)), self.word_state[found.right])
        self.source = [np.zeros(size, np.int64), np.where(c2 > 0, 1 + found.left, -1), np.where(c3 > 0, 1 + size + found.context, -1)]
        self.target = [self.word_state, self.pair_state, self.pair_state[found.lower]]
        self.back = np.log10(np.concatenate([[1.0], m2 / (c1 + m2), m3 / (c2 + m3)]))
        self.failure = np.concatenate([np.zeros(1 + size, np.int64), self.word_state[found.right]])

    def read(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of the weights on the way through many stretches of tokens side by side, each from left to right.

        A stretch starts in the state of the words before it; an arc whose word fits is taken if it starts at the state
        at hand, else the failure arc is.
        """
        found = self.found
        state = np.where(found.pair[first - 1] >= 0, self.pair_state[found.pair[first - 1]], self.word_state[found.tokens[first - 1]])
        order = np.argsort(-n, kind="stable")
        first, state, sums = first[order], state[order], np.zeros(len(n))
        running = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left").tolist()  # stretches longer than each step
        for step, k in enumerate(running):
            at, now, added, left = first[:k] + step, state[:k], sums[:k], np.arange(k)
            for size, numbers in ((2, found.triple), (1, found.pair), (0, found.tokens)):
                arc = numbers[at[left]]
                here = now[left]
                fits = (arc >= 0) & (self.source[size][arc] == here)
                taken, arc = left[fits], arc[fits]
                added[taken] += self.weight[size][arc]
                now[taken] = self.target[size][arc]
                if not size:
                    break
                left, here = left[~fits], here[~fits]
                fails = here > (len(found.words) if size == 2 else 0)  # only a pair is left for its word, and a word for none
                added[left[fails]] += self.back[here[fails]]
                now[left[fails]] = self.failure[here[fails]]
        out = np.empty(len(n))
        out[order] = sums
        return out


#: Stretches that are read side by side are no longer than this.
STRETCH = 1024
#: Bits of a pair's or triple's key; see ``grams``.
BITS = (64, 48, 48)


def _score(chunks: pa.Table, answers: pa.Table, shards: int, total: int, known: int, priors: tuple[float, float]) -> pa.Table:
    """Scores of the pieces of one chunk."""
    row = chunks.to_pylist()[0]
    found = Ngrams(row)
    by_size: list[dict[int, bytes]] = [{}, {}, {}]
    for size, shard, blob in zip(*(answers[c].to_pylist() for c in ("size", "shard", "totals"))):
        by_size[size - 1][shard] = blob
    c1, c2, c3 = (grams.received(keys, got, shards, bits) for keys, got, bits in zip(found.keys, by_size, BITS))
    seen = c1 > 0
    model = Automaton(found, c1, c2, c3, total, known, priors)
    first, n = found.starts + found.lead, found.n
    # Long pieces in stretches, each of which starts in the state that the words before it lead to.
    parts = -(-n // STRETCH)
    piece = np.repeat(np.arange(len(n)), parts)
    offset = (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
    scores = model.read(first[piece] + offset, np.minimum(n[piece] - offset, STRETCH))
    own = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cuts = np.cumsum(n) - n
    sums = {"n_known": np.add.reduceat(seen[found.tokens[own]].astype(np.int64), cuts), "base": np.add.reduceat(model.weight[0][found.tokens[own]], cuts), "score": np.bincount(piece, scores, len(n))}
    return pa.table({"row": row["row"], "doc_id": pa.array(row["doc_id"], pa.int64()), "train": pa.array(row["train"], pa.bool_()), "n": pa.array(row["n"], pa.int64()), **sums})


def score_texts(docs: DataFrame, train: Column, priors: tuple[float, float] = PRIORS, chunk_tokens: int = grams.CHUNK_TOKENS, shard_tokens: int = grams.SHARD_TOKENS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, train, n_tokens, n_known, train_tokens, base_score, score)``, log10 throughout;
    the model learns from the rows where ``train`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    path = work_dir(spark, "scores")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = stored(texts.mapInArrow(tidy(lambda batches: _chunks(batches, chunk_tokens)), CHUNKS), f"{path}/chunks", **grams.ROW_GROUPS)
    each = F.explode(F.arrays_zip("train", "n")).alias("piece")
    sums = chunks.select(each).agg(F.sum("piece.n"), F.sum(F.when(F.col("piece.train"), F.col("piece.n")))).first()
    shards, total = grams.shards_for(sums[0] or 0, shard_tokens), sums[1] or 0
    answers = stored(grams.totals(chunks.mapInArrow(tidy(lambda batches: _send(batches, shards)), grams.SENT)), f"{path}/totals", **grams.ROW_GROUPS)
    known = answers.where("size = 1").agg(F.sum("known")).first()[0] or 0
    pieces = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda c, a: _score(c, a, shards, total, known, priors), "row long, doc_id long, train boolean, n long, n_known long, base double, score double")
    whole = pieces.groupBy("row", "doc_id", "train").agg(*[F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")])
    return whole.select("doc_id", "train", F.col("n").alias("n_tokens"), "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
