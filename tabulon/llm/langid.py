"""Language identification by words first, backing off to shorter and shorter character n-grams.

A language's score for a text is the sum over its words of log frequencies. A word that training has seen counts with
its own frequencies; any other with the mean of its longest n-grams that training has seen, or not at all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, small_batches, stored, tidy, work_dir

UNDETERMINED = "und"
LONGEST_GRAM = 5
#: What an entry counts in a language that has never had it.
SMOOTH = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hashed(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))


@dataclass
class Entries:
    """Log frequencies of words or n-grams: of entry i and language l it is floor[l], or that plus ``gain`` where
    ``language`` is l among the pairs from starts[i] to starts[i + 1]. Entries are in the order of their hashes, and all
    is in arrays, so that a copy in a worker is small."""

    names: pa.Array
    hashes: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    @classmethod
    def fitted(cls, names: pa.Array, language: np.ndarray, n: np.ndarray, languages: int) -> Entries:
        found = names.dictionary_encode()
        hashes = hashed(found.dictionary.to_pylist())
        by_hash = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int64)
        rank[by_hash] = np.arange(len(hashes))
        code = rank[found.indices.to_numpy(zero_copy_only=False)]
        order = np.lexsort((language, code))
        code, language, n = code[order], language[order], n[order].astype(float)
        known = len(hashes)
        total = np.bincount(language, weights=n, minlength=languages) + SMOOTH * max(1, known)
        starts = np.searchsorted(code, np.arange(known + 1))
        return cls(found.dictionary.take(pa.array(by_hash)), hashes[by_hash], starts, language, np.log((n + SMOOTH) / SMOOTH), np.log(SMOOTH / total))

    def where(self, wanted: list[str]) -> np.ndarray:
        """Number of each wanted entry; -1: none. What the hashes say is checked on the strings."""
        if not len(self.hashes) or not wanted:
            return np.full(len(wanted), -1)
        keys = hashed(wanted)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[at] == keys)
        same = pc.equal(self.names.take(pa.array(at[maybe])), pa.array([wanted[i] for i in maybe.tolist()], pa.string()))
        out = np.full(len(wanted), -1)
        hit = maybe[same.to_numpy(zero_copy_only=False)]
        out[hit] = at[hit]
        return out

    def pairs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all the entries one after the other: which of them, the language, the gain."""
        n = self.starts[entries + 1] - self.starts[entries]
        which = np.repeat(np.arange(len(entries)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[entries], n)
        return which, self.language[at], self.gain[at]


class Model:
    def __init__(self, languages: list[str], known: Entries | None = None, pieces: Entries | None = None):
        self.languages, self.known, self.pieces = languages, known, pieces

    def rows(self, distinct: list[str]) -> np.ndarray:
        """Matrix of the log frequencies of each word in each language."""
        out = np.zeros((len(distinct), len(self.languages)))

        def add(entries: Entries, owner: np.ndarray, found: np.ndarray) -> None:
            share = 1 / np.bincount(owner, minlength=len(out))[owner]
            which, language, gain = entries.pairs(found)
            np.add.at(out, (owner[which], language), gain * share[which])
            mine = np.zeros(len(out), bool)
            mine[owner] = True
            out[mine] += entries.floor

        at = self.known.where(distinct)
        add(self.known, np.flatnonzero(at >= 0), at[at >= 0])
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            each = [grams(distinct[i], n) for i in left.tolist()]
            owner = np.repeat(left, [len(g) for g in each])
            found = self.pieces.where(list(chain.from_iterable(each)))
            add(self.pieces, owner[found >= 0], found[found >= 0])
            left = np.setdiff1d(left, owner[found >= 0])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        found = [words(t) for t in texts]
        n = np.array([len(w) for w in found], np.int64)
        lettered = np.array([any(map(str.isalpha, w)) for w in found], bool)
        names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        if not self.languages or not lettered.any():
            return names.tolist(), scores.tolist()
        said = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        codes = said.indices.to_numpy(zero_copy_only=False)
        rows = self.rows(said.dictionary.to_pylist())
        total = np.add.reduceat(np.vstack([rows[codes], np.zeros((1, rows.shape[1]))]), np.cumsum(n) - n)
        best = total.argmax(axis=1)
        share = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(1, n))[:, None])
        names[lettered] = np.array(self.languages, object)[best[lettered]]
        scores[lettered] = (share[np.arange(len(best)), best] / share.sum(axis=1))[lettered]
        return names.tolist(), scores.tolist()


def count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, is_word, entry, n) from batches of (text, lang), summed up while they are few."""

    def out(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, tally in seen.items():
            pieces: Counter = Counter()
            for word, n in tally.items():
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams(word, size):
                        pieces[g] += n
            for is_word, each in ((True, tally), (False, pieces)):
                if each:
                    columns = [pa.array([lang] * len(each), pa.string()), pa.array([is_word] * len(each)), pa.array(list(each), pa.string()), pa.array(list(each.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "is_word", "entry", "n"])

    seen: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(words(text))
        if sum(map(len, seen.values())) > 100_000:
            yield from out(seen)
            seen = {}
    yield from out(seen)


def train(labelled: DataFrame, chars_per_language: int = 2_000_000, most_chars: int = 16_000_000) -> Model:
    """Fits the model on ``labelled(text, lang)``.

    The fit reads a sample, bounded by its parameters: texts of about ``chars_per_language`` characters of each label,
    and ``most_chars`` of all, chosen by a hash of the text; equal texts of a label teach once. A label with letters of
    which no text was chosen has its text of the smallest hash, cut to the bound. Every word and n-gram of the sample
    becomes an entry, so the model has no more of them than the sample. Rows with a null text or label teach
    nothing; where no row is left the model answers ``und``.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    path = work_dir(spark, "langid")
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = stored(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")), f"{path}/sizes")
    n = sizes.count()
    if not n:
        return Model([])
    share = sizes.select("lang", F.least(F.lit(1.0), min(chars_per_language, most_chars / n) / F.greatest(F.col("chars"), F.lit(1))).alias("share"))
    chosen = rows.join(F.broadcast(share) if n <= BROADCAST_ROWS // 10 else share, "lang")
    chosen = chosen.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("text", "lang").dropDuplicates()
    tallies = chosen.mapInArrow(tidy(count_entries), "lang string, is_word boolean, entry string, n long")
    summed = ["is_word", "entry", "lang"]
    found = tallies.groupBy(*summed).agg(F.sum("n").alias("n")).toArrow()
    left = sizes.select("lang").join(spark.createDataFrame(found.select(["lang"]).group_by("lang").aggregate([])), "lang", "left_anti")
    if not left.isEmpty():
        rest = rows.join(F.broadcast(left) if n <= BROADCAST_ROWS // 10 else left, "lang").where(F.col("text").rlike(r"\p{L}"))
        bound = max(1, int(min(chars_per_language, most_chars / n)))
        # From its first letter on, so that what is cut to the bound teaches something.
        lettered = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, bound)
        rest = rest.groupBy("lang").agg(F.min_by(lettered, F.xxhash64("text")).alias("text")).select("text", "lang")
        more = rest.mapInArrow(tidy(count_entries), tallies.schema).groupBy(*summed).agg(F.sum("n").alias("n")).toArrow()
        found = pa.concat_tables([found, more])
    languages = sorted(found.column("lang").unique().to_pylist())
    code = pc.index_in(found.column("lang"), value_set=pa.array(languages, pa.string())).to_numpy()
    is_word = found.column("is_word").to_numpy()

    def fitted(mine: np.ndarray) -> Entries:
        return Entries.fitted(found.column("entry").filter(pa.array(mine)).combine_chunks(), code[mine], found.column("n").to_numpy()[mine], len(languages))

    return Model(languages, fitted(is_word), fitted(~is_word)) if languages else Model([])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) for every row of ``docs``, from its whole text alone.

    A null text, an empty one and one without a letter get ``und`` and 0. Languages that score alike: the first by
    name. Repeated rows stay; other columns are ignored; ``lang_pred`` and ``score`` among ``keep`` are refused.
    """
    if clash := {"lang_pred", "score", "__text"} & set(keep):
        raise ValueError(f"keep can't hold {sorted(clash)}")
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of the fit's bounded size
    step = max(1, 4_000_000 // max(1, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                names, scores = own.predict(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(tidy(run), f"{fields + ', ' if fields else ''}lang_pred string, score double")
