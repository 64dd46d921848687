"""How far each source's use of terms is from the other sources of its language, and which terms set it apart.

The terms of a language that occur in many of its sources go into dense tiles of numpy, where every pair of sources is
compared term by term. Any other term is in few sources, and a source without it has a probability that doesn't depend
on the term: for these the sum over all terms starts from that of two sources that have none, and the postings of a term
correct it. All sums are of whole numbers, so they add up exactly in whatever order tasks run.

Defined results of odd rows: null text, language or source count as ''; every row is a document, so repeated rows count
again; a source without any term is compared as one whose counts are 0; a language that keeps no term has value 0 for
each pair and no row of part ``term``; a language with one source has no pair; an empty table gives no row. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, cut, slices, small_batches, stored, tidy, work_dir

#: A language keeps the terms that at least so many of its documents have.
LEAST_DOCUMENTS = 10
#: Terms that tell a source from its language are reported to this rank.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: A tile compares two blocks of about so many sources over about so many terms.
SOURCE_BLOCK, TERM_BLOCK = 256, 1024
#: A term in at least one of so many of its language's sources is heavy.
HEAVY_SHARE = 4
#: Entries that a task gathers before it passes them on.
GATHERED = 400_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            for part in slices(list(n), 50_000):
                names = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in cut(text, _BETWEEN):
                found = _TERM.findall(piece.lower())  # of bytes: lowers A to Z alone
                n.update(found)
                seen.update(found)
            docs.update(seen)
            entries += len(n) - before
            if entries >= GATHERED:
                yield from passed_on()
                entries = 0
    yield from passed_on()


def divergence_audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``.

    Part ``pair``: the divergence of the source from each other source of its language; part ``term``: its
    ``top_terms`` terms that are more frequent than in the language. Of probabilities p and q in units of 1e-9 the
    divergence is the sum of floor((p - q)² / (p + q)).
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = work_dir(spark, "divergence")
    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    raw = said.mapInArrow(tidy(_counted), "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    # One exchange serves the counts of a source and of its language: tasks have added up their own before it.
    counts = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(of_term).alias("lang_docs"),
        F.sum("n").over(of_term).alias("lang_n"),
        F.count(F.lit(1)).over(of_term).alias("sources"),
        (F.min("source").over(of_term) == F.col("source")).alias("first"),
    ).where(F.col("lang_docs") >= least_documents).drop("lang_docs")
    kept = stored(kept, f"{path}/kept")

    groups = said.select("lang", "source").distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), f"{path}/groups")
    terms = kept.where("first").select("lang", "term", "lang_n", "sources")
    by_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("lang_sources"))
    kept_terms = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    by_lang = by_lang.join(kept_terms, "lang", "left").na.fill(0, ["v", "lang_total"])
    by_lang = stored(by_lang, f"{path}/languages")
    groups = groups.join(bounded(by_lang), "lang")
    sizes = [F.greatest(F.lit(1), F.ceil(F.col(c) / per)).cast("int").alias(name) for c, per, name in (("lang_sources", source_block, "blocks"), ("v", term_block, "slices"))]
    groups = stored(groups.select("*", *sizes).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), f"{path}/sizes")

    rows = kept.join(bounded(groups), ["lang", "source"])
    rows = rows.withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total"))

    telling = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    telling = ranked(telling).where(F.col("rank") <= top_terms)

    heavy = F.col("sources") * HEAVY_SHARE >= F.col("lang_sources")
    postings = rows.select("lang", "block", "blocks", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"), "source", "term", "p", heavy.alias("heavy"), F.lit(0).cast("long").alias("terms"))
    slice_no = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    absent = groups.select("*", slice_no.alias("slice")).select(
        "lang", "block", "blocks", "slice", "source", F.lit(None).cast("string").alias("term"),
        F.when(F.col("v") > 0, share(F.lit(0), "total")).otherwise(F.lit(1)).alias("p"), F.lit(False).alias("heavy"),
        F.when(F.col("slice") == 0, F.col("v")).otherwise(F.lit(0)).alias("terms"),
    )
    tiles = postings.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    sums = tiles.groupBy("lang", "i", "j", "slice").applyInArrow(_tile, "lang string, a string, b string, value long")
    sums = stored(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), f"{path}/sums")
    both = [sums.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]
    return ranked(both[0].unionByName(both[1])).unionByName(telling)


def share(n, total: str):
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact however large the counts."""
    n = F.col(n) if isinstance(n, str) else n
    above = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (F.col(total) + F.col("v") * 2).cast("decimal(21,0)")
    return F.call_function("div", above, below) + 1


def bounded(df: DataFrame) -> DataFrame:
    """For a join: goes to every executor if its counted rows are few, else Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(df: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(best))


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(rows: pa.Table) -> pa.Table:
    """Sums of two blocks of sources over one slice of the terms."""
    i, j, lang = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["lang"][0].as_py()
    block, p = rows["block"].to_numpy(), rows["p"].to_numpy()
    absent = rows["term"].is_null().to_numpy()
    at = np.flatnonzero(absent)
    at = at[np.argsort(block[at], kind="stable")]
    names = rows["source"].take(pa.array(at)).combine_chunks()
    p0, first = p[at], int((block[at] == i).sum())  # sources from ``first`` on are of block j, if that is another
    number = {name: k for k, name in enumerate(names.to_pylist())}
    size = len(number)
    base = apart(p0[:, None], p0[None, :])
    total = base * int(rows["terms"].to_numpy()[at].max(initial=0))  # as if no source had any term; what follows corrects it

    here = np.flatnonzero(~absent)
    source = np.fromiter(map(number.__getitem__, rows["source"].take(pa.array(here)).to_pylist()), np.int64, len(here))
    coded = rows["term"].take(pa.array(here)).combine_chunks().dictionary_encode()
    term, p, heavy = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), p[here], rows["heavy"].to_numpy()[here]

    if heavy.any():
        column = np.cumsum(np.bincount(term[heavy], minlength=len(coded.dictionary)) > 0) - 1
        dense = np.repeat(p0[:, None], column[-1] + 1, axis=1)
        dense[source[heavy], column[term[heavy]]] = p[heavy]
        total -= base * dense.shape[1]
        for a in range(first):
            others = slice(a + 1 if i == j else first, size)
            total[a, others] += apart(dense[others], dense[a]).sum(axis=1)

    order = np.flatnonzero(~heavy)
    order = order[np.argsort(term[order], kind="stable")]
    source, term, p = source[order], term[order], p[order]
    if len(order):
        alone, n = np.unique(np.stack([source, p]), axis=1, return_counts=True)
        for (s, value), times in zip(alone.T, n.tolist()):
            change = (apart(value, p0) - base[s]) * times
            total[:s, s] += change[:s]
            total[s, s + 1 :] += change[s + 1 :]
        for step in range(1, int(np.bincount(term).max())):
            x = np.flatnonzero(term[step:] == term[:-step])
            y = x + step
            low, high = np.minimum(source[x], source[y]), np.maximum(source[x], source[y])
            both = apart(p[x], p[y]) - apart(p[x], p0[source[y]]) - apart(p[y], p0[source[x]]) + base[low, high]
            np.add.at(total, (low, high), both)

    a, b = np.triu_indices(size, 1)
    if i != j:
        wanted = (a < first) & (b >= first)
        a, b = a[wanted], b[wanted]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(total[a, b], pa.int64())})
