"""Source divergence, language-model scores and collocations, against SQL and brute force on awkward tables."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulon.llm import collocations, divergence, grams, queries, scoring
from tabulon.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string"


def said_by(sql, rows):
    """What SQL says of a table of documents."""
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64", "text": "string", "lang": "string", "source": "string"})
    with duckdb.connect() as con:
        con.register("documents", documents)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        return {tuple(sorted(zip(names, r))) for r in found.fetchall()}


def as_rows(df):
    return [tuple(sorted(r.asDict().items())) for r in df.collect()]


def noisy(seed, n, sources, words=300, most=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["w", "é", "Z", "語"]) + "".join(rng.choices("abcdeXYé", k=1 + k % 4)) for k in range(words)]
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, most])
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "1", "\n", ". "]) for _ in range(size))
        out.append((i, rng.choice([text, text, text, None]), rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(sources)] + ["s0"] * sources + [None])))
    return out


@pytest.mark.parametrize("sources,blocks", [(3, (256, 1024)), (40, (7, 13))])
def test_divergence_of_dense_and_sparse_terms(spark, sources, blocks):
    rows = noisy(sources, 900, sources)
    rows += [(5000 + i, f"rare{i % 4} only here", "en", f"s{i % 3}") for i in range(48)]  # kept, but in few sources
    rows += [(6000, None, "fr", "a"), (6001, "", "fr", "b"), (6001, "", "fr", "b"), (6002, "word", "alone", "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit(1), "n": F.lit("x"), "rank": F.array(F.lit(2))})
    found = as_rows(divergence.divergence_audit(docs, source_block=blocks[0], term_block=blocks[1]))
    assert len(found) == len(set(found)) and set(found) == said_by(queries.DIVERGENCE_SQL, rows)
    values = [dict(r) for r in found]
    assert {r["item"]: r["value"] for r in values if r["lang"] == "fr" and r["source"] == "a"} == {"b": 0}
    assert not [r for r in values if r["lang"] == "alone"] and any(r["item"].startswith("rare") for r in values)


def test_divergence_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert divergence.divergence_audit(spark.createDataFrame([], DOCS)).count() == 0
    text = "hot word " * 300_000 + "Cold " * 3
    rows = [(i, text if i == 3 else "hot cold word", "en", f"s{i % 2}") for i in range(12)]
    assert set(as_rows(divergence.divergence_audit(spark.createDataFrame(rows, DOCS)))) == said_by(queries.DIVERGENCE_SQL, rows)
    pieces = list(cut(b"abc def  x" * 50, divergence._BETWEEN, 10))
    assert b"".join(pieces) == b"abc def  x" * 50 and all(p[:1] == b" " for p in pieces[1:]) and len(pieces) > 30


def rounded(rows):
    return sorted(tuple((k, round(v, 6) if isinstance(v, float) else v) for k, v in r) for r in rows)


def scored(docs, **sizes):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = scoring.score_texts(docs, ~held_out, **sizes)
    return as_rows(found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


@pytest.mark.parametrize("sizes", [{}, {"chunk_tokens": 40, "shard_tokens": 300}])
def test_scores_of_odd_texts_in_small_and_large_chunks(spark, sizes):
    rows = noisy(5, 150, 2, words=30, most=90)
    rows += [(200, "A b\x0bC\x0c a B c  d a b c", "en", "s"), (None, "a b c", "en", "s"), (201, " \n", "en", "s"), (7, "w unheard of", "en", "s"), (3, "repeated id", "en", "s"), (202, "one two three " * 80, "en", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"chunk": F.lit("x"), "n": F.lit(1), "train": F.lit("no")}).repartition(3)
    found = scored(docs, **sizes)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64", "text": "string"})
    with duckdb.connect() as con:
        con.register("documents", documents)
        said = con.execute(queries.SCORES_SQL.replace("JOIN folds USING (doc_id)", "JOIN folds ON folds.doc_id IS NOT DISTINCT FROM documents.doc_id").replace("row_number() OVER () AS r, doc_id", "row_number() OVER () AS r, documents.doc_id"))
        names = [c[0] for c in said.description]
        want = [tuple(sorted(zip(names, r))) for r in said.fetchall()]
    key = lambda r: str(r)
    assert len(found) == len(rows) and sorted(rounded(found), key=key) == sorted(rounded(want), key=key)


def test_scores_are_probabilities_and_better_than_words_alone(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rng = random.Random(2)
    texts = []
    for i in range(400):
        at, said = rng.randrange(4), []
        for _ in range(30):
            at = (at + rng.choice([1, 1, 1, 2])) % 4
            said.append(words[at])
        texts.append((i, " ".join(said), "en", "s"))
    found = [dict(r) for r in scored(spark.createDataFrame(texts, DOCS))]
    held = [r for r in found if r["held_out"]]
    assert len(held) > 40 and all(r["score"] > r["base_score"] for r in held)


def test_no_documents_and_nothing_to_learn_from(spark):
    assert scored(spark.createDataFrame([], DOCS)) == []
    one = scoring.score_texts(spark.createDataFrame([(1, "a b", "x", "y")], DOCS), F.lit(False)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (3, 0, 0, 0.0, 0.0)


def test_packed_counts():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([2**64 - 1, 0, 5], np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)):
        assert (grams.unpacked(grams.packed(values)) == values).all()


@pytest.mark.parametrize("module, run", [(scoring, scoring.score_texts), (collocations, collocations.collocations)])
def test_a_task_holds_few_chunks_when_it_writes_and_reads_them(spark, tmp_path, monkeypatch, module, run):
    monkeypatch.setitem(grams.ROW_GROUPS, "parquet.block.size", "1000")
    monkeypatch.setattr(module, "work_dir", lambda spark, name: f"{tmp_path}/{name}")
    docs = spark.createDataFrame(noisy(5, 150, 2, words=30, most=90), DOCS).coalesce(1)
    run(docs, *[F.lit(True)] * (module is scoring), chunk_tokens=40).collect()
    for file in [f for name in ("chunks", "totals") for f in tmp_path.glob(f"*/{name}/*.parquet")]:
        groups = pq.ParquetFile(file).metadata
        groups = [groups.row_group(i) for i in range(groups.num_row_groups)]
        assert sum(g.num_rows for g in groups) > 20 >= max(g.num_rows for g in groups)
        assert not any(g.column(c).statistics for g in groups for c in range(g.num_columns))  # a writer keeps them


def spoken(seed, n):
    """Texts of a small vocabulary in which some phrases are fixed."""
    rng = random.Random(seed)
    fixed = ["new york city", "At least", "in spite of it", "ha ha ha ha ha", "Çok güzel"]
    out = []
    for i in range(n):
        said = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice("abcdefgHIJ") for _ in range(rng.choice([0, 1, 4, 60]))]
        out.append((i % 50, rng.choice([None, "", *[rng.choice([" ", " ", "\t"]).join(said).replace("J ", rng.choice(["J, ", "J.", "J \x0b", "J\xa0"]))] * 8]), rng.choice(["en", "de", "de", None, ""]), "s"))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_tokens": 120, "shard_tokens": 100, "places": 25}])
def test_collocations_in_small_and_large_tasks(spark, sizes):
    rows = spoken(3, 3000) + [(1, "only once here. twice", "fr", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("x"), "phrase": F.lit(1), "part": F.lit(None)}).repartition(3)
    found = as_rows(collocations.collocations(docs, **sizes))
    assert len(found) == len(set(found)) > 100 and set(found) == said_by(queries.COLLOCATIONS_SQL, rows)
    assert {dict(r)["phrase"] for r in found} >= {"new york city", "in spite of it"}


def test_collocations_of_one_text_without_end_and_of_nothing(spark):
    rows = [(1, f"{'x' * 1000} y z " * 1200 + "q. x y", "en", "s"), (2, "x y", None, "s")]
    found = as_rows(collocations.collocations(spark.createDataFrame(rows, DOCS), chunk_tokens=1000))
    assert found and set(found) == said_by(queries.COLLOCATIONS_SQL, rows)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_the_best_phrases_alone(spark):
    rows = spoken(4, 500)
    docs = spark.createDataFrame(rows, DOCS)
    found = {r for r in as_rows(collocations.collocations(docs))}
    assert set(as_rows(collocations.collocations(docs, top=7))) == {r for r in found if dict(r)["rank"] <= 7}
