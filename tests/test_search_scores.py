"""Scores of many terms: what a loop over sections finds, from a plan that doesn't grow with the terms."""

import math
import re

from tabulon.operators import search

FIELDS = "doc_id long, section int, title string, item string, topic string, path string, preview string, content string"
ROWS = [(1, i, f"t{i % 3} t5", "Item", None, "Item t7", f"t{i} and t1", f"t{i} t{i} t{i + 1} said") for i in range(12)] + [(2, 0, None, None, None, None, None, None), (2, 1, "", "", "", "", "", "T3 t3")]


def brute(terms):
    words = [(r[0], r[1], dict(zip(search.WEIGHTS, ([w for w in re.findall("[a-z0-9]+", (x or "").lower())] for x in r[2:])))) for r in ROWS]
    out = {}
    for doc, section, own in words:
        same = [o for d, _, o in words if d == doc]
        if not any(t in ws for ws in own.values() for t in terms):
            continue
        scores = []
        for t in terms:
            df = sum(any(t in o[f] for f in o if f != "content") for o in same)
            w = 0.0
            for f, weight in search.WEIGHTS.items():
                average = sum(len(o["preview" if f == "content" else f]) for o in same) / len(same)
                w += weight * own[f].count(t) / (1 - search.LENGTH_B[f] + search.LENGTH_B[f] * len(own[f]) / average if average else 1)
            idf = math.log(1 + (len(same) - df + 0.5) / (df + 0.5)) if df else 0.0
            scores.append(round(idf * (search.K1 + 1) * w / (search.K1 + w), 9))
        out[doc, section] = scores
    return out


def test_scores_of_many_terms(spark):
    sections = spark.createDataFrame(ROWS, FIELDS)
    for terms in [["t1", "t3"], [f"t{i}" for i in range(30)]]:
        got = {(r["doc_id"], r["section"]): [round(x, 9) for x in r["scores"]] for r in search.term_scores(sections, terms).collect()}
        assert got == brute(terms) and got
    assert search.term_scores(sections, []).count() == 0
    shown = lambda n: search.term_scores(sections, [f"t{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().count("n_words")
    assert shown(30) == shown(3)
