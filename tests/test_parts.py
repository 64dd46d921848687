"""Column functions, parsers and streams on literals."""

import pytest
from pyspark.sql import functions as F

from tabulon import plans
from tabulon.functions import columns as C
from tabulon.operators import scoring, search, sequences
from tabulon.sources import html, readers
from tabulon.streaming import jobs

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [("700", "0700/HK/HKEX"), ("0700.HK", "0700/HK/HKEX"), ("HK.00700", "0700/HK/HKEX"), ("89988", "89988/HK/HKEX"), ("600519.SS", "600519/CN/SSE"), ("sz000333", "000333/CN/SZSE"), ("BRK.B", "BRK.B/US/None"), ("not a ticker!", None)])
def test_tickers(spark, raw, want):
    got = value(spark, C.canonical_ticker(F.lit(raw)))
    assert (got and f"{got['ticker']}/{got['market']}/{got['exchange']}") == want


@pytest.mark.parametrize(("raw", "want"), [("(1,234)", -1234.0), ("1.234,5", 1234.5), ("n/a", None), ("$ 5", 5.0), ("−3", -3.0), ("—", None), ("1,234.50", 1234.5), ("12,5", 12.5)])
def test_numbers(spark, raw, want):
    assert value(spark, C.tolerant_number(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "end", "want"), [("2024", False, "2024-01-01"), ("2024", True, "2024-12-31"), ("2024-02", True, "2024-02-29"), ("2024-02-03", True, "2024-02-03"), ("x", False, "None")])
def test_partial_dates(spark, raw, end, want):
    assert str(value(spark, C.partial_date(F.lit(raw), end))) == want


@pytest.mark.parametrize(("text", "want"), [("", 1), ("abc", 2), ("中文", 2), ("a中", 2)])
def test_token_units(spark, text, want):
    assert value(spark, C.token_units(F.lit(text))) == want


def test_canonical_json_orders_keys(spark):
    assert value(spark, C.canonical_json(F.lit('{"b": "1", "a": "2"}'))) == '{"a":"2","b":"1"}'


def test_water_fill_stays_within_the_budget(spark):
    import random

    draw = random.Random(7)
    cases = {k: [draw.randrange(1, 12 if k % 2 else 400) for _ in range(draw.randrange(1, 30))] for k in range(40)}
    rows = spark.createDataFrame([(k, x) for k, v in cases.items() for x in v], "k int, size long")
    for budget, least in ((120, 1), (100, 5), (1000, 40), (37, 3)):
        want = {}
        for k, v in cases.items():
            left, given, capped = budget, 0, 0
            for i, x in enumerate(sorted(v)):
                share = min(x, max(least, left // (len(v) - i)))
                left, given, capped = max(0, left - share), given + share, capped + (x > share)
            want[k] = (given, capped)
        got = {r["k"]: (r["given"], r["capped"]) for r in sequences.water_fill(rows, ["k"], "size", budget, least).collect()}
        assert got == want


def test_ceil_percentile_of_one(spark):
    assert value(spark, sequences.ceil_percentile(F.array(F.lit(7.0)), 0.9)) == 7.0


def test_caps_never_drop_exact_hits(spark):
    hits = spark.createDataFrame([(1, i, "exact" if i % 3 == 0 else "token") for i in range(30)], "doc_id long, section long, strategy string")
    got = search.capped(hits, ["doc_id"], [F.asc("section")]).collect()
    assert sum(r["strategy"] == "exact" for r in got) == 10 and sum(r["strategy"] == "token" for r in got) == 9


def test_html(spark):
    page = "<html><body><h1>A</h1><p>one<script>no</script><h2>B &amp; C</h2><table><tr><th>x</th><td>1</td></tr></table></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p")], "page_id long, html string")
    assert [(r["page_id"], r["level"], r["title"], r["content"]) for r in html.sections(df).orderBy("page_id", "position").collect()] == [(1, 1, "A", "one"), (1, 2, "B & C", "x\n1"), (3, 0, "", "<p")]
    assert [tuple(r)[1:] for r in html.cells(df).collect()] == [(0, 0, 0, True, "x"), (0, 0, 1, False, "1")]
    assert [r["text"] for r in html.texts(df).orderBy("page_id").collect()] == ["A\none\nB & C\nx\n1", "", "<p"]


def test_html_tables_with_spans_and_inner_tables(spark):
    page = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c<table><tr><td>in</td></tr></table>d</td><td>e</td></tr><tr style='display: none'><td>no</td></tr><tr><td>f</td></tr></table><div hidden>x<br>y</div>"
    got = {(r["table"], r["row"], r["col"]): r["text"] for r in html.cells(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()}
    assert got == {(0, 0, 0): "a", (0, 1, 0): "a", (0, 0, 1): "b", (0, 0, 2): "b", (0, 1, 1): "cd", (0, 1, 2): "e", (0, 2, 0): "f", (1, 0, 0): "in"}
    assert html.texts(spark.createDataFrame([(1, page)], "page_id long, html string")).first()["text"] == "a\nb\nc\nin\nd\ne\nf"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nbroken\n')
    got = readers.json_lines(spark, f"{tmp_path}/a.jsonl", "k int").collect()
    assert [r["k"] for r in got] == [1, None] and got[1]["_corrupt_record"] == "broken"
    assert [(r["name"], r["size"]) for r in readers.listing(spark, str(tmp_path), "*.jsonl").collect()] == [("a.jsonl", 16)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    readers.overwrite_partitions(df, f"{tmp_path}/t", "p")
    readers.overwrite_partitions(df.where("p = 'b'").withColumn("v", F.lit(9)), f"{tmp_path}/t", "p")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(1, "a"), (9, "b")]


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = jobs.run_to_end(jobs.progress(stream), "progress", "complete", f"{tmp_path}/c1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.progress(events).collect()))
    got = jobs.run_to_end(jobs.windowed(stream), "windowed", "complete", f"{tmp_path}/c2")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert jobs.run_to_end(jobs.first_requests(stream), "first", "append", f"{tmp_path}/c3").count() <= events.count()


def test_distinct_snippets_is_the_fold(spark):
    """The longer of two snippets takes the earlier one's place; a snippet within a kept one is dropped; two at most."""
    cases = {
        "same": (["The Act.", "the act"], ["The Act."]),
        "longer": (["act", "other", "the act, as amended"], ["the act, as amended", "other"]),
        "within": (["the act as amended", "ACT", "more", "third"], ["the act as amended", "more"]),
        "both": (["one", "two", "one two", "three"], ["one two", "two"]),
        "first": (["one two", "two", "TWO!", " "], ["one two"]),
        "none": ([], []),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, s array<string>")
    got = {r["k"]: r["d"] for r in rows.select("k", search.distinct_snippets(F.col("s")).alias("d")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_ordered_markers_and_densest(spark):
    rows = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, None)], "k int, s string")
    got = {r["k"]: r["p"] for r in rows.select("k", sequences.ordered_markers(F.col("s"), ["a", "b", "x", "c"]).alias("p")).collect()}
    assert got[1] == [3, 5, 0, 7] and got[2] == [0, 0, 0, 0]
    lines = spark.createDataFrame([(1, "aa x bb aa bb cc")], "k int, s string")
    assert [tuple(r) for r in search.densest(lines, ["k"], "s", ["aa", "bb", "cc"], 8).collect()] == [(1, 8, 3)]  # starts 0 3 5 8 11 14


def test_unique_words_takes_whole_texts(spark, tmp_path):
    text = "One " + "filler " * 40 + "one Last last"
    spark.createDataFrame([(1, text), (1, "a a"), (None, text), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in plans.queries()["arr1_unique_words"](spark, str(tmp_path)).collect()]
    whole = " ".join(["one", "filler", *(f"filler_{i}" for i in range(2, 41)), "one_2", "last", "last_2"])
    assert sorted(got, key=str) == sorted([(1, whole), (1, "a a_2"), (None, whole), (2, "")], key=str)


def test_forms_without_items_are_scored_by_their_own_profiles(spark):
    rows = [
        ("k", "6-K", 0, "Third Quarter Financial Results", 400, False), ("k", "6-K", 1, "Safe Harbor Statement", 50, False), ("k", "6-K", 2, "About us", 10, False),
        ("p", "DEF 14A", 0, "Election of Directors", 600, False), ("p", "DEF 14A", 1, "Compensation Discussion and Analysis", 2500, False),
    ]
    sections = spark.createDataFrame(rows, "doc_id string, form string, position int, title string, length long, refers boolean")
    got = {r["doc_id"]: (r["a_structure"], r["order_ok"], r["n_missing"]) for r in scoring.structure(sections).collect()}
    assert got == {"k": (25.0, None, 0), "p": (21.0, None, 0)}  # two sections where eight are expected: two steps of two points
    assert {r["doc_id"]: (r["b_content"], r["n_hard_missing"]) for r in scoring.content(sections).collect()} == {"k": (20.0, 0), "p": (22.0, 0)}
