"""Every named plan that SQL can express, against DuckDB on the same small tables."""

import re
from html import unescape

import duckdb
import pytest

from tabulon import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def shown(v):
        if isinstance(v, float) and v == v:
            return str(int(v)) if v.is_integer() else f"{v:.5f}"
        return "" if v is None or v != v else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(shown, r)) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_plan_is_what_sql_says(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(plans.oracle_sql()[name]).df())


def pages():
    return [(r[0], r[1]) for r in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()]


def brute_snippets(text):
    """Kept snippets one by one: the first that is alike decides."""
    kept = []
    for line in text.split("\n"):
        now = " ".join(line.split())
        norm = re.sub(r"[\W_]+", "", now.lower())
        if "license" not in line.lower() or not norm:
            continue
        for i, (_, other) in enumerate(kept):
            if norm in other:
                break
            if other in norm:
                kept[i] = (now, norm)
                break
        else:
            kept.append((now, norm))
    return [x for x, _ in kept[:2]]


def test_snippets_of_whole_texts(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE contains(lower(text), 'license')").fetchall()
    got = {r["doc_id"]: r["snippets"] for r in plans.queries()["srch12_snippet_dedup"](spark, SF).collect()}
    assert got == {i: brute_snippets(text) for i, text in docs} and len(got) >= 3


def test_pages_against_their_tags(spark):
    """Headings and cells of pages, against patterns: these pages have no spans and hide nothing but scripts and styles."""
    want_cells, want_titles = {}, {}
    for page, html in pages():
        bare = re.sub(r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1>", "", html or "")
        want_cells[page] = len(re.findall(r"(?i)<t[dh][\s>]", bare))
        want_titles[page] = [" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.findall(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", bare)]
    cells, titles = dict.fromkeys(want_cells, 0), {p: [] for p in want_cells}
    for r in plans.queries()["src15_table_cells"](spark, SF).collect():
        cells[r["page_id"]] += 1
    for r in plans.queries()["doc1_html_sections"](spark, SF).orderBy("page_id", "position").collect():
        titles[r["page_id"]] += [r["title"]] if r["level"] else []
    assert cells == want_cells and titles == {p: [x for x in t if x] for p, t in want_titles.items()}


def test_only_these_plans_have_no_sql():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"srch12_snippet_dedup", "src15_table_cells", "doc1_html_sections", "doc4_quarterly_report", "doc5_foreign_report", "src9_main_content"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
