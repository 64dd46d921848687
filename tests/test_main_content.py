"""Main content of pages: whole test pages against their article, and odd pages one by one."""

import re
from html import unescape

import duckdb

from tabulon import plans
from tabulon.sources import main_content as M

SF = "/root/testdata/sf0.001"
LONG = "Some sentence of the text that is long enough. " * 3


def test_pages_against_their_articles(spark):
    got = {r["page_id"]: r for r in plans.queries()["src9_main_content"](spark, SF).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    checked = 0
    for page, html in pages:
        if html and (m := re.search(r"(?is)<article[^>]*>(.*)</article>", html)):
            bare = re.sub(r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1>|<!--.*?-->", "", m[1])
            want = " ".join(unescape(re.sub("<[^>]+>", " ", bare)).split())
            if len(want) >= 200:
                assert got[page]["text"].replace(" ", "") == want.replace(" ", ""), page
                assert got[page]["source"] == "candidate"
                checked += 1
    assert checked >= 10


def test_candidates_links_and_gate():
    links = "".join(f"<li><a href='/{k}'>a link to page {k}</a></li>" for k in range(30))
    few = "".join(f"<li><a href='/{k}'>a link to page {k}</a></li>" for k in range(5))
    page = f"<title> A  page </title><div class='content'><ul>{few}</ul></div><div id='my-article'><h2>Head</h2><p>{LONG}<p>{LONG}x</div><nav>{LONG}</nav>"
    title, source, usable, flags, n, n_blocks, density, text, md = M.main_content(page)
    assert (title, source, usable, flags, n_blocks, density) == ("A page", "candidate", True, [], 3, 0.0) and "link" not in text and n == len(text)
    assert md.split("\n\n")[0] == "## Head" and len(md.split("\n\n")) == 3
    assert M.main_content(f"<ul>{links}</ul>")[1:4] == ("body", False, ["high_link_density"])
    assert M.main_content("")[1:5] == M.main_content(None)[1:5] == ("body", False, ["too_short", "too_few_blocks"], 0)
    assert M.main_content(f"<main><p>{LONG}</p><p>Sign in to our newsletter</p></main>")[3] == ["navigation_like"]
    assert "challenge_like" in M.main_content("Just a moment...")[3]
    assert M.main_content("<meta property='og:title' content='Other'><title>T</title>")[0] == "Other"


def test_markdown():
    html = "<article><h1>T <b>x</b></h1><p>One <a href='/u'>link</a> and <strong>bold</strong></p><ul><li>a</li><li>b<p>c</p></li></ul><ol><li>first</li><li>second</li></ol><blockquote>said</blockquote>tail</article>" + "<p>" * 3
    node = M.Tree()
    node.feed(html)
    assert M.markdown(next(x for x in node.root.nodes() if x.tag == "article")) == "# T **x**\n\nOne [link](/u) and **bold**\n\n- a\n\n- b\n\n- c\n\n1. first\n\n2. second\n\n> said\n\ntail"


def test_deep_pages():
    assert M.main_content("<div>" * 3000 + LONG + "</div>" * 3000)[4] == len(LONG.strip())
