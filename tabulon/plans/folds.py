"""Order-dependent folds over the words and lines of a document, and the smaller text, date and array functions."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.operators import search, sequences
from tabulon.plans.registry import plan
from tabulon.sources import html

MARKERS = ["e ", "a ", "license"]
COLLAPSED_SQL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@plan("""WITH m AS (SELECT doc_id, replace(text, 'see license', 'see ' || repeat(chr(1), 7)) AS t FROM documents),
a AS (SELECT *, instr(t, 'e ') AS p1 FROM m),
b AS (SELECT *, CASE WHEN instr(substr(t, p1 + 1), 'a ') > 0 THEN p1 + instr(substr(t, p1 + 1), 'a ') ELSE 0 END AS p2 FROM a),
c AS (SELECT *, greatest(p1, p2) AS c0 FROM b)
SELECT doc_id, p1::INT AS first, p2::INT AS second, (CASE WHEN instr(substr(t, c0 + 1), 'license') > 0 THEN c0 + instr(substr(t, c0 + 1), 'license') ELSE 0 END)::INT AS third FROM c WHERE t IS NOT NULL""")
def win7_ordered_markers(t):
    """Each marker's first place after the one picked before it; 0 where there is none."""
    text = F.replace("text", F.lit("see license"), F.lit("see " + "\x01" * 7))
    found = t.documents.where("text IS NOT NULL").select("doc_id", sequences.ordered_markers(text, MARKERS).alias("at"))
    return found.select("doc_id", *[F.element_at("at", i).alias(n) for i, n in enumerate(("first", "second", "third"), 1)])


@plan(f"SELECT doc_id, len(list_filter(regexp_split_to_array({COLLAPSED_SQL}, '[。！？!?；;]'), lambda x: trim(x) <> ''))::INT AS n_sentences FROM documents WHERE text IS NOT NULL")
def srch10_sentences(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(search.sentences(F.col("text"))).alias("n_sentences"))


@plan()
def srch12_snippet_dedup(t):
    """The lines that hold a phrase, without those that say no more than another."""
    hits = F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit("license")))
    return t.documents.where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", search.distinct_snippets(hits).alias("snippets"))


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS section FROM documents),
w AS (SELECT doc_id, section, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS i FROM l),
p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, section ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM w),
h AS (SELECT doc_id, section, place, lower(word) AS term FROM p WHERE lower(word) IN ('license', 'version', 'under', 'the')),
c AS (SELECT doc_id, section, place, count(DISTINCT term) OVER (PARTITION BY doc_id, section ORDER BY place RANGE BETWEEN CURRENT ROW AND 120 FOLLOWING) AS n_terms FROM h)
SELECT doc_id, section::INT AS section, place AS start, n_terms::INT AS n_terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY n_terms DESC, place) AS r FROM c) WHERE r = 1""")
def srch13_cooccurrence(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    return search.densest(lines, ["doc_id", "section"], "line", ["license", "version", "under", "the"], 120)


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents)
SELECT doc_id, section FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'version') OR contains(lower(line), 'the')""")
def join12_token_or(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    any_term = F.exists(F.array(*map(F.lit, ("license", "version", "the"))), lambda x: F.contains(F.lower("line"), x))
    return lines.where(any_term).select("doc_id", "section")


@plan("SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: x <> '' AND NOT regexp_matches(x, '^([a-z]+:|//|#)')))), ' ') AS links FROM pages")
def str11_relative_links(t):
    near = F.filter(html.hrefs(F.col("html")), lambda x: (x != "") & ~x.rlike("^([a-z]+:|//|#)"))
    return t.pages.select("page_id", F.array_join(F.array_sort(F.array_distinct(near)), " ").alias("links"))


@plan("SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string(string_split(html, chr(10))[1:3], ' '), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS head FROM pages")
def str13_head_text(t):
    return t.pages.select("page_id", C.untagged(F.array_join(F.slice(F.split("html", "\n"), 1, 3), " ")).alias("head"))


@plan("""SELECT doc_id, len(regexp_extract_all(text, 'Ã.|â€|�'))::INT AS mojibake, NOT regexp_matches(right(text, 80), '[.!?。！？"”)]\\s*$') AS cut_off, len(regexp_extract_all(lower(text), '(^|[^a-z])see (item|part|note|section) '))::INT AS cross_references FROM documents WHERE text IS NOT NULL""")
def str15_text_defects(t):
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    cut = ~F.right(F.col("text"), F.lit(80)).rlike('[.!?。！？"”)]\\s*$')
    return t.documents.where("text IS NOT NULL").select("doc_id", count(F.col("text"), "Ã.|â€|�").alias("mojibake"), cut.alias("cut_off"), count(F.lower("text"), "(^|[^a-z])see (item|part|note|section) ").alias("cross_references"))


@plan("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha256(url || '|' || page_id), 1, 16) AS stable_id FROM pages")
def str16_stable_ids(t):
    return t.pages.select("page_id", C.slug(F.col("url")).alias("slug"), C.stable_id("url", "page_id").alias("stable_id"))


@plan("SELECT o_orderkey, (CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR)::DATE::VARCHAR AS start FROM orders")
def dt2_years_back(t):
    return t.orders.select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), -36).cast("string").alias("start"))


@plan("""WITH d AS (SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN days BETWEEN 80 AND 100 THEN 'quarter' WHEN days BETWEEN 170 AND 190 THEN 'half' ELSE 'other' END AS span FROM d""")
def dt5_span_kind(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", C.span_kind(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("span"))


@plan("SELECT doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS n_tokens, CASE WHEN ceil(length(coalesce(text, '')) / 4) > 1000 THEN 'hard' WHEN ceil(length(coalesce(text, '')) / 4) > 600 THEN 'soft' ELSE 'within' END AS verdict FROM documents")
def num5_token_limits(t):
    n = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    return t.documents.select("doc_id", n.cast("long").alias("n_tokens"), F.when(n > 1000, "hard").when(n > 600, "soft").otherwise("within").alias("verdict"))


@plan("""WITH h AS (SELECT doc_id, string_split(lower(substr(text, 1, 200)), ' ') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN len(list_filter(w[1:i], lambda x: x = w[i])) > 1 THEN w[i] || '_' || len(list_filter(w[1:i], lambda x: x = w[i])) ELSE w[i] END), ' ') AS headers FROM h""")
def arr1_unique_headers(t):
    words = F.split(F.lower(F.substring("text", 1, 200)), " ")
    return t.documents.where("text IS NOT NULL").select("doc_id", words.alias("w")).select("doc_id", F.array_join(C.unique_names(F.col("w")), " ").alias("headers"))


@plan("""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(lower(text), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
n AS (SELECT r, doc_id, word, pos, row_number() OVER (PARTITION BY r, word ORDER BY pos) AS n FROM p)
SELECT doc_id, string_agg(CASE WHEN n > 1 THEN word || '_' || n ELSE word END, ' ' ORDER BY pos) AS headers FROM n GROUP BY r, doc_id""")
def arr1_unique_words(t):
    """Like arr1_unique_headers, over whole texts; repeated and null ids are rows of their own."""
    return t.documents.where("text IS NOT NULL").select("doc_id", F.arrow_udf(_numbered, "string")(F.lower("text")).alias("headers"))


def _numbered(texts: pa.Array) -> pa.Array:
    """The words of each text, from the second time on with their number: one pass and no exchange, however long it is."""

    def one(text: str) -> str:
        seen, out = Counter(), []
        for word in text.split(" "):
            seen[word] += 1
            out.append(word if seen[word] == 1 else f"{word}_{seen[word]}")
        return " ".join(out)

    return pa.array([one(x.as_py()) for x in texts], pa.string())


@plan("SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line, n_name AS second FROM nation")
def arr3_markdown_rows(t):
    """Written as rows of a pipe table, and read back."""
    lines = t.nation.select("n_nationkey", C.markdown_row("n_nationkey", "n_name", "n_regionkey").alias("line"))
    return lines.select("n_nationkey", "line", F.element_at(C.markdown_cells(F.col("line")), 2).alias("second"))


@plan("SELECT o_custkey, coalesce(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 0)::DOUBLE AS filled FROM orders GROUP BY o_custkey")
def agg7_safe_ratio(t):
    counted = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("d"))
    return counted.select("o_custkey", C.ratio(F.col("n"), F.col("d")).cast("double").alias("filled"))
