"""Search, document structure, text functions and quality scores on documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.functions import forms
from tabulon.operators import dedup, search
from tabulon.plans.registry import plan
from tabulon.sources import html, main_content, readers
from tabulon.streaming import jobs

TERMS = ["license", "version", "the"]
SECTIONS_SQL = """l AS (SELECT doc_id, lang AS item, source AS topic, substr(text, 1, 40) AS title, string_split(text, chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, item, topic, title, unnest(range(len(parts))) AS section, unnest(parts) AS content FROM l),
p AS (SELECT *, regexp_extract_all(lower(title), '[a-z0-9]+') AS t_title, regexp_extract_all(lower(item), '[a-z0-9]+') AS t_item, regexp_extract_all(lower(topic), '[a-z0-9]+') AS t_topic,
 regexp_extract_all(lower(item || ' ' || topic), '[a-z0-9]+') AS t_path, regexp_extract_all(lower(substr(content, 1, 200)), '[a-z0-9]+') AS t_preview, regexp_extract_all(lower(content), '[a-z0-9]+') AS t_content FROM s),
q AS (SELECT *, list_concat(t_title, list_concat(t_item, list_concat(t_topic, list_concat(t_path, t_preview)))) AS profile FROM p)"""


def bm25f_sql() -> str:
    scores = []
    for i, term in enumerate(sorted(TERMS)):
        parts = []
        for f, w in search.WEIGHTS.items():
            average = "avg_preview" if f == "content" else f"avg_{f}"
            count, b = f"len(list_filter(t_{f}, lambda x: x = '{term}'))", search.LENGTH_B[f]
            parts.append(f"{w} * CASE WHEN {count} > 0 THEN {count} / CASE WHEN {average} > 0 THEN 1 - {b} + {b} * len(t_{f}) / {average} ELSE 1 END ELSE 0 END")
        weighted = "(" + " + ".join(parts) + ")"
        scores.append(f"CASE WHEN df_{i} > 0 AND {weighted} > 0 THEN ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * {search.K1 + 1} * {weighted} / ({search.K1} + {weighted}) ELSE 0 END")
    averages = ", ".join(f"avg(len(t_{f})) AS avg_{f}" for f in search.WEIGHTS if f != "content")
    dfs = ", ".join(f"count(*) FILTER (list_contains(profile, '{x}')) AS df_{i}" for i, x in enumerate(sorted(TERMS)))
    return f"WITH {SECTIONS_SQL}, a AS (SELECT doc_id, count(*) AS n, {averages}, {dfs} FROM q GROUP BY doc_id) SELECT doc_id, section::INT AS section, round({' + '.join(scores)}, 6) AS score FROM q JOIN a USING (doc_id) WHERE list_has_any(list_concat(profile, t_content), {sorted(TERMS)!r})"


@plan(bm25f_sql())
def search17_bm25f(t):
    return search.bm25f(search.sections(t.documents), TERMS)


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS section FROM documents),
h AS (SELECT doc_id, section, c, CASE WHEN contains(lower(c), 'license') THEN 'exact' ELSE 'token' END AS strategy FROM l WHERE contains(lower(c), 'license') OR contains(lower(c), 'under') OR contains(lower(c), 'the ')),
r AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (strategy = 'exact') OVER w AS n_exact, row_number() OVER (PARTITION BY doc_id, strategy ORDER BY section) AS rank FROM h WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, section::INT AS section, strategy FROM r WHERE n < 8 OR n_exact = 0 OR strategy = 'exact' OR rank <= greatest(2, floor(n * 0.3))""")
def search22_rank_cap(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("section", "c"))
    exact = F.contains("c", F.lit("license"))
    hits = lines.where(exact | F.contains("c", F.lit("under")) | F.contains("c", F.lit("the "))).select("doc_id", "section", F.when(exact, "exact").otherwise("token").alias("strategy"))
    return search.capped(hits, ["doc_id"], [F.asc("section")])


@plan(f"""WITH {SECTIONS_SQL}, t AS (SELECT unnest(['license', 'the', 'data']) AS term),
d AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id), f AS (SELECT doc_id, term, count(*) AS df FROM q, t WHERE list_contains(profile, term) GROUP BY 1, 2)
SELECT doc_id, round((2.0 / 3 + coalesce((SELECT sum(df) FROM f WHERE f.doc_id = d.doc_id), 0) / n / 3) / 3, 4) AS ambiguity FROM d""")
def search3_ambiguity(t):
    """For a query of three words, two of which are generic."""
    profiles = search.profiled(search.sections(t.documents))
    has = [F.count_if(F.array_contains("profile", x)) for x in ("license", "the", "data")]
    counted = profiles.groupBy("doc_id").agg((sum(has[1:], has[0]) / F.count("*") / 3).alias("mean_df"))
    return counted.select("doc_id", search.ambiguity(F.lit(2.0), F.lit(3), F.col("mean_df")).alias("ambiguity"))


@plan("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token")
def agg33_document_frequency(t):
    return t.documents.select(F.explode(F.array_distinct(C.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@plan("""SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS first_line, replace(substr(text, greatest(1, instr(lower(text), 'license') - 56), 120), chr(10), ' ') AS centred FROM documents WHERE contains(lower(text), 'license')""")
def search23_evidence(t):
    rows = t.documents.where(F.contains(F.lower("text"), F.lit("license")))
    return rows.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("first_line"), F.replace(C.around(F.col("text"), F.lit("license"), 120), F.lit("\n"), F.lit(" ")).alias("centred"))


@plan("SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"'))::BIGINT AS n_links, coalesce(nullif(regexp_extract(html, 'charset=\"?([a-z0-9_-]+)', 1), ''), 'utf-8') AS charset FROM pages")
def src5_title_links(t):
    return t.pages.select("page_id", html.title(F.col("html")).alias("title"), F.size(html.hrefs(F.col("html"))).cast("long").alias("n_links"), html.charset(F.col("html")).alias("charset"))


@plan()
def src15_table_cells(t):
    return html.cells(t.pages)


@plan()
def doc1_html_sections(t):
    return html.sections(t.pages)


@plan("""WITH x AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n, len(regexp_extract_all(html, '<p>')) AS blocks, len(regexp_extract_all(html, '<a ')) AS links FROM pages)
SELECT page_id, n < 80 AS too_short, blocks < 2 AS few_blocks, links * 20.0 / greatest(1, n) > 0.45 AS link_heavy FROM x""")
def src10_quality_flags(t):
    n = F.length(html.visible(F.col("html")))
    count = lambda tag: F.regexp_count("html", F.lit(tag))
    return t.pages.select("page_id", (n < 80).alias("too_short"), (count("<p>") < 2).alias("few_blocks"), (count("<a ") * 20.0 / F.greatest(F.lit(1), n) > 0.45).alias("link_heavy"))


@plan("SELECT page_id, regexp_matches(html, '(?i)captcha|verify you are human|access denied') AS challenged FROM pages")
def src14_challenge(t):
    return t.pages.select("page_id", F.col("html").rlike("(?i)captcha|verify you are human|access denied").alias("challenged"))


@plan("SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def src22_url_list(t):
    return dedup.keep_best(t.pages.withColumn("k", F.regexp_replace("url", "[?#].*$", "")), ["k"], [F.asc("page_id")]).select("page_id", "url")


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no::INT AS line_no, line FROM l WHERE line_no BETWEEN 2 AND 3""")
def src4_line_range(t):
    return readers.lines(t.documents.select("doc_id", "text"), "text", 2, 3).select("doc_id", "line_no", "line")


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents),
h AS (SELECT doc_id, p FROM l WHERE regexp_matches(line, '^[^ ]+ [^ ]+\\.?$'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS ref, p::INT AS start, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p), (SELECT max(p) + 1 FROM l WHERE l.doc_id = h.doc_id))::INT AS "end" FROM h""")
def win8_marker_sections(t):
    """Short lines are headings; a section ends where the next begins, or with the document."""
    lines = t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    heads = lines.where(F.col("line").rlike(r"^[^ ]+ [^ ]+\.?$"))
    order = Window.partitionBy("doc_id").orderBy("p")
    return heads.select("doc_id", F.row_number().over(order).alias("ref"), F.col("p").alias("start"), F.coalesce(F.lead("p").over(order), "n").alias("end"))


@plan("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def str1_collapse(t):
    return t.documents.select("doc_id", C.collapsed(F.col("text")).alias("collapsed"))


@plan("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n FROM documents")
def str2_token_count(t):
    return t.documents.select("doc_id", F.size(C.tokens(F.col("text"))).cast("long").alias("n"))


@plan("SELECT p_partkey, CASE WHEN p_partkey > 9999 THEN 's_' || p_partkey ELSE 's_' || lpad(p_partkey::VARCHAR, 4, '0') END AS ref FROM part")
def str5_references(t):
    return t.part.select("p_partkey", C.reference("s", F.col("p_partkey")).alias("ref"))


@plan("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def str8_tag_strip(t):
    return t.pages.select("page_id", C.untagged(F.col("html")).alias("text"))


@plan("""SELECT doc_id, CASE WHEN regexp_matches(substr(lower(text), 1, 420), 'licen[cs]e') THEN 'exclude_title' WHEN regexp_matches(substr(lower(text), 1, 1600), '@') THEN 'exclude_strong' WHEN regexp_matches(substr(lower(text), 1, 4000), '(^|[^a-z])(the|der|le|el)([^a-z]|$)') THEN 'keep' ELSE 'no_match' END AS verdict FROM documents""")
def str9_first_match(t):
    head = lambda n: F.substring(F.lower("text"), 1, n)
    verdict = F.when(head(420).rlike("licen[cs]e"), "exclude_title").when(head(1600).rlike("@"), "exclude_strong").when(head(4000).rlike("(^|[^a-z])(the|der|le|el)([^a-z]|$)"), "keep").otherwise("no_match")
    return t.documents.select("doc_id", verdict.alias("verdict"))


@plan("SELECT o_orderkey, (make_date(year(o_orderdate), month(o_orderdate), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE::VARCHAR AS month_end, make_date(year(o_orderdate), 12, 31)::VARCHAR AS year_end FROM orders")
def dt1_partial_dates(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", C.partial_date(F.substring(iso, 1, 7), True).cast("string").alias("month_end"), C.partial_date(F.substring(iso, 1, 4), True).cast("string").alias("year_end"))


@plan("SELECT o_orderkey, ((o_orderdate::DATE - INTERVAL 5 YEAR)::DATE - 60)::VARCHAR AS window_start FROM orders")
def dt3_form_window(t):
    return t.orders.select("o_orderkey", forms.window_start(F.lit("10-K"), F.to_date("o_orderdate")).cast("string").alias("window_start"))


@plan("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount FROM lineitem")
def num1_tolerant_numbers(t):
    shown = F.format_string("%,.2f", "l_extendedprice")
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("US$ "), shown))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", C.tolerant_number(text).alias("amount"))


@plan("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def arr5_json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@plan("""WITH m AS (SELECT doc_id, lang, n_chars, quality, toxic, regexp_matches(text, '[{}<>|]') AS noisy FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT doc_id, lang, CASE WHEN n_chars >= 2000 THEN 30 WHEN n_chars >= 500 THEN 20 ELSE 5 END + CASE WHEN noisy THEN 5 ELSE 15 END + coalesce(quality, 0) * 40 + (1 - coalesce(toxic, 0)) * 25 AS score FROM m)
SELECT doc_id, score::INT AS score, CASE WHEN score >= 93 THEN 'pass' WHEN score >= 83 THEN 'warn' ELSE 'fail' END AS grade FROM s""")
def score8_grades(t):
    both = t.documents.join(t.labels, "doc_id", "left")
    length = F.when(F.col("n_chars") >= 2000, 30).when(F.col("n_chars") >= 500, 20).otherwise(5)
    noise = F.when(F.col("text").rlike(r"[{}<>|]"), 5).otherwise(15)
    score = length + noise + F.coalesce("quality", F.lit(0)) * 40 + (1 - F.coalesce("toxic", F.lit(0))) * 25
    return both.select("doc_id", score.cast("int").alias("score")).withColumn("grade", F.when(F.col("score") >= 93, "pass").when(F.col("score") >= 83, "warn").otherwise("fail"))


@plan("""SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.1), 6) AS p10, count(*) FILTER (n_chars < 80) AS gated, avg(n_chars) >= 93 AND quantile_cont(n_chars, 0.1) >= 86 AS passed FROM documents GROUP BY lang""")
def score9_batch_gate(t):
    p10 = F.percentile("n_chars", 0.1)
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(p10, 6).alias("p10"), F.count_if(F.col("n_chars") < 80).alias("gated"), ((F.avg("n_chars") >= 93) & (p10 >= 86)).alias("passed"))


@plan("SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, arg_max(event_type, ts) AS latest, arg_max(event_id, ts) FILTER (event_type = 'error') AS last_issue FROM events GROUP BY user_id")
def stm2_job_progress(t):
    return jobs.progress(t.events)


@plan("SELECT event_id, name FROM events JOIN (VALUES ('a', 3, NULL), ('b', NULL, 'purchase'), ('c', 7, NULL)) s(name, by_user, by_type) ON user_id = by_user OR event_type = by_type")
def stm4_fan_out(t):
    subscriptions = t.spark.sql("SELECT * FROM VALUES ('a', 3L, NULL), ('b', NULL, 'purchase'), ('c', 7L, NULL) AS s(name, by_user, by_type)")
    return jobs.fan_out(t.events, subscriptions).select("event_id", "name")


@plan("SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, count(*) FILTER (trim(line) = '') AS blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def score5_noise(t):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_max(F.transform(lines, lambda x: F.length(x).cast("long"))).alias("longest"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("blank"))


@plan()
def src9_main_content(t):
    """Each page's main content and whether it is good enough; compared with the pages' articles in the tests."""
    return main_content.contents(t.pages)
