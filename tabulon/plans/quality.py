"""Hit lists, expansions, headings and run quality, on documents and on the tables that stand in for facts and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.operators import dedup, search
from tabulon.plans.registry import plan

LINES_SQL = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents)"
HITS_SQL = f"{LINES_SQL}, h AS (SELECT doc_id, source, section, content, CASE WHEN contains(lower(content), 'license') THEN 'exact' ELSE 'token' END AS strategy FROM l WHERE contains(lower(content), 'license') OR contains(lower(content), 'the '))"
INTENTS = {"terms": ["license", "version", "terms", "copyright"], "contact": ["email", "mail", "phone", "contact"], "commerce": ["price", "buy", "offer", "free"]}
STOP_WORDS = ["and", "for", "the", "with"]
#: Rows of orders that a task holds. So many that Spark, which deals rows out to up to 200 tasks without holding them, needs
#: no more for some 200,000,000 rows.
ORDER_ROWS = 1_100_000


def lines(t):
    return t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("section", "content"))


def hits(t):
    """Lines that have the phrase itself, or only a token of it."""
    exact = F.contains(F.lower("content"), F.lit("license"))
    return lines(t).where(exact | F.contains(F.lower("content"), F.lit("the "))).withColumn("strategy", F.when(exact, "exact").otherwise("token"))


@plan(f"""WITH {HITS_SQL}, c AS (SELECT doc_id, source, count(*) AS n, count(*) FILTER (strategy = 'exact') AS n_exact FROM h GROUP BY ALL)
SELECT d.source, round(avg(CASE WHEN n > 0 THEN n_exact / n ELSE 0 END), 6) AS exact_ratio, round(count(n) / count(*), 6) AS coverage, median(coalesce(n, 0)) AS median_hits FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.source""")
def agg11_search_quality(t):
    counted = hits(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("strategy") == "exact").alias("n_exact"))
    each = t.documents.select("doc_id", "source").join(counted, "doc_id", "left")
    found = F.coalesce(C.ratio(F.col("n_exact"), F.col("n")), F.lit(0.0))
    return each.groupBy("source").agg(F.round(F.avg(found), 6).alias("exact_ratio"), F.round(F.count("n") / F.count("*"), 6).alias("coverage"), F.median(F.coalesce("n", F.lit(0))).alias("median_hits"))


@plan("SELECT user_id, max(value) AS worst, bool_or(value > 150) AS any_over, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id ORDER BY any_over DESC, worst DESC, user_id")
def agg12_pressure(t):
    found = t.events.groupBy("user_id").agg(F.max("value").alias("worst"), F.bool_or(F.col("value") > 150).alias("any_over"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return found.orderBy(F.desc("any_over"), F.desc("worst"), "user_id")


@plan("SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) = 1")
def agg16_first_fact(t):
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    return dedup.keep_best(t.lineitem.select(*keys, "l_orderkey", "l_linenumber"), keys, [F.asc("l_orderkey"), F.asc("l_linenumber")])


@plan("""WITH r AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, l_partkey, l_quantity FROM lineitem), g AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n_rows, sum(l_quantity) AS quantity FROM r GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n_rows DESC, quantity DESC, l_returnflag, l_linestatus) = 1""")
def agg18_statement_group(t):
    """Rows that agree count once; of the groups of one signature the largest stands for the statement.

    All three steps are within an order, so rows are dealt by it once, over as many tasks as there are ORDER_ROWS: what a
    task holds doesn't grow with the table."""
    rows = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity")
    rows = rows.repartition(1 + rows.count() // ORDER_ROWS, "l_orderkey").distinct()
    groups = rows.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"))
    return dedup.keep_best(groups, ["l_orderkey"], [F.desc("n_rows"), F.desc("quantity"), F.asc("l_returnflag"), F.asc("l_linestatus")])


@plan(f"WITH {HITS_SQL} SELECT doc_id, section, strategy, sha256(content) AS content FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, lower(content) ORDER BY strategy <> 'exact', section) = 1")
def agg20_hit_dedup(t):
    found = hits(t).withColumn("alike", F.lower("content"))
    priority = F.element_at(F.create_map(*[F.lit(x) for pair in search.PRIORITY.items() for x in pair]), F.col("strategy"))
    best = dedup.keep_best(found, ["doc_id", "alike"], [priority.asc(), F.asc("section")])
    return best.select("doc_id", "section", "strategy", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@plan(f"""WITH {LINES_SQL}, w AS (SELECT doc_id, section, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda x: x IN ('license', 'the'))) AS term FROM l),
g AS (SELECT doc_id, term, section, count(*) AS n FROM w GROUP BY GROUPING SETS ((doc_id, section), (doc_id, section, term)))
SELECT doc_id, coalesce(term, '*') AS term, section, n FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY n DESC, section) = 1""")
def agg21_next_section(t):
    """The section to read next, for each query and for all of them."""
    words = lines(t).select("doc_id", "section", F.explode(C.tokens(F.col("content"))).alias("term")).where(F.col("term").isin("license", "the"))
    grains = words.groupingSets([["doc_id", "section"], ["doc_id", "section", "term"]], "doc_id", "section", "term").agg(F.count("*").alias("n"))
    return dedup.keep_best(grains.withColumn("term", F.coalesce("term", F.lit("*"))), ["doc_id", "term"], [F.desc("n"), F.asc("section")]).select("doc_id", "term", "section", "n")


@plan(f"""WITH {HITS_SQL}, c AS (SELECT doc_id, count(*) FILTER (strategy = 'exact') AS x, count(*) FILTER (strategy <> 'exact') AS e FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN x > 0 AND e > 0 THEN 'mixed' WHEN x > 0 THEN 'exact' WHEN e > 0 THEN 'expansion_only' ELSE 'none' END AS quality FROM documents LEFT JOIN c USING (doc_id)""")
def agg22_match_quality(t):
    counted = hits(t).groupBy("doc_id").agg(F.count_if(F.col("strategy") == "exact").alias("x"), F.count_if(F.col("strategy") != "exact").alias("e"))
    exact, expanded = F.col("x") > 0, F.col("e") > 0
    quality = F.when(exact & expanded, "mixed").when(exact, "exact").when(expanded, "expansion_only").otherwise("none")
    return t.documents.select("doc_id").join(counted, "doc_id", "left").select("doc_id", quality.alias("quality"))


@plan("""WITH s AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderstatus || '|' || o_orderpriority || '|' || year(o_orderdate) || '|' || o_custkey AS line FROM orders), k AS (SELECT *, list_aggregate(string_split(line, '|')[1:3], 'string_agg', '|') AS key FROM s)
SELECT key, line, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place, o_orderdate FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderkey) = 1 ORDER BY place, o_orderdate DESC, key""")
def agg25_source_list(t):
    """Of lines with the same three first parts the first stays; groups in order, the newest first."""
    line = F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.year("o_orderdate"), "o_custkey")
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", line.alias("line")).withColumn("key", F.substring_index("line", "|", 3))
    place = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return dedup.keep_best(rows, ["key"], [F.asc("o_orderkey")]).select("key", "line", place.alias("place"), "o_orderdate").orderBy("place", F.desc("o_orderdate"), "key")


@plan("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes FROM part GROUP BY p_brand")
def agg28_number_set(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_size")).cast("array<string>"), ",").alias("sizes"))


def intents_sql() -> str:
    scores = ", ".join(f"len(list_intersect(w, {of!r})) AS {name}" for name, of in INTENTS.items())
    best = " ".join(f"WHEN {name} > 0 AND {name} = greatest({', '.join(INTENTS)}) THEN '{name}'" for name in INTENTS)
    return f"WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT doc_id, {scores} FROM d) SELECT doc_id, CASE {best} ELSE 'general' END AS intent FROM s"


@plan(intents_sql())
def search4_intent(t):
    """The first of the keyword sets that overlap most; without any overlap, the general one."""
    words = C.tokens(F.col("text"))
    rows = t.documents.select("doc_id", *[F.size(F.array_intersect(words, F.array(*map(F.lit, of)))).alias(name) for name, of in INTENTS.items()])
    most, intent = F.greatest(*INTENTS), F.lit("general")
    for name in reversed(INTENTS):
        intent = F.when((F.col(name) > 0) & (F.col(name) == most), name).otherwise(intent)
    return rows.select("doc_id", intent.alias("intent"))


@plan(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3 AND NOT list_contains({STOP_WORDS!r}, x)))), ' ') AS expansions, regexp_replace(lower(text), '[-/]', ' ', 'g') <> lower(text) AS has_variant FROM benchmark")
def search6_expansion(t):
    """Tokens that a phrase is widened to, and whether it has a variant without hyphens and slashes."""
    kept = F.filter(C.tokens(F.col("text")), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS))
    return t.benchmark.select("item_id", F.array_join(F.array_sort(F.array_distinct(kept)), " ").alias("expansions"), (F.regexp_replace(F.lower("text"), "[-/]", " ") != F.lower("text")).alias("has_variant"))


@plan("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), n AS (SELECT doc_id, w, len(list_intersect(w, ['free', 'offer', 'click', 'buy', 'the'])) AS hits FROM d)
SELECT doc_id, CASE WHEN hits = 0 THEN 0.0 WHEN len(list_intersect(w, ['license', 'version'])) > 0 THEN 0.8 ELSE least(2.0, 0.6 + 0.25 * hits) END::DOUBLE AS noise FROM n""")
def search19_noise(t):
    words = lambda *of: F.size(F.array_intersect("w", F.array(*map(F.lit, of))))
    n = words("free", "offer", "click", "buy", "the")
    noise = F.when(n == 0, 0.0).when(words("license", "version") > 0, 0.8).otherwise(F.least(F.lit(2.0), 0.6 + 0.25 * n))
    return t.documents.select("doc_id", C.tokens(F.col("text")).alias("w")).select("doc_id", noise.alias("noise"))


@plan("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, list_filter([list_min(list_filter(range(len(w)), lambda i: starts_with(w[i + 1], 'licen') OR starts_with('licen', w[i + 1]))),
list_min(list_filter(range(len(w)), lambda i: starts_with(w[i + 1], 'under') OR starts_with('under', w[i + 1])))], lambda x: x IS NOT NULL) AS places FROM d) SELECT doc_id, CASE WHEN len(places) < 2 THEN 0 ELSE list_max(places) - list_min(places) END::INT AS apart FROM p""")
def search20_proximity(t):
    """How far apart the first places of two query tokens are; a token matches what it begins, or what begins it."""
    first = lambda q: F.array_min(F.transform("w", lambda x, i: F.when(x.startswith(q) | F.startswith(F.lit(q), x), i)))
    at = F.filter(F.array(first("licen"), first("under")), lambda x: x.isNotNull())
    rows = t.documents.select("doc_id", C.tokens(F.col("text")).alias("w")).select("doc_id", at.alias("at"))
    return rows.select("doc_id", F.when(F.size("at") < 2, 0).otherwise(F.array_max("at") - F.array_min("at")).alias("apart"))


@plan(f"WITH {LINES_SQL} SELECT doc_id, CASE WHEN coalesce(min(section) FILTER (length(content) >= 40), count(*)) >= 3 THEN coalesce(min(section) FILTER (length(content) >= 40), count(*)) ELSE 0 END::INT AS body_starts FROM l GROUP BY doc_id")
def win9_contents_run(t):
    """A leading run of three short lines or more is a table of contents, and the body starts after it."""
    found = lines(t).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.length("content") >= 40, F.col("section"))), F.count("*")).cast("int").alias("run"))
    return found.select("doc_id", F.when(F.col("run") >= 3, F.col("run")).otherwise(0).alias("body_starts"))


@plan("""WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber, (l_partkey % 4)::INT AS level FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.level, max(b.l_linenumber) AS parent FROM h a LEFT JOIN h b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level GROUP BY a.l_orderkey, a.l_linenumber, a.level""")
def win10_heading_parent(t):
    """The nearest heading before of a higher rank. Ranks are few, so that one running maximum for each is enough."""
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, -1)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("level")).distinct()
    latest = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("l_linenumber"))).over(before)) for k in range(3)]
    return rows.select("l_orderkey", "l_linenumber", "level", F.greatest(*latest).alias("parent"))


@plan(f"WITH {LINES_SQL} SELECT doc_id, section, sha256(right(coalesce(lag(content, 2) OVER w, '') || coalesce(lag(content, 1) OVER w, ''), 200)) AS context FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY section)")
def win11_context_before(t):
    """Up to 200 characters of the two lines before."""
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(-2, -1)
    return lines(t).select("doc_id", "section", F.sha2(F.right(F.array_join(F.collect_list("content").over(before), ""), F.lit(200)).cast("binary"), 256).alias("context"))
