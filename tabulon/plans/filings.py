"""Filings: forms and their types, the catalog, section semantics, and quality scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import forms
from tabulon.operators import dedup, scoring
from tabulon.plans.registry import plan

RAW = ["10k", "10-Q", "20f", " 8K/a", "DEF14A", "SC 13DG", "SC13G", "6-k", "fy", "H1", "EARNING_CALLS", "S-1"]
PERIODS = ["Q1", "H1", "FY", "Q3"]


def catalog(t):
    """Orders as filings of their customers: form, kind, dates and flags, some of them null."""
    n = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, RAW)), (1 + n % 12).cast("int"))
    date = F.to_date("o_orderdate")
    return t.orders.select(
        F.concat(F.lit("fil_"), n.cast("string")).alias("document_id"),
        F.col("o_custkey").alias("ticker"),
        form.alias("form_type"),
        F.when(n % 12 == 10, "material").otherwise("filing").alias("source_kind"),
        F.when(n % 3 != 0, F.year("o_orderdate")).alias("fiscal_year"),
        F.when(n % 5 != 0, F.element_at(F.array(*map(F.lit, PERIODS)), (1 + n % 4).cast("int"))).alias("fiscal_period"),
        F.when(n % 4 != 0, date).alias("report_date"),
        F.when(n % 6 != 0, date).alias("filing_date"),
        (F.col("o_orderstatus") == "P").alias("is_deleted"),
        F.when(n % 7 != 0, n % 9 != 0).alias("ingest_complete"),
    )


CATALOG = f"""c AS (SELECT 'fil_' || o_orderkey AS document_id, o_custkey AS ticker, {RAW}[1 + o_orderkey % 12] AS form_type, CASE WHEN o_orderkey % 12 = 10 THEN 'material' ELSE 'filing' END AS source_kind,
 CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate)::INT END AS fiscal_year, CASE WHEN o_orderkey % 5 <> 0 THEN {PERIODS}[1 + o_orderkey % 4] END AS fiscal_period,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS report_date, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE END AS filing_date,
 o_orderstatus = 'P' AS is_deleted, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 9 <> 0 END AS ingest_complete FROM orders)"""


def case(column: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


FORM_SQL = case("replace(upper(trim(form_type)), ' ', '')", forms.FORM_NAMES, "upper(trim(form_type))")
TYPE_SQL = f"CASE WHEN source_kind = 'material' THEN coalesce({case(case('upper(trim(form_type))', forms.MATERIAL_NAMES, 'upper(trim(form_type))'), forms.MATERIAL_TYPES)}, 'material') ELSE coalesce({case(FORM_SQL, forms.PERIOD_TYPES)}, {case(FORM_SQL, forms.FORM_TYPES)}, 'other') END"
ACTIVE_SQL = "NOT coalesce(is_deleted, false) AND coalesce(ingest_complete, true)"


def active(t):
    return catalog(t).where(~F.coalesce("is_deleted", F.lit(False)) & F.coalesce("ingest_complete", F.lit(True)))


@plan(f"WITH {CATALOG} SELECT document_id, {FORM_SQL} AS form, {TYPE_SQL} AS document_type FROM c")
def flt3_document_types(t):
    """Three maps: periods that stand for forms, forms, and materials."""
    return catalog(t).select("document_id", forms.form_name(F.col("form_type")).alias("form"), forms.document_type(F.col("form_type"), F.col("source_kind")).alias("document_type"))


@plan(f"WITH {CATALOG} SELECT document_id, coalesce(fiscal_period, CASE WHEN {FORM_SQL} IN ('10-K', '20-F') THEN 'FY' END) AS fiscal_period FROM c")
def flt5_fiscal_period(t):
    return catalog(t).select("document_id", forms.fiscal_period(F.col("form_type"), F.col("fiscal_period")).alias("fiscal_period"))


@plan(f"WITH {CATALOG} SELECT document_id FROM c WHERE {FORM_SQL} IN ('10-K', '8-K/A', 'SC 13D', 'SC 13D/A', 'SC 13G', 'SC 13G/A') AND filing_date BETWEEN DATE '1996-02-01' AND DATE '1997-12-31'")
def flt9_rebuild_filter(t):
    """Forms with their aliases, and bounds given to the month or year."""
    from tabulon.functions import columns as C

    wanted = forms.expanded_forms(forms.split_forms(F.lit("10K, 8KA sc13d/g")))
    start, end = C.partial_date(F.lit("1996-02")), C.partial_date(F.lit("1997"), end=True)
    return catalog(t).where(F.array_contains(wanted, forms.form_name(F.col("form_type"))) & F.col("filing_date").between(start, end)).select("document_id")


@plan(f"WITH {CATALOG} SELECT document_id FROM c WHERE document_id IN (SELECT DISTINCT 'fil_' || l_orderkey FROM lineitem WHERE l_quantity > 45)")
def flt10_requested(t):
    """Ids as a request writes them: with blanks, empty, and repeated."""
    asked = t.lineitem.where("l_quantity > 45").select(F.concat(F.lit("  fil_"), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("document_id"))
    wanted = asked.select(F.trim("document_id").alias("document_id")).where("document_id <> ''").distinct()
    return catalog(t).join(wanted, "document_id", "left_semi").select("document_id")


@plan(f"""WITH {CATALOG}, f AS (SELECT DISTINCT {FORM_SQL} AS form FROM c), e AS (SELECT form, CASE WHEN form = 'SC 13D/G' THEN ['SC 13D', 'SC 13D/A', 'SC 13G', 'SC 13G/A'] ELSE [form] END AS x FROM f)
SELECT form, array_to_string(x, '|') AS expanded, x[1] IN {tuple(forms.LOOKBACK_YEARS)} AS supported FROM e""")
def flt19_forms(t):
    every = catalog(t).select(forms.form_name(F.col("form_type")).alias("form")).distinct()
    expanded = forms.expanded_forms(F.array("form"))
    return every.select("form", F.array_join(expanded, "|").alias("expanded"), F.get(expanded, F.lit(0)).isin(*forms.LOOKBACK_YEARS).alias("supported"))


def years_sql() -> str:
    years = " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.LOOKBACK_YEARS.items())
    return f"CASE form {years} END"


@plan(f"WITH {CATALOG}, f AS (SELECT document_id, {FORM_SQL} AS form, filing_date FROM c) SELECT document_id, ((filing_date - to_years({years_sql()}::INT))::DATE - {forms.GRACE_DAYS})::VARCHAR AS window_start FROM f WHERE form IN {tuple(forms.LOOKBACK_YEARS)}")
def dt3_form_windows(t):
    """The window of each form, amended ones too."""
    rows = catalog(t).withColumn("form", forms.form_name(F.col("form_type"))).where(F.col("form").isin(*forms.LOOKBACK_YEARS))
    return rows.select("document_id", forms.window_start(F.col("form"), F.col("filing_date")).cast("string").alias("window_start"))


RECENCY_SQL = f"""CASE WHEN report_date IS NOT NULL OR filing_date IS NOT NULL THEN 2 WHEN fiscal_year > 0 OR fiscal_period IS NOT NULL THEN 1 ELSE 0 END DESC,
 coalesce(report_date, filing_date)::VARCHAR DESC NULLS LAST, coalesce(filing_date, report_date)::VARCHAR DESC NULLS LAST, coalesce(fiscal_year, -1) DESC, coalesce({case('fiscal_period', forms.PERIOD_RANK, '0')}::INT, 0) DESC, document_id DESC"""


def recency():
    dated = F.col("report_date").isNotNull() | F.col("filing_date").isNotNull()
    rank = F.when(dated, 2).when((F.col("fiscal_year") > 0) | F.col("fiscal_period").isNotNull(), 1).otherwise(0)
    period = F.coalesce(forms.lookup(forms.PERIOD_RANK, F.col("fiscal_period")), F.lit(0))
    return [rank.desc(), F.coalesce("report_date", "filing_date").desc_nulls_last(), F.coalesce("filing_date", "report_date").desc_nulls_last(), F.coalesce("fiscal_year", F.lit(-1)).desc(), period.desc(), F.col("document_id").desc()]


@plan(f"""WITH {CATALOG}, a AS (SELECT *, {TYPE_SQL} AS document_type FROM c WHERE {ACTIVE_SQL}), m AS (SELECT *, document_type IN ('annual_report', 'quarterly_report') AND coalesce(fiscal_year, 1996) BETWEEN 1995 AND 1997 AS hit FROM a),
n AS (SELECT ticker, count(*) AS total, count(*) FILTER (hit) AS matched FROM m GROUP BY ticker)
SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY {RECENCY_SQL}) AS place, document_id, document_type, total, matched FROM m JOIN n USING (ticker) WHERE hit""")
def api1_list_documents(t):
    """Every company's active filings of two types and three years, newest first, with how many there are in all."""
    rows = active(t).withColumn("document_type", forms.document_type(F.col("form_type"), F.col("source_kind")))
    hit = F.col("document_type").isin("annual_report", "quarterly_report") & F.coalesce("fiscal_year", F.lit(1996)).between(1995, 1997)
    counts = rows.groupBy("ticker").agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"))
    found = rows.where(hit).withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(*recency())))
    return found.join(counts, "ticker").select("ticker", "place", "document_id", "document_type", "total", "matched")


SLOTS = {"annual": ("annual_report",), "quarterly": ("quarterly_report", "semi_annual_report"), "current": ("current_report",), "proxy": ("proxy",), "ownership": ("ownership",), "earnings_call": ("earnings_call",), "presentation": ("earnings_presentation",), "material": ("material",)}
OVERVIEW = ("annual", "quarterly", "proxy", "current", "ownership", "latest")


@plan(f"""WITH {CATALOG}, a AS (SELECT *, {TYPE_SQL} AS document_type FROM c WHERE {ACTIVE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {RECENCY_SQL}) AS place FROM a),
s AS (SELECT ticker, arg_min(document_id, place) AS latest, {', '.join(f"arg_min(document_id, place) FILTER (document_type IN ({', '.join(map(repr, v))})) AS {k}" for k, v in SLOTS.items())} FROM r GROUP BY ticker) SELECT *, coalesce({', '.join(OVERVIEW)}) AS overview FROM s""")
def api1_recommended(t):
    """The newest document of each of nine kinds, and the one to begin with."""
    rows = active(t).withColumn("document_type", forms.document_type(F.col("form_type"), F.col("source_kind")))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(*recency())))
    first = lambda kinds: F.min_by("document_id", F.when(F.col("document_type").isin(*kinds), F.col("place")))
    picked = placed.groupBy("ticker").agg(F.min_by("document_id", "place").alias("latest"), *[F.when(F.count_if(F.col("document_type").isin(*v)) > 0, first(v)).alias(k) for k, v in SLOTS.items()])
    return picked.withColumn("overview", F.coalesce(*OVERVIEW))


@plan(f"WITH {CATALOG} SELECT ticker, document_id, row_number() OVER (PARTITION BY ticker ORDER BY filing_date NULLS FIRST, {FORM_SQL}, document_id) AS place FROM c")
def sort2_filings(t):
    order = [F.asc_nulls_first("filing_date"), forms.form_name(F.col("form_type")).asc(), F.asc("document_id")]
    return catalog(t).select("ticker", "document_id", F.row_number().over(Window.partitionBy("ticker").orderBy(*order)).alias("place"))


@plan(f"""WITH {CATALOG}, k AS (SELECT document_id, 1 AS p, document_id AS alias FROM c UNION ALL SELECT document_id, 2, 'acc-' || ticker || '-' || replace(document_id, 'fil_', '') FROM c UNION ALL SELECT document_id, 3, form_type || ' ' || document_id FROM c),
q AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'FIL_' || l_orderkey WHEN 1 THEN 'acc ' || o_custkey || ' -' || o_orderkey ELSE 'nothing' END AS asked FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT q.*, k.document_id, p FROM q LEFT JOIN k ON lower(regexp_replace(asked, '[\\s-]+', '', 'g')) = lower(regexp_replace(alias, '[\\s-]+', '', 'g')))
SELECT l_orderkey, l_linenumber, document_id FROM j QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY p, document_id) = 1""")
def join4_document_ids(t):
    """Ids as they are asked for, against three fields that name a document; blanks, hyphens and case don't count."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s-]+", ""))
    rows = catalog(t)
    names = F.array(F.col("document_id"), F.concat(F.lit("acc-"), F.col("ticker").cast("string"), F.lit("-"), F.replace("document_id", F.lit("fil_"), F.lit(""))), F.concat_ws(" ", "form_type", "document_id"))
    known = rows.select("document_id", F.posexplode(names).alias("p", "alias")).withColumn("key", bare(F.col("alias")))
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct().join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    n, key = F.col("l_linenumber") % 3, F.col("l_orderkey").cast("string")
    asked = F.when(n == 0, F.concat(F.lit("FIL_"), key)).when(n == 1, F.concat(F.lit("acc "), F.col("o_custkey").cast("string"), F.lit(" -"), key)).otherwise("nothing")
    found = lines.withColumn("key", bare(asked)).join(known, "key", "left")
    return dedup.keep_best(found, ["l_orderkey", "l_linenumber"], [F.asc("p"), F.asc("document_id")]).select("l_orderkey", "l_linenumber", "document_id")


FORMS = ["10-K", "10-Q", "20-F", "8-K"]


def sections(t):
    """Lines of documents as sections of filings of four forms, under titles that name items, in order in a third of
    the documents. A section's length is fifty times its line's."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "content"))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (1 + F.col("doc_id") % 4).cast("int"))
    rows = rows.withColumn("form", form).withColumn("order", scoring.per_form(lambda p: p.order, F.col("form")))
    n = F.size("order")
    at = F.when(F.col("doc_id") % 3 == 0, F.least(F.col("position"), n - 1)).otherwise((F.col("position") * 7 + F.col("doc_id")) % n)
    title = F.when(F.col("position") == 0, "Cover Page").when(F.col("position") % 23 == 22, "SIGNATURES").when(F.col("position") % 11 == 10, "Other matters").otherwise(F.concat(F.get("order", at.cast("int")), F.lit(". heading")))
    rows = rows.withColumns({"title": title, "length": F.length("content") * 50, "refers": F.contains(F.lower("content"), F.lit("license")), "leaks": F.contains("content", F.lit("version")), "level": F.when(F.col("position") % 5 == 4, 2).otherwise(1)})
    topic = forms.semantic(F.col("title"), F.col("form"), F.lit(None).cast("string"))
    return rows.withColumns({"topic": topic["topic"], "item": topic["item"], "official": topic["title"]}).drop("order")


def lists(pick) -> str:
    return "CASE form " + " ".join(f"WHEN '{f}' THEN {list(pick(p)) if isinstance(pick(p), tuple) else pick(p)}" for f, p in scoring.PROFILES.items()) + " END"


def item_maps(k: int) -> str:
    of = lambda table: "CASE item " + " ".join("WHEN '" + i + "' THEN '" + e[k].replace("'", "''") + "'" for i, e in table.items()) + " END"
    quarterly = f"CASE WHEN part = 'II' THEN {of(forms.ITEMS_10Q_II)} WHEN part = 'I' THEN {of(forms.ITEMS_10Q_I)} ELSE coalesce({of(forms.ITEMS_10Q_I)}, {of(forms.ITEMS_10Q_II)}) END"
    return f"CASE WHEN item IS NOT NULL THEN CASE form WHEN '10-Q' THEN {quarterly} WHEN '10-K' THEN {of(forms.ITEMS_10K)} WHEN '20-F' THEN {of(forms.ITEMS_20F)} END WHEN title = 'SIGNATURES' THEN '{('Signatures', 'signature')[k]}' END"


SECTIONS = f"""s0 AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS position, unnest(string_split(text, chr(10))) AS content, {FORMS}[1 + doc_id % 4] AS form FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT *, {lists(lambda p: p.order)} AS ord FROM s0),
s2 AS (SELECT *, CASE WHEN position = 0 THEN 'Cover Page' WHEN position % 23 = 22 THEN 'SIGNATURES' WHEN position % 11 = 10 THEN 'Other matters' ELSE ord[1 + CASE WHEN doc_id % 3 = 0 THEN least(position, len(ord) - 1) ELSE (position * 7 + doc_id) % len(ord) END] || '. heading' END AS title,
 length(content)::INT * 50 AS length, contains(lower(content), 'license') AS refers, contains(content, 'version') AS leaks, CASE WHEN position % 5 = 4 THEN 2 ELSE 1 END AS level FROM s1),
s3 AS (SELECT *, nullif(regexp_extract(title, 'Item (16[A-J]|[1-9][0-9]?[A-C]?)\\b', 1), '') AS item, nullif(regexp_extract(title, 'Part (I+)', 1), '') AS part FROM s2),
s AS (SELECT *, {item_maps(0)} AS official, {item_maps(1)} AS topic,
 CASE WHEN title LIKE '%Item %' THEN replace(title, '. heading', '') END AS named FROM s3)"""
STRUCTURE_SQL = f"""a0 AS (SELECT *, list_position(ord, named) AS pos FROM s), a1 AS (SELECT *, CASE WHEN pos > 0 THEN pos END AS known FROM a0),
a2 AS (SELECT *, coalesce(known < last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS back FROM a1),
a3 AS (SELECT doc_id, form, bool_or(back) AS back, count(known) AS n_known, list(DISTINCT named) FILTER (named IS NOT NULL) AS items, count(*) AS n_sections FROM a2 GROUP BY ALL),
a4 AS (SELECT *, len(list_filter({lists(lambda p: p.required)}, lambda z: NOT coalesce(list_contains(items, z), false))) AS n_missing, NOT back AND n_known > 0 AS order_ok, greatest(0, {lists(lambda p: p.sections[0])} - n_sections, n_sections - {lists(lambda p: p.sections[1])}) AS off FROM a3),
a AS (SELECT doc_id, form, CASE WHEN order_ok THEN 8.0 ELSE 0 END + greatest(0, 10.0 - 2 * n_missing) + greatest(0, 7.0 - 2 * ceil(off / 5)) AS a_structure, order_ok, n_missing, n_sections FROM a4)"""
CONTENT_SQL = f"""b0 AS (SELECT doc_id, form, named AS item, sum(length) AS length, bool_or(refers) AS refers FROM s WHERE named IS NOT NULL GROUP BY ALL),
need(form, item, least, points, may) AS (VALUES {', '.join(f"('{f}', '{i}', {n}, {x}, {str(i in p.may_refer).lower()})" for f, p in scoring.PROFILES.items() for i, n, x in p.lengths)}),
b1 AS (SELECT b0.doc_id, sum(points) FILTER (length >= least OR (may AND refers)) AS met FROM b0 JOIN need USING (form, item) GROUP BY b0.doc_id),
b2 AS (SELECT doc_id, count(*) AS n_hard FROM b0 WHERE list_contains({lists(lambda p: p.hard)}, item) GROUP BY doc_id),
b AS (SELECT d.doc_id, CASE WHEN form = '8-K' THEN 30.0 ELSE coalesce(met, 0)::DOUBLE END AS b_content, len({lists(lambda p: p.hard)}) - coalesce(n_hard, 0) AS n_hard_missing FROM (SELECT DISTINCT doc_id, form FROM s) d LEFT JOIN b1 USING (doc_id) LEFT JOIN b2 USING (doc_id))"""
NOISE_SQL = f"""e0 AS (SELECT doc_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS plain, rtrim(content) AS tail, content, length, leaks, coalesce(list_contains({lists(lambda p: p.may_be_short)}, named), false) AS may FROM s),
e1 AS (SELECT doc_id, count(*) FILTER (plain = '') AS empty, count(*) FILTER (length(plain) BETWEEN 1 AND 100 AND NOT may) AS short, count(*) FILTER (regexp_matches(content, '{scoring.MOJIBAKE}')) AS broken, max(length) AS max_length,
 count(*) FILTER (regexp_matches(right(tail, 80), '{scoring.CUT_OFF}')) AS cut_off, count(*) FILTER (leaks) AS leaks FROM e0 GROUP BY doc_id),
e AS (SELECT doc_id, greatest(0, 3.0 - empty - 0.5 * short) + CASE WHEN broken = 0 THEN 3 ELSE 0 END + CASE WHEN max_length <= {scoring.HUGE_WARN} THEN 3 WHEN max_length <= {scoring.HUGE_FAIL} THEN 1 ELSE 0 END
 + CASE WHEN cut_off = 0 THEN 3 WHEN cut_off <= 2 THEN 1 ELSE 0 END + CASE WHEN leaks = 0 THEN 3 WHEN leaks <= 2 THEN 1 ELSE 0 END AS e_noise, max_length FROM e1)"""
TOPIC_SQL = """t0 AS (SELECT doc_id, form, count(*) FILTER (level = 1 AND coalesce(topic, '') <> 'signature' AND title <> 'Cover Page') AS n, count(*) FILTER (level = 1 AND coalesce(topic, '') <> 'signature' AND title <> 'Cover Page' AND topic IS NOT NULL) AS filled FROM s GROUP BY ALL),
t AS (SELECT doc_id, CASE WHEN form = '8-K' OR n = 0 OR filled / n >= 0.9 THEN 10.0 WHEN filled / n >= 0.7 THEN 6 WHEN filled / n >= 0.5 THEN 3 ELSE 0 END AS s_semantic, filled FROM t0)"""


@plan(f"WITH {SECTIONS} SELECT doc_id, position, item, official, topic FROM s")
def flt16_semantics(t):
    return sections(t).select("doc_id", "position", "item", "official", "topic")


@plan(f"""WITH {SECTIONS}, p AS (SELECT *, CASE form WHEN '10-K' THEN CASE WHEN i >= 15 THEN 'IV' WHEN i >= 10 THEN 'III' WHEN i >= 5 THEN 'II' WHEN i >= 1 THEN 'I' END WHEN '20-F' THEN CASE WHEN i >= 17 THEN 'IV' WHEN i >= 13 THEN 'III' WHEN i >= 5 THEN 'II' WHEN i >= 1 THEN 'I' END END AS in_part FROM (SELECT *, try_cast(regexp_extract(item, '^[0-9]+') AS INT) AS i FROM s))
SELECT doc_id, position, 's_' || lpad(position::VARCHAR, 4, '0') AS ref, concat_ws(' > ', 'Part ' || in_part, 'Item ' || item, coalesce(official, title)) AS path FROM p""")
def api2_section_tree(t):
    """Reference and path of every section."""
    found = sections(t)
    path = forms.section_path(F.col("form"), F.col("item"), F.col("official"), F.col("title"), F.array().cast("array<string>"))
    return found.select("doc_id", "position", F.concat(F.lit("s_"), F.lpad(F.col("position").cast("string"), 4, "0")).alias("ref"), F.array_join(path, " > ").alias("path"))


@plan(f"WITH {SECTIONS}, p AS (SELECT *, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent FROM s) SELECT doc_id, position, title, parent, sha256(substr(content, 1, 80000)) AS content FROM p WHERE title LIKE 'Item 7%'")
def api3_read_section(t):
    """A section's text up to the limit, with the section above it."""
    above = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("position"))
    found = sections(t).withColumn("parent", F.when(F.col("level") == 2, above)).where(F.col("title").startswith("Item 7"))
    return found.select("doc_id", "position", "title", "parent", F.sha2(F.substring("content", 1, 80_000).cast("binary"), 256).alias("content"))


@plan(f"WITH {SECTIONS}, {STRUCTURE_SQL} SELECT * FROM a")
def sco1_structure(t):
    return scoring.structure(sections(t))


@plan(f"WITH {SECTIONS}, {CONTENT_SQL} SELECT * FROM b")
def sco2_content(t):
    return scoring.content(sections(t))


def calls(t):
    """Events as search calls for the document that their user's number names."""
    kinds = F.element_at(F.array(*map(F.lit, scoring.COVERAGE)), (1 + F.col("user_id") % 4).cast("int"))
    return t.events.select(F.col("user_id").alias("doc_id"), kinds.alias("kind"), (1 + F.col("event_id") % 3).cast("double").alias("weight"), (F.col("event_type") != "error").alias("hit"), (F.col("value") > 3).alias("good"), (F.col("event_id") % 8 < 5).alias("exact"))


CALLS_SQL = f"""c0 AS (SELECT user_id AS doc_id, {list(scoring.COVERAGE)}[1 + user_id % 4] AS kind, (1 + event_id % 3)::DOUBLE AS weight, event_type <> 'error' AS hit, value > 3 AS good, event_id % 8 < 5 AS exact FROM events),
c1 AS (SELECT doc_id, kind, coalesce(sum(weight) FILTER (hit), 0) / sum(weight) AS coverage, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND good) AS good, count(*) FILTER (hit AND exact) AS exact FROM c0 GROUP BY ALL),
c2 AS (SELECT *, CASE kind {' '.join(f"WHEN '{k}' THEN CASE WHEN coverage >= {c} THEN 9 WHEN coverage >= {b} THEN 7 WHEN coverage >= {a} THEN 5 ELSE 0 END" for k, (a, b, c) in scoring.COVERAGE.items())} END AS p1, CASE WHEN hits > 0 THEN good / hits ELSE 0 END AS g, CASE WHEN hits > 0 THEN exact / hits ELSE 0 END AS x FROM c1),
cs AS (SELECT doc_id, (p1 + CASE WHEN g >= 0.9 THEN 4 WHEN g >= 0.75 THEN 2 ELSE 0 END + CASE WHEN x >= 0.7 THEN 2 WHEN x >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS c_search, round(coverage, 4) AS coverage FROM c2)"""


@plan(f"WITH {CALLS_SQL} SELECT * FROM cs")
def sco3_search(t):
    return scoring.retrieval(calls(t))


def consistency_inputs(t):
    """Lines of an order as its tables and statements; section references from what tables and customers are."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "*")
    tables = lines.select("doc_id", F.concat(F.lit("t_"), F.col("l_linenumber").cast("string")).alias("table_ref"), F.concat(F.lit("s_"), (F.col("l_partkey") % 5).cast("string")).alias("section_ref"), (F.col("l_returnflag") == "R").alias("has_caption"), ((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 3)).alias("has_data"))
    documents = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderpriority")
    refs = lambda n: F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("s_"), i.cast("string")))).alias("ref")
    section_refs = documents.select("doc_id", refs(F.when(F.col("o_orderpriority") == "5-LOW", 3).otherwise(4)))
    read_refs = documents.select("doc_id", refs(F.when((F.col("o_orderpriority") == "5-LOW") | (F.col("o_custkey") % 7 == 0), 3).otherwise(4)))
    kinds = F.element_at(F.array(*map(F.lit, scoring.STATEMENTS)), (1 + F.col("l_suppkey") % 5).cast("int"))
    statements = lines.select("doc_id", kinds.alias("kind"), F.when(F.col("l_discount") < 0.05, "xbrl").otherwise("partial").alias("quality"), (F.col("l_quantity") / 2).cast("int").alias("n_rows"), (1 + F.col("l_partkey") % 3).alias("n_periods"))
    return documents, tables, section_refs, read_refs, statements


CONSISTENCY_SQL = f"""d0 AS (SELECT o_orderkey AS doc_id, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 3 ELSE 4 END AS top, CASE WHEN o_orderpriority = '5-LOW' OR o_custkey % 7 = 0 THEN 3 ELSE 4 END AS top_read FROM orders),
d1 AS (SELECT l_orderkey AS doc_id, count(*) AS n_tables, count(*) FILTER (l_linestatus = 'O' OR l_quantity > 3) AS n_data, count(*) FILTER (l_returnflag = 'R') AS n_captions, count(*) FILTER (l_partkey % 5 > coalesce(top, -1)) AS dangling FROM lineitem LEFT JOIN d0 ON l_orderkey = doc_id GROUP BY l_orderkey),
d2 AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_suppkey % 5) AS n_statements, avg((trunc(l_quantity / 2))::INT) AS mean_rows, bool_and(1 + l_partkey % 3 >= 2) AS periods_ok FROM lineitem WHERE l_discount < 0.05 OR trunc(l_quantity / 2) > 0 GROUP BY l_orderkey),
d3 AS (SELECT d0.doc_id, top, top_read, coalesce(n_tables, 0) AS n, n_data, n_captions, coalesce(dangling, 0) AS dangling, coalesce(n_statements, 0) AS n_statements, coalesce(mean_rows, 0) AS mean_rows, coalesce(periods_ok, false) AS periods_ok FROM d0 LEFT JOIN d1 USING (doc_id) LEFT JOIN d2 USING (doc_id)),
dc AS (SELECT doc_id, (CASE WHEN dangling = 0 THEN 3 ELSE 0 END + CASE WHEN top = top_read THEN 3 ELSE 0 END + greatest(0, 2 - 0.5 * (5 - n_statements)) + CASE WHEN mean_rows >= 10 THEN 1 ELSE 0 END + CASE WHEN periods_ok THEN 1 ELSE 0 END
 + CASE WHEN n = 0 OR n_data / n >= 0.9 THEN 3 WHEN n_data / n >= 0.7 THEN 2 ELSE 0 END + CASE WHEN n < 5 OR n_captions / n >= 0.4 THEN 2 WHEN n_captions / n >= 0.2 THEN 1 ELSE 0 END)::DOUBLE AS d_consistency, dangling, top = top_read AS refs_equal, round(mean_rows, 1) AS mean_rows, n_statements FROM d3)"""


@plan(f"WITH {CONSISTENCY_SQL} SELECT * FROM dc")
def sco4_consistency(t):
    return scoring.consistency(*consistency_inputs(t))


@plan(f"WITH {SECTIONS}, {NOISE_SQL} SELECT * FROM e")
def sco5_integrity(t):
    return scoring.integrity(sections(t))


@plan(f"WITH {SECTIONS}, {TOPIC_SQL} SELECT * FROM t")
def sco6_topics(t):
    return scoring.addressability(sections(t))


def scored(t):
    """All six dimensions of each document."""
    found = sections(t)
    parts = scoring.structure(found).select("doc_id", "form", "a_structure")
    for side in (scoring.content(found), scoring.retrieval(calls(t)), scoring.consistency(*consistency_inputs(t)), scoring.integrity(found), scoring.addressability(found)):
        parts = parts.join(side, "doc_id", "left")
    return scoring.graded(parts)


SCORED_SQL = f"""{SECTIONS}, {STRUCTURE_SQL}, {CONTENT_SQL}, {CALLS_SQL}, {CONSISTENCY_SQL}, {NOISE_SQL}, {TOPIC_SQL},
g0 AS (SELECT a.doc_id, a.form, n_hard_missing, max_length, dangling, refs_equal, mean_rows, n_statements, round(a_structure + coalesce(b_content, 0) + coalesce(c_search, 0) + coalesce(d_consistency, 0) + coalesce(e_noise, 0) + coalesce(s_semantic, 0), 2) AS total
 FROM a LEFT JOIN b USING (doc_id) LEFT JOIN cs USING (doc_id) LEFT JOIN dc USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id)),
g AS (SELECT *, CASE WHEN total >= {scoring.PASS} THEN 'pass' WHEN total >= {scoring.WARN} THEN 'warn' ELSE 'fail' END AS grade,
 concat_ws(',', CASE WHEN n_hard_missing > 0 THEN 'missing_items' END, CASE WHEN max_length > {scoring.HUGE_FAIL} THEN 'huge_section' END, CASE WHEN dangling > 0 THEN 'dangling_refs' END, CASE WHEN NOT coalesce(refs_equal, true) THEN 'refs_differ' END, CASE WHEN form <> '8-K' AND mean_rows = 0 THEN 'no_statement_rows' END) AS reasons FROM g0)"""


@plan(f"WITH {SCORED_SQL} SELECT doc_id, reasons FROM g")
def sco7_hard_gate(t):
    return scored(t).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@plan(f"WITH {SCORED_SQL} SELECT doc_id, form, total, grade FROM g")
def sco8_document_grade(t):
    return scored(t).select("doc_id", "form", "total", "grade")


@plan(f"""WITH {SCORED_SQL}, h AS (SELECT form, count(*) AS n, round(avg(total), 2) AS average, round(quantile_cont(total, 0.1), 2) AS p10, count(*) FILTER (reasons <> '') AS hard_failures, round(count(*) FILTER (n_statements > 0 AND mean_rows > 0) / count(*), 4) AS coverage, count(*) FILTER (total < {scoring.WARN}) AS low FROM g GROUP BY form)
SELECT form, n, average, p10, hard_failures, coverage, concat_ws(',', CASE WHEN hard_failures > 0 THEN 'hard_gate' END, CASE WHEN average < {scoring.BATCH_AVERAGE} THEN 'average' END, CASE WHEN p10 < {scoring.BATCH_P10} THEN 'p10' END, CASE WHEN low > 0 THEN 'low_document' END, CASE WHEN form <> '8-K' AND coverage < 0.99 THEN 'financial_coverage' END) AS failed FROM h""")
def sco9_form_gate(t):
    return scoring.batch(scored(t))


@plan("""WITH x AS (SELECT doc_id, unnest(['sections', 'tables', 'facts']) AS kind FROM documents), h AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'sections' ELSE 'tables' END AS kind FROM labels UNION SELECT doc_id, 'facts' FROM labels WHERE toxic = 0)
SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS missing FROM x ANTI JOIN h USING (doc_id, kind) GROUP BY doc_id""")
def sco10_completeness(t):
    """What of three expected results each document lacks."""
    expected = t.documents.select("doc_id", F.explode(F.array(*map(F.lit, ("sections", "tables", "facts")))).alias("kind"))
    have = t.labels.select("doc_id", F.when(F.col("quality") == 1, "sections").otherwise("tables").alias("kind")).union(t.labels.where("toxic = 0").select("doc_id", F.lit("facts"))).distinct()
    return expected.join(have, ["doc_id", "kind"], "left_anti").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("missing"))
