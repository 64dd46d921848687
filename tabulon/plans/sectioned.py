"""Sections of filings of several forms, from the headings among their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.operators import anchors, scoring, section_tree, sectioning
from tabulon.plans.registry import plan

TEN_K = list(scoring.PROFILES["10-K"].order)
TEN_Q = list(scoring.PROFILES["10-Q"].order)
EIGHT_K = list(scoring.PROFILES["8-K"].order)


def filing_lines(t, order: list[str]):
    """Lines of documents with a heading in front of every third one, and with a table of contents in front of every
    second document."""
    n = len(order)
    items = F.array(*map(F.lit, order))
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "text")).withColumn("heading", F.concat(F.get(items, ((F.floor(F.col("section") / 3) * F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1) + F.col("doc_id") % 3) % n).cast("int")), F.lit(". On it")))
    headed = lines.select("doc_id", F.explode(F.array(F.struct((F.col("section") * 2 + 100).alias("position"), F.when(F.col("section") % 3 == 0, F.col("heading")).alias("line")), F.struct((F.col("section") * 2 + 101).alias("position"), F.col("text").alias("line")))).alias("l")).select("doc_id", "l.*").where("line IS NOT NULL")
    contents = t.documents.where("doc_id % 2 = 0 AND text IS NOT NULL").select("doc_id", F.posexplode(F.transform(F.slice(items, 1, 8), lambda x: F.concat(x, F.lit(" .... 7")))).alias("position", "line"))
    return sectioning.placed_lines(headed.unionByName(contents))


def lines_sql(order: list[str]) -> str:
    n = len(order)
    return f"""d0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, section * 2 + 100 AS position, {order}[1 + ((section // 3) * CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END + doc_id % 3) % {n}] || '. On it' AS line FROM d0 WHERE section % 3 = 0 UNION ALL SELECT doc_id, section * 2 + 101, text FROM d0
 UNION ALL SELECT doc_id, unnest(range(8)), unnest({order}[1:8]) || ' .... 7' FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL),
d AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d1),
m AS (SELECT doc_id, list_position({order}, item)::INT - 1 AS idx, pos FROM (SELECT *, regexp_extract(line, '^((Part I+ - )?Item [0-9]+(\\.[0-9]+)?[A-Z]?)', 1) AS item FROM d) WHERE list_position({order}, item) > 0),
ends AS (SELECT doc_id, max(pos + length(line))::BIGINT AS e FROM d GROUP BY doc_id)"""


def items(t, order: list[str]):
    lines = filing_lines(t, order)
    item = F.regexp_extract("line", r"^((Part I+ - )?Item [0-9]+(\.[0-9]+)?[A-Z]?)", 1)
    return sectioning.markers(lines, item, F.array(*map(F.lit, order))), lines.groupBy("doc_id").agg(F.max(F.col("at") + F.length("line")).alias("end"))


PICKS_SQL = f"""w AS (SELECT *, row_number() OVER o AS n, lead(pos) OVER o - pos AS gap, lag(idx) OVER o AS before, lag(pos) OVER o AS last FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos, idx)),
st AS (SELECT * FROM w WHERE gap >= {sectioning.CONTENTS_SPAN} OR gap IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1),
c AS (SELECT doc_id, coalesce(CASE WHEN n <= {sectioning.CONTENTS_RUN} THEN -1 WHEN idx <= before THEN last ELSE pos END, -1) AS cursor FROM st),
f AS (SELECT doc_id, -1 AS k, cursor AS pos, false AS hit FROM c UNION ALL SELECT f.doc_id, k + 1, coalesce((SELECT min(m.pos) FROM m WHERE m.doc_id = f.doc_id AND m.idx = k + 1 AND m.pos > f.pos), f.pos), EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.idx = k + 1 AND m.pos > f.pos) FROM f WHERE k < 40),
p AS (SELECT doc_id, k AS idx, pos FROM f WHERE hit QUALIFY count(*) OVER (PARTITION BY doc_id) >= {sectioning.LEAST})"""
OUT_SQL = "SELECT doc_id, idx, pos AS start, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), e) AS \"end\" FROM p JOIN ends USING (doc_id)"


@plan(f"WITH RECURSIVE {lines_sql(TEN_K)}, {PICKS_SQL} {OUT_SQL}")
def doc3_annual_sections(t):
    """Items in order behind the table of contents; three at least."""
    found, ends = items(t, TEN_K)
    return sectioning.spans(sectioning.ordered_picks(found, sectioning.contents_end(found)), ends)


@plan(f"""WITH RECURSIVE {lines_sql(TEN_Q)}, {PICKS_SQL} {OUT_SQL}""")
def doc4_quarterly_sections(t):
    """The items of both parts, each part's in order and the second's behind the first's."""
    found, ends = items(t, TEN_Q)
    return sectioning.spans(sectioning.ordered_picks(found, sectioning.contents_end(found)), ends)


@plan(f"WITH {lines_sql(EIGHT_K)}, p AS (SELECT doc_id, idx, min(pos) AS pos FROM m GROUP BY ALL) {OUT_SQL}")
def doc6_event_sections(t):
    """The first heading of each distinct item."""
    found, ends = items(t, EIGHT_K)
    return sectioning.spans(sectioning.first_picks(found), ends)


@plan(f"WITH {lines_sql(TEN_K)}, w AS (SELECT *, row_number() OVER o AS n, lead(pos) OVER o - pos AS gap, lag(idx) OVER o AS before, lag(pos) OVER o AS last FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos, idx)), st AS (SELECT * FROM w WHERE gap >= {sectioning.CONTENTS_SPAN} OR gap IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1) SELECT doc_id, coalesce(CASE WHEN n <= {sectioning.CONTENTS_RUN} THEN -1 WHEN idx <= before THEN last ELSE pos END, -1)::BIGINT AS cursor FROM st")
def win9_contents_end(t):
    """Where the table of contents ends."""
    return sectioning.contents_end(items(t, TEN_K)[0])


QUARTERLY = ["Part I. Financial Information", "Item 1. Financial Statements", "Item 2. Discussion", "Item 3. Market Risk", "Item 4. Controls", "Part II. Other Information", "Item 1. Legal Proceedings", "Item 1A. Risk Factors", "Item 2. Sales", "Item 6. Exhibits", "SIGNATURE"]
ANNUAL = ["Item 3. Key Information", "Item 4. Company", "Item 5. Review", "Item 6. Directors", "Item 8. Accounts", "Item 15. Controls", "Item 18. Statements", "SIGNATURES"]


def report_lines(t, headings: list[str], guided: bool = False):
    """Lines of documents with the next of the headings in front of every second one, from another one on in each document
    (of a fifth from the first); contents in front of every other document, or a guide to lines that it has."""
    n = len(headings)
    start = F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("doc_id") % 3)
    heading = F.get(F.array(*map(F.lit, headings)), ((F.floor(F.col("k") / 2) + start) % n).cast("int"))
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    pair = F.array(F.struct((F.col("k") * 2 + 1000).alias("position"), F.when(F.col("k") % 2 == 0, heading).alias("line")), F.struct((F.col("k") * 2 + 1001).alias("position"), F.col("text").alias("line")))
    body = lines.select("doc_id", F.explode(pair).alias("l")).select("doc_id", "l.*").where("line IS NOT NULL")
    listed = F.transform(F.array(*map(F.lit, headings[:-1])), lambda h: F.concat(h, F.lit(" .... 7")))
    front = t.documents.where("doc_id % 2 = 0 AND text IS NOT NULL").select("doc_id", F.posexplode(listed).alias("position", "line"))
    if guided:
        token = F.get(F.array(*map(F.lit, ["3", "4", "5", "18", "6", "8", "15"])), F.col("k"))
        row = F.concat(F.lit("Item "), token, F.lit(" Caption | "), F.regexp_replace(F.substring("text", 1, 60), r"[^A-Za-z ]+", " "), F.lit(", 12"))
        front = front.unionByName(lines.where("doc_id % 7 = 0 AND k < 7 AND length(text) > 12").select("doc_id", (F.col("k") + 500).alias("position"), row.alias("line")))
    return sectioning.placed_lines(body.unionByName(front))


@plan()
def doc4_quarterly_report(t):
    """Parts by their anchors and the items in them; what a walk over the lines finds (tests)."""
    return anchors.quarterly_sections(report_lines(t, QUARTERLY))


@plan()
def doc5_foreign_report(t):
    """Items by number behind the contents, or by the document's own guide."""
    return anchors.foreign_sections(report_lines(t, ANNUAL, guided=True))


LINES_SQL = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l0)"""


def numbered_lines(t):
    return sectioning.placed_lines(t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")))


@plan(f"""WITH {LINES_SQL}, h AS (SELECT doc_id, k, pos, 1 + length(line) % 4 AS level, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS section FROM l WHERE k % 3 = 1),
s AS (SELECT h.*, (SELECT max(p.section) FROM h p WHERE p.doc_id = h.doc_id AND p.section < h.section AND p.level < h.level) AS parent,
  coalesce((SELECT min(n.pos) FROM h n WHERE n.doc_id = h.doc_id AND n.section > h.section AND n.level <= h.level), (SELECT max(pos + length(line)) FROM l WHERE l.doc_id = h.doc_id)) AS "end" FROM h),
tables AS (SELECT l.doc_id, l.k, max(h.section) AS section FROM l JOIN h ON h.doc_id = l.doc_id AND h.pos < l.pos WHERE l.k % 4 = 3 AND l.k % 3 <> 1 GROUP BY ALL)
SELECT CAST(doc_id AS BIGINT) AS doc_id, section, parent, CAST(level AS INTEGER) AS level, pos AS start, CAST("end" AS BIGINT) AS "end",
  coalesce((SELECT string_agg(c.section, ',' ORDER BY c.section) FROM s c WHERE c.doc_id = s.doc_id AND c.parent = s.section), '') AS children,
  coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM tables WHERE tables.doc_id = s.doc_id AND tables.section = s.section), '') AS tables FROM s""")
def doc7_section_tree(t):
    """Every third line as a heading of one of four levels, every fourth as a table."""
    lines = numbered_lines(t)
    headings = lines.where("position % 3 = 1").select("doc_id", "at", (1 + F.length("line") % 4).alias("level"), F.col("line").alias("title"))
    tables = lines.where("position % 4 = 3 AND position % 3 <> 1").select("doc_id", F.col("position").alias("table"), "at")
    sizes = lines.groupBy("doc_id").agg(F.max(F.col("at") + F.length("line")).alias("size"))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return section_tree.section_tree(headings, tables, sizes).select("doc_id", "section", "parent", "level", "start", "end", listed("children"), listed("tables"))


NORM_SQL = "lower(translate(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '’‘`“”', '\"\"'))"
FULL = section_tree.FINGERPRINT_CHARS


@plan(f"""WITH {LINES_SQL}, n AS (SELECT doc_id, k, k // 4 AS section, {NORM_SQL.format('line')} AS said FROM l),
p AS (SELECT *, rtrim(left(said, {FULL})) AS print, string_split(coalesce(lag(said) OVER (PARTITION BY doc_id ORDER BY k), ''), ' ') AS words FROM n),
sections AS (SELECT doc_id, k // 4 AS section, {NORM_SQL.format("string_agg(line, ' ' ORDER BY k)")} AS content FROM l GROUP BY ALL),
having_ AS (SELECT *, count(*) OVER (PARTITION BY doc_id, print) AS n FROM (SELECT DISTINCT doc_id, section, print FROM p WHERE k % 2 = 0 AND print <> '')),
t AS (SELECT * FROM p WHERE k % 2 = 0),
clear AS (SELECT t.doc_id, k, h.section, 'fingerprint' AS way FROM t JOIN having_ h USING (doc_id, print) WHERE n = 1),
told AS (SELECT doc_id, k, print, unnest(m) AS marker, unnest(range(len(m))) AS rank FROM (SELECT doc_id, k, print, list_filter(list_concat(
    [CASE WHEN length(said) > {FULL} THEN said END], list_transform({list(section_tree.BEGINNINGS)}, lambda b: CASE WHEN length(said) >= b THEN rtrim(left(said, b)) END),
    list_transform({list(section_tree.TAIL_WORDS)}, lambda b: CASE WHEN len(words) >= b AND length(array_to_string(words[-b:], ' ')) >= {section_tree.TAIL_CHARS} THEN array_to_string(words[-b:], ' ') END)), lambda x: x IS NOT NULL) AS m FROM t)),
met AS (SELECT told.doc_id, k, rank, min(section) AS section FROM told JOIN having_ h USING (doc_id, print) JOIN sections USING (doc_id, section) WHERE n > 1 AND contains(content, marker) GROUP BY told.doc_id, k, rank HAVING count(*) = 1),
marked AS (SELECT doc_id, k, min_by(section, rank) AS section, 'marker' AS way FROM met GROUP BY doc_id, k)
SELECT t.doc_id, CAST(t.k AS BIGINT) AS "table", CAST(coalesce(clear.section, marked.section) AS BIGINT) AS section, coalesce(clear.way, marked.way) AS way FROM t LEFT JOIN clear USING (doc_id, k) LEFT JOIN marked USING (doc_id, k)""")
def join6_table_sections(t):
    """Every second line as a table, every four lines as a section."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("k"))
    tables = lines.withColumn("context", before).where("k % 2 = 0").select("doc_id", F.col("k").cast("long").alias("table"), F.col("line").alias("text"), "context")
    listed = F.array_sort(F.collect_list(F.struct("k", "line")))
    sections = lines.groupBy("doc_id", F.floor(F.col("k") / 4).alias("section")).agg(listed.alias("ls"))
    sections = sections.select("doc_id", "section", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("text"), F.transform(F.filter("ls", lambda x: x["k"] % 2 == 0), lambda x: x["line"]).alias("tables"))
    return section_tree.table_sections(tables, sections)
