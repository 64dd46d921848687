"""The search call, stage by stage and as a whole, over the lines of documents as sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import lexicon as L
from tabulon.operators import finder, search
from tabulon.plans.registry import plan

#: What lines are given besides their text, so that every branch of the search has something to find.
WORDS = ["market", "competition", "risk", "students", "revenue", "board", "litigation", "competitor", "sales", "net profit", "ethics", "customer"]
TOPICS = ["business", "risk_factors", "mda", "directors", "misc"]
ASKED = ["licenses", "risk management", "market competition", "net income", '"under the"', "anti-ethics/board", "nowhere found"]
ONE = ["market competition"]


def sections(t):
    """A section for each line: its first 40 characters are the title, and a word and a topic are dealt to it."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (1 + i % len(words)).cast("int"))
    rows = rows.select("doc_id", "section", F.substring("line", 1, 40).alias("title"), F.concat(F.lit("Item "), (F.col("section") % 9).cast("string")).alias("item"), pick(TOPICS, F.col("doc_id") + F.col("section")).alias("topic"), F.concat_ws(" ", "line", pick(WORDS, F.col("doc_id") * 7 + F.col("section"))).alias("content"))
    return rows.select("doc_id", "section", "title", "item", "topic", F.concat_ws(" ", "item", "topic").alias("path"), F.substring("content", 1, 200).alias("preview"), "content")


SECTIONS = f"""s AS (SELECT doc_id, section, title, item, topic, item || ' ' || topic AS path, substr(content, 1, 200) AS preview, content FROM (
 SELECT doc_id, section, substr(line, 1, 40) AS title, 'Item ' || (section % 9) AS item, {TOPICS}[1 + (doc_id + section) % 5] AS topic, line || ' ' || {WORDS}[1 + (doc_id * 7 + section) % 12] AS content FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS section FROM documents WHERE text IS NOT NULL)))"""


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def best(words: str, table: dict, otherwise: str) -> str:
    sizes = "[" + ", ".join(f"len(list_intersect({words}, {list(v)}))" for v in table.values()) + "]"
    return f"CASE WHEN list_max({sizes}) = 0 THEN '{otherwise}' ELSE {list(table)}[list_position({sizes}, list_max({sizes}))] END"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def search_sql(queries: list[str], mode: str, out: str, budget: int | None = None) -> str:
    """The CTEs of the whole call, and ``out`` selected from them."""
    key = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    topics = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.TOPIC_BUCKETS.items())
    bucket = f"CASE lower(trim(topic)) {topics} ELSE {best('list_distinct(' + toks(chr(39).join(['path || ', ' ', ' || title || ', ' ', ' || item'])) + ')', L.BUCKET_WORDS, 'other')} END"
    expected = " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in L.INTENT_BUCKETS.items())
    fields = list(search.WEIGHTS)
    weighted = " + ".join(f"{w} * c_{f} / CASE WHEN {a} > 0 THEN 1 - {search.LENGTH_B[f]} + {search.LENGTH_B[f]} * n_{f} / {a} ELSE 1 END" for f, w in search.WEIGHTS.items() for a in [f"avg_{'preview' if f == 'content' else f}"])
    single = len(queries) == 1
    noise = "0.0"
    for name, bad in L.NOISE.items():
        n = f"len(list_intersect(list_distinct({toks('context')}), {list(bad)}))"
        noise = f"CASE WHEN intent <> '{name}' OR {n} = 0 THEN 0.0 WHEN list_has_any({toks('context')}, {list(L.SUPPORT[name])}) THEN 0.8 ELSE least(2.0, 0.6 + 0.25 * {n}) END"
    cap = f"greatest({search.CAP_LEAST}, floor(n * {search.CAP_SHARE}))"
    cap = f"CASE WHEN x <= {budget} THEN least({cap}, greatest({search.CAP_LEAST}, {budget} - x)) ELSE {cap} END" if budget else cap
    centred = lambda base, text, width: f"CASE WHEN length({base}) <= {width} THEN {base} WHEN instr(lower({base}), lower({text})) = 0 THEN substr({base}, 1, {width}) ELSE substr({base}, (greatest(0, least(length({base}), greatest(0, instr(lower({base}), lower({text})) - 1 - {width // 2}) + {width}) - {width}) + 1)::BIGINT, {width}) END"
    return f"""WITH {SECTIONS},
q(query_no, query) AS (VALUES {', '.join(f'({i}, {quoted(x)})' for i, x in enumerate(queries))}),
qt AS (SELECT query_no, query, {toks('query')} AS w FROM q),
t AS (SELECT query_no, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM qt),
infl AS (SELECT *, left(word, length(word) - 3) || 'y' AS x FROM t WHERE word LIKE '%ies' AND length(word) > 4
 UNION ALL SELECT *, left(word, length(word) - 2) FROM t WHERE word LIKE '%es' AND length(word) > 3
 UNION ALL SELECT *, CASE WHEN word LIKE '%s' AND length(word) > 3 THEN left(word, length(word) - 1) ELSE word || 's' END FROM t),
v AS (SELECT query_no, replace(query, '-', ' ') AS text FROM q WHERE contains(query, '-') UNION SELECT query_no, replace(query, '/', ' ') FROM q WHERE contains(query, '/')
 UNION SELECT query_no, array_to_string(list_concat(list_concat(list_filter(w, lambda z, k: k < i), [x]), list_filter(w, lambda z, k: k > i)), ' ') FROM infl WHERE length(word) >= 3),
syn(g, term) AS (VALUES {', '.join(f'({g}, {quoted(x)})' for g, group in enumerate(L.SYNONYMS) for x in group)}),
y AS (SELECT DISTINCT q.query_no, b.term AS text FROM q JOIN syn a ON a.term = {key('query')} JOIN syn b ON a.g = b.g),
e AS (SELECT query_no, 1 AS kind, 0 AS i, 'phrase_variant' AS strategy, trim(text) AS text FROM v UNION ALL SELECT query_no, 2, 0, 'synonym', text FROM y
 UNION ALL SELECT query_no, 3, i, 'token', word FROM t WHERE length(word) >= 3 AND word NOT IN {L.STOP_WORDS}),
x AS (SELECT query_no, row_number() OVER (PARTITION BY query_no ORDER BY kind, i, text) AS step, strategy, text FROM (
 SELECT e.* FROM e JOIN q USING (query_no) WHERE {key('text')} <> '' AND {key('text')} <> {key('query')} AND '{mode}' <> 'exact' AND ('{mode}' <> 'keyword' OR kind = 3)
 QUALIFY row_number() OVER (PARTITION BY e.query_no, {key('text')} ORDER BY kind, i, text) = 1)),
terms AS (SELECT query_no, 0 AS step, 'exact' AS strategy, trim(replace(query, '"', '')) AS text FROM q WHERE '{mode}' IN ('auto', 'exact') UNION ALL SELECT * FROM x),
p AS (SELECT *, {bucket} AS bucket, list_distinct({toks("coalesce(title, '') || ' ' || item || ' ' || topic || ' ' || path || ' ' || preview")}) AS tokens FROM s),
f AS (SELECT doc_id, tok, count(*) AS df FROM (SELECT doc_id, unnest(tokens) AS tok FROM p) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
g AS (SELECT n.doc_id, qt.query_no, len(w) AS n_tokens, len(list_filter(w, lambda z: z IN {L.GENERIC})) AS generic, {best('list_distinct(w)', L.INTENTS, 'general')} AS intent,
 coalesce((SELECT sum(df) FROM f, t WHERE f.doc_id = n.doc_id AND t.query_no = qt.query_no AND f.tok = t.word), 0) / n AS share FROM n, qt),
d AS (SELECT doc_id, query_no, n_tokens, CASE WHEN n_tokens = 0 THEN 0 ELSE round((generic / n_tokens + share / n_tokens + CASE WHEN n_tokens <= 2 THEN 1 ELSE 0 END) / 3, 4) END AS ambiguity, intent FROM g),
pl AS (SELECT *, ambiguity >= {finder.AMBIGUOUS} AND n_tokens > 0 AS high, '{mode}' IN ('auto', 'exact') AS run_exact, CASE WHEN '{mode}' = 'exact' THEN 0 WHEN '{mode}' = 'auto' AND ambiguity >= {finder.AMBIGUOUS} AND n_tokens > 0 THEN 2 ELSE 1 END AS phases,
 '{mode}' = 'auto' AND ambiguity >= {finder.AMBIGUOUS} AND n_tokens > 0 AS gated, '{mode}' = 'auto' AND ambiguity >= {finder.AMBIGUOUS} AND n_tokens > 0 AND intent <> 'general' AS scoped FROM d),
r AS (SELECT p.* EXCLUDE (tokens), terms.* FROM p JOIN terms ON contains(lower(content), lower(text)) OR contains(lower(title), lower(text))),
a0 AS (SELECT r.*, pl.* EXCLUDE (doc_id, query_no), coalesce(list_contains(CASE intent {expected} END, bucket), false) AS aligned, count(*) FILTER (step = 0) OVER (PARTITION BY r.doc_id, r.query_no) AS n_exact FROM r JOIN pl ON r.doc_id = pl.doc_id AND r.query_no = pl.query_no),
a1 AS (SELECT *, count(*) FILTER (aligned) OVER (PARTITION BY doc_id, query_no, step) AS n_in FROM a0 WHERE step = 0 OR '{mode}' <> 'auto' OR n_exact = 0),
a AS (SELECT *, scoped AND step > 0 AND strategy = 'token' AND n_in = 0 AS opened FROM a1 WHERE NOT (scoped AND step > 0) OR aligned OR n_in = 0),
tt AS (SELECT DISTINCT unnest({toks('text')}) AS tok FROM terms),
l AS (SELECT doc_id, section, {', '.join(f'{toks(f)} AS t_{f}' for f in fields)} FROM s),
m AS (SELECT doc_id, count(*) AS n, {', '.join(f'avg(len(t_{f})) AS avg_{f}' for f in fields if f != 'content')} FROM l GROUP BY doc_id),
c AS (SELECT doc_id, section, tok, {', '.join(f'len(t_{f}) AS n_{f}, len(list_filter(t_{f}, lambda z: z = tok)) AS c_{f}' for f in fields)} FROM l, tt),
df AS (SELECT doc_id, tok, count(*) AS df FROM c WHERE {' + '.join(f'c_{f}' for f in fields if f != 'content')} > 0 GROUP BY ALL),
w AS (SELECT c.doc_id, section, c.tok, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, {weighted} AS weighted FROM c JOIN m ON c.doc_id = m.doc_id JOIN df ON c.doc_id = df.doc_id AND c.tok = df.tok),
sc AS (SELECT doc_id, section, tok, idf * {search.K1 + 1} * weighted / ({search.K1} + weighted) AS score FROM w WHERE weighted > 0),
b0 AS (SELECT a.*, CASE WHEN contains(lower(content), lower(text)) THEN content ELSE title || ' ' || content END AS base FROM a),
b1 AS (SELECT *, CASE strategy WHEN 'exact' THEN 0 WHEN 'phrase_variant' THEN 1 WHEN 'synonym' THEN 2 ELSE 3 END AS priority, {centred('base', 'text', finder.CONTEXT_CHARS)} AS context FROM b0),
b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY doc_id, section, title, context ORDER BY priority, query_no, step) = 1),
bs AS (SELECT u.doc_id, u.section, u.query_no, u.step, sum(score) AS score FROM (SELECT doc_id, section, query_no, step, unnest({toks('text')}) AS tok FROM b2) u JOIN sc ON u.doc_id = sc.doc_id AND u.section = sc.section AND u.tok = sc.tok GROUP BY ALL),
b3 AS (SELECT b2.*, round(coalesce(bs.score, 0), 6) AS score, CASE WHEN {str(single).lower()} AND intent <> 'general' THEN aligned::INT ELSE 0 END AS alignment, {noise if single else '0.0'} AS noise,
 list_filter(list_transform(list_distinct(list_filter({toks('text')}, lambda z: length(z) >= 3 AND z NOT IN {L.STOP_WORDS})), lambda z: list_position(list_transform({toks('context')}, lambda o: starts_with(o, z) OR starts_with(z, o)), true)), lambda z: coalesce(z, 0) > 0) AS places
 FROM b2 LEFT JOIN bs ON b2.doc_id = bs.doc_id AND b2.section = bs.section AND b2.query_no = bs.query_no AND b2.step = bs.step),
b4 AS (SELECT *, (CASE WHEN len(places) >= 2 THEN list_max(places) - list_min(places) ELSE 0 END)::BIGINT AS proximity FROM b3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, alignment DESC, noise, score DESC, proximity, section, context, query_no, step) AS rank FROM b4),
k0 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) FILTER (strategy = 'exact') OVER (PARTITION BY doc_id) AS x, row_number() OVER (PARTITION BY doc_id, strategy = 'exact' ORDER BY rank) AS own FROM b),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY strategy <> 'exact', rank) AS rank, section, title, item, topic, text AS matched_query, strategy, strategy = 'exact' AS is_exact_phrase, {centred('context', 'text', finder.MATCHED_CHARS)} AS matched_text, context, score, opened, query_no
 FROM k0 WHERE n < {search.CAP_FROM} OR x = 0 OR strategy = 'exact' OR own <= {cap}),
z0 AS (SELECT doc_id, section, count(*) AS n, count(*) FILTER (is_exact_phrase) AS x, min(rank) AS first FROM k GROUP BY ALL),
z1 AS (SELECT doc_id, section AS next_section FROM z0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, x DESC, first) = 1),
z2 AS (SELECT doc_id, count(*) FILTER (is_exact_phrase) AS exact_phrase_matches, count(*) FILTER (NOT is_exact_phrase) AS expansion_matches FROM k GROUP BY doc_id),
z AS (SELECT *, CASE WHEN exact_phrase_matches > 0 AND expansion_matches > 0 THEN 'mixed' WHEN exact_phrase_matches > 0 THEN 'exact' ELSE 'expansion_only' END AS primary_source FROM z2 JOIN z1 USING (doc_id))
{out}"""


def hashed(df, *columns: str):
    """Long texts as their hashes."""
    return df.withColumns({c: F.sha2(F.col(c).cast("binary"), 256) for c in columns})


def entries(t, queries, mode="auto"):
    return finder.ranked(finder.entries_of(sections(t), queries, mode), ["doc_id"])


@plan("SELECT * FROM (VALUES (0, 'Risk Factors'), (1, 'revenue'), (2, 'board')) AS v(query_no, query)")
def srch1_queries(t):
    """Blank queries go, and those that only differ in case."""
    asked, mode = finder.resolve([" Risk Factors", None, "revenue", "  ", "REVENUE", "risk factors", "board "], None)
    return finder.query_table(t.spark, asked, mode).select("query_no", "query")


@plan(search_sql(ASKED, "auto", "SELECT doc_id, section, bucket, len(tokens)::INT AS n_tokens, sha256(array_to_string(list_sort(tokens), ' ')) AS tokens FROM p"))
def srch2_profiles(t):
    found = finder.profile(sections(t))
    return hashed(found.select("doc_id", "section", "bucket", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("tokens"), " ").alias("tokens")), "tokens")


@plan(search_sql(ASKED, "auto", "SELECT doc_id, query_no, n_tokens::INT AS n_tokens, ambiguity, intent, high, run_exact, phases, gated, scoped FROM pl"))
def srch5_plan(t):
    return finder.search_plan(finder.diagnose(finder.profile(sections(t)), ASKED, "auto"), "auto")


@plan(search_sql(ASKED, "semantic", "SELECT query_no, step::INT AS step, strategy, text FROM x"))
def srch6_steps(t):
    return finder.expansions(finder.query_table(t.spark, ASKED, "semantic"))


@plan(search_sql(["anti-ethics/board", "risk", "the cities of the gas"], "keyword", "SELECT query_no, step::INT AS step, strategy, text FROM x"))
def srch6_keyword_steps(t):
    return finder.expansions(finder.query_table(t.spark, ["anti-ethics/board", "risk", "the cities of the gas"], "keyword"))


@plan(search_sql(ASKED, "exact", "SELECT doc_id, section, query_no, text FROM r"))
def srch7_exact(t):
    terms = [(i, 0, "exact", q.replace('"', "").strip()) for i, q in enumerate(ASKED)]
    return finder.recall(sections(t), terms).select("doc_id", "section", "query_no", "text")


@plan(search_sql(ASKED, "auto", "SELECT doc_id, section, query_no, step::INT AS step, strategy, opened FROM a"))
def srch9_admitted(t):
    steps = [tuple(r) for r in finder.expansions(finder.query_table(t.spark, ASKED, "auto")).collect()]  # of seven queries
    profiles = finder.profile(sections(t))
    hits = finder.recall(sections(t), [(i, 0, "exact", q.replace('"', "").strip()) for i, q in enumerate(ASKED)] + steps).join(profiles.select("doc_id", "section", "bucket"), ["doc_id", "section"])
    plans = finder.search_plan(finder.diagnose(profiles, ASKED, "auto"), "auto")
    return finder.admitted(hits, plans, "auto").select("doc_id", "section", "query_no", "step", "strategy", "opened")


@plan(search_sql(ONE, "auto", "SELECT doc_id, section, text, alignment, noise::DOUBLE AS noise, proximity FROM b"))
def srch18_alignment(t):
    return entries(t, ONE).select("doc_id", "section", "text", "alignment", "noise", "proximity")


@plan(search_sql(ONE, "semantic", "SELECT doc_id, section, rank, text, priority, score FROM b"))
def srch21_order(t):
    return entries(t, ONE, "semantic").select("doc_id", "section", "rank", "text", "priority", "score")


@plan(search_sql(ASKED, "auto", "SELECT doc_id, rank, section, query_no, strategy, sha256(matched_text) AS matched_text, sha256(context) AS context FROM k", 9))
def srch14_evidence(t):
    found = finder.search_documents(sections(t), ASKED, display_budget=9)
    return hashed(found.select("doc_id", "rank", "section", "query_no", "strategy", "matched_text", "context"), "matched_text", "context")


@plan(search_sql(ASKED, "auto", f"SELECT doc_id, exact_phrase_matches, expansion_matches, primary_source, next_section, CASE WHEN exact_phrase_matches + expansion_matches > {finder.TOO_MANY} THEN 'narrow' WHEN primary_source = 'expansion_only' THEN 'read_top' WHEN primary_source = 'mixed' THEN 'read_exact' END AS hint FROM z"))
def srch24_hints(t):
    return finder.summary(finder.search_documents(sections(t), ASKED))


@plan(search_sql(ASKED, "auto", "SELECT * EXCLUDE (context, matched_text, query_no) REPLACE (sha256(title) AS title), sha256(context) AS context, sha256(matched_text) AS matched_text FROM k"))
def api4_search(t):
    """The whole call: seven queries in every document."""
    return hashed(finder.search_documents(sections(t), ASKED), "title", "context", "matched_text").drop("query_no")
