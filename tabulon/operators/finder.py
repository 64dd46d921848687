"""One search call over the sections of documents: plan, recall, ranking, cap, evidence, and what to read next.

A call has at most MOST_QUERIES queries, so these and their expansions are literals of the plan; everything that grows
with the documents is a column. Sections have doc_id, section, title, item, topic, path, preview and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.functions import lexicon as L
from tabulon.operators import dedup, search

MODES = ("auto", "exact", "keyword", "semantic")
#: Queries of a call, from when a query is ambiguous, and the characters of a hit's text and context.
MOST_QUERIES, AMBIGUOUS, MATCHED_CHARS, CONTEXT_CHARS = 20, 0.62, 120, 600
#: Fixed value: from more hits than this on, the call says that it was too wide.
TOO_MANY = 40


def resolve(queries: list[str | None], mode: str | None = None) -> tuple[list[str], str]:
    """Trimmed queries without blanks and repeats, and the mode; ValueError where none or too many are left."""
    found: dict[str, str] = {}
    for q in queries:
        if q and q.strip():
            found.setdefault(q.strip().lower(), q.strip())
    mode = (mode or "").strip().lower() or "auto"
    if not 1 <= len(found) <= MOST_QUERIES or mode not in MODES:
        raise ValueError(f"a call takes 1 to {MOST_QUERIES} queries and one of the modes {MODES}")
    return list(found.values()), mode


def query_table(spark: SparkSession, queries: list[str], mode: str) -> DataFrame:
    return spark.createDataFrame([(i, q, mode) for i, q in enumerate(queries)], "query_no int, query string, mode string")


def literals(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def key_of(query: Column) -> Column:
    return C.collapsed(F.lower(query))


def inflections(word: Column) -> Column:
    """Other numbers of an English word, in order."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    plural = word.endswith("s") & (n > 3)
    found = [F.when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))), F.when(word.endswith("es") & (n > 3), cut(2)), F.when(plural, cut(1)).otherwise(F.concat(word, F.lit("s")))]
    return F.when(n >= 3, F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))).otherwise(F.array().cast("array<string>"))


def variants(query: Column) -> Column:
    """Spellings of the phrase: without hyphens and slashes, and with one word in another number; in order."""
    words = C.tokens(query)
    put = lambda i, w: F.array_join(F.concat(F.slice(words, 1, i), F.array(w), F.slice(words, i + 2, F.size(words))), " ")
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.flatten(F.transform(places, lambda i: F.transform(inflections(F.get(words, i)), lambda w: put(i, w))))
    apart = F.array_compact(F.array(*[F.when(F.contains(query, F.lit(c)), F.replace(query, F.lit(c), F.lit(" "))) for c in "-/"]))
    return F.array_sort(F.array_distinct(F.concat(apart, numbers)))


def synonyms(query: Column) -> Column:
    """The other terms of every group that the query is one of, in order."""
    groups = [F.when(key_of(query).isin(*g), literals(g)) for g in L.SYNONYMS]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*groups)))))


def expansions(queries: DataFrame) -> DataFrame:
    """(query_no, step, strategy, text) of ``queries(query_no, query, mode)``, in the order in which they are tried: phrase
    variants, synonyms, words; no text twice, nor the query itself. Keyword mode has the words alone, exact mode nothing."""
    told = lambda texts, strategy: F.transform(texts, lambda x: F.struct(F.lit(strategy).alias("strategy"), F.trim(x).alias("text")))
    query, none = F.trim("query"), F.array().cast("array<struct<strategy:string,text:string>>")
    words = F.filter(C.tokens(query), lambda w: (F.length(w) >= 3) & ~w.isin(*L.STOP_WORDS))
    phrases = F.concat(told(variants(query), "phrase_variant"), told(synonyms(query), "synonym"))
    every = F.when(F.col("mode") == "exact", none).when(F.col("mode") == "keyword", told(words, "token")).otherwise(F.concat(phrases, told(words, "token")))
    each = queries.select("query_no", "query", F.posexplode(every).alias("at", "e")).select("query_no", "query", "at", "e.*").withColumn("key", key_of(F.col("text")))
    first = dedup.keep_best(each.where((F.col("key") != "") & (F.col("key") != key_of(F.col("query")))), ["query_no", "key"], [F.asc("at")])
    return first.select("query_no", F.row_number().over(Window.partitionBy("query_no").orderBy("at")).alias("step"), "strategy", "text")


def bucket(topic: Column, path: Column, title: Column, item: Column) -> Column:
    """Bucket of a section: that of its topic, or the one that most of its words speak for."""
    words = F.array_distinct(C.tokens(F.concat_ws(" ", path, title, item)))
    scores = [F.struct(F.size(F.array_intersect(words, literals(own))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, own) in enumerate(L.BUCKET_WORDS.items())]
    best = F.array_max(F.array(*scores))
    known = F.create_map(*[F.lit(x) for pair in L.TOPIC_BUCKETS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.trim(F.lower(topic))), F.when(best["n"] > 0, best["name"]).otherwise("other"))


def profile(sections: DataFrame) -> DataFrame:
    """(doc_id, section, tokens, bucket): distinct words of all fields but the content."""
    fields = [F.coalesce(f, F.lit("")) for f in ("title", "item", "topic", "path", "preview")]
    return sections.select("doc_id", "section", F.array_distinct(C.tokens(F.concat_ws(" ", *fields))).alias("tokens"), bucket(F.coalesce("topic", F.lit("")), F.col("path"), F.col("title"), F.col("item")).alias("bucket"))


def intent(words: Column) -> Column:
    scores = [F.struct(F.size(F.array_intersect(words, literals(own))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, own) in enumerate(L.INTENTS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def diagnose(profiles: DataFrame, queries: list[str], mode: str) -> DataFrame:
    """(doc_id, query_no, n_tokens, ambiguity, high, intent): how little each query says in each document."""
    words = [C.tokens(F.lit(q)) for q in queries]
    each = profiles.select("doc_id", *[F.filter(w, lambda x: F.array_contains("tokens", x)).alias(f"w{i}") for i, w in enumerate(words)])
    # A word's share of the sections, summed over a query's words, is the sections' hits of all its words by their number.
    stats = each.groupBy("doc_id").agg(*[(F.sum(F.size(f"w{i}")) / F.count("*")).alias(f"s{i}") for i in range(len(queries))])

    def one(i: int) -> Column:
        n = F.size(words[i])
        score = search.ambiguity(F.size(F.filter(words[i], lambda w: w.isin(*L.GENERIC))), n, F.when(n > 0, F.col(f"s{i}") / n).otherwise(0.0))
        fields = [F.lit(i).alias("query_no"), n.alias("n_tokens"), score.alias("ambiguity"), ((score >= AMBIGUOUS) & (n > 0)).alias("high"), intent(words[i]).alias("intent")]
        return F.struct(*fields)

    return stats.select("doc_id", F.explode(F.array(*map(one, range(len(queries))))).alias("d")).select("doc_id", "d.*")


def search_plan(diagnosed: DataFrame, mode: str) -> DataFrame:
    """Of each diagnosis: whether exact hits are looked for, whether words come in a second phase, and whether what is
    found by expansions is held to the intent first."""
    gated = F.lit(mode == "auto") & F.col("high")
    phases = F.when(F.lit(mode == "exact"), 0).when(gated, 2).otherwise(1)
    return diagnosed.withColumns({"run_exact": F.lit(mode in ("auto", "exact")), "phases": phases, "gated": gated, "scoped": gated & (F.col("intent") != "general")})


def recall(sections: DataFrame, terms: list[tuple[int, int, str, str]]) -> DataFrame:
    """The sections with every (query_no, step, strategy, text) that their title or content holds, whatever the case."""
    body = F.lower(F.coalesce("content", F.lit("")))
    told = [F.struct(F.lit(q).alias("query_no"), F.lit(s).alias("step"), F.lit(k).alias("strategy"), F.lit(x).alias("text"), F.lit(x.lower()).alias("lower")) for q, s, k, x in terms]
    found = sections.withColumns({"__body": body, "__title": F.lower(F.coalesce("title", F.lit("")))})
    hit = F.filter(F.array(*told), lambda t: F.contains("__body", t["lower"]) | F.contains("__title", t["lower"]))
    return found.withColumn("t", F.explode(hit)).select(*sections.columns, "__body", "t.query_no", "t.step", "t.strategy", "t.text", "t.lower")


def admitted(hits: DataFrame, plans: DataFrame, mode: str) -> DataFrame:
    """Hits that the plan admits: expansions only where auto mode has no exact hit, and those within the intent only,
    where there are any and the plan says so; ``opened`` marks words let in without one."""
    by_query, by_step = Window.partitionBy("doc_id", "query_no"), Window.partitionBy("doc_id", "query_no", "step")
    wanted = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in L.INTENT_BUCKETS.items() for x in (F.lit(k), literals(v))]), F.col("intent")), F.col("bucket")), F.lit(False))
    found = hits.join(plans, ["doc_id", "query_no"]).withColumns({"aligned": wanted, "n_exact": F.count_if(F.col("step") == 0).over(by_query)})
    found = found.where((F.col("step") == 0) | F.lit(mode != "auto") | (F.col("n_exact") == 0)).withColumn("n_in", F.count_if("aligned").over(by_step))
    scoped = F.col("scoped") & (F.col("step") > 0)
    found = found.where(~scoped | F.col("aligned") | (F.col("n_in") == 0))
    return found.withColumn("opened", scoped & (F.col("strategy") == "token") & (F.col("n_in") == 0)).drop("n_exact", "n_in")


def noise(context: Column, intent_of: Column) -> Column:
    """Penalty for words around a hit that speak against the intent."""
    words = C.tokens(context)
    out = F.lit(0.0)
    for name, bad in L.NOISE.items():
        n = F.size(F.array_intersect(words, literals(bad)))
        rate = F.when(n == 0, 0.0).when(F.arrays_overlap(words, literals(L.SUPPORT[name])), 0.8).otherwise(F.least(F.lit(2.0), 0.6 + 0.25 * n))
        out = F.when(intent_of == name, rate).otherwise(out)
    return out


def proximity(context: Column, text: Column) -> Column:
    """Words between the first places of the query's words, a prefix of either kind being enough; 0 with fewer than two."""
    wanted = F.array_distinct(F.filter(C.tokens(text), lambda w: (F.length(w) >= 3) & ~w.isin(*L.STOP_WORDS)))
    words = C.tokens(context)
    place = lambda q: F.array_position(F.transform(words, lambda c: c.startswith(q) | q.startswith(c)), True)
    places = F.filter(F.transform(wanted, place), lambda p: p > 0)
    return F.when(F.size(places) >= 2, F.array_max(places) - F.array_min(places)).otherwise(F.lit(0)).cast("long")


def priority(strategy: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in search.PRIORITY.items() for x in pair]), strategy)


def ranked(entries: DataFrame, scope: list[str]) -> DataFrame:
    """Entries with their ``rank`` in each scope: priority, intent, noise, score, proximity, section, context."""
    order = [F.asc("priority"), F.desc("alignment"), F.asc("noise"), F.desc("score"), F.asc("proximity"), F.asc("section"), F.asc("context"), F.asc("query_no"), F.asc("step")]
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))


def entries_of(sections: DataFrame, queries: list[str], mode: str) -> DataFrame:
    """All hits of a call, deduplicated and with everything that they are ranked by."""
    spark = sections.sparkSession
    steps = [tuple(r) for r in expansions(query_table(spark, queries, mode)).collect()] if mode != "exact" else []  # of MOST_QUERIES queries at most
    exact = [(i, 0, "exact", q.replace('"', "").strip() or q) for i, q in enumerate(queries)] if mode in ("auto", "exact") else []
    profiles = profile(sections)
    plans = search_plan(diagnose(profiles, queries, mode), mode)
    hits = recall(sections, exact + steps).withColumn("bucket", bucket(F.coalesce("topic", F.lit("")), F.col("path"), F.col("title"), F.col("item")))
    found = admitted(hits, plans, mode)
    words = sorted({w for *_, x in exact + steps for w in C.ascii_tokens(x)})
    scores = search.term_scores(sections, words)
    found = found.join(scores, ["doc_id", "section"], "left")
    index = {w: i for i, w in enumerate(words)}
    of = F.create_map(*[F.lit(x) for pair in index.items() for x in pair]) if index else F.create_map()
    score = F.aggregate(F.transform(C.tokens(F.col("text")), lambda w: F.coalesce(F.get("scores", F.element_at(of, w)), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b) if index else F.lit(0.0)
    in_title = ~F.contains("__body", F.col("lower"))
    context = C.centred(F.when(in_title, F.concat_ws(" ", "title", "content")).otherwise(F.col("content")), F.col("text"), CONTEXT_CHARS)
    single = len(queries) == 1
    found = found.withColumns({"priority": priority(F.col("strategy")), "score": F.round(score, 6), "context": context})
    found = found.withColumns({
        "alignment": F.when(F.lit(single) & (F.col("intent") != "general"), F.col("aligned").cast("int")).otherwise(0),
        "noise": noise(F.col("context"), F.col("intent")) if single else F.lit(0.0),
        "proximity": proximity(F.col("context"), F.col("text")),
    })
    keep = ["doc_id", "section", "title", "item", "topic", "query_no", "step", "strategy", "text", "opened", "priority", "alignment", "noise", "score", "proximity", "context"]
    return dedup.keep_best(found.select(*keep), ["doc_id", "section", "title", "context"], [F.asc("priority"), F.asc("query_no"), F.asc("step")])


def search_documents(sections: DataFrame, queries: list[str | None], mode: str | None = None, within: Column | None = None, display_budget: int | None = None) -> DataFrame:
    """The matches of one call in every document: doc_id, rank, section, title, item, topic, matched_query, strategy,
    is_exact_phrase, matched_text, context, score, opened.

    ``within`` keeps the search to some sections. A null content or title holds nothing; blank queries and repeats are
    dropped; no sections give no rows.
    """
    asked, mode = resolve(queries, mode)
    entries = entries_of(sections if within is None else sections.where(within), asked, mode)
    kept = search.capped(ranked(entries, ["doc_id"]), ["doc_id"], [F.asc("rank")], display_budget)
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("strategy") != "exact", "rank"))
    return kept.withColumn("rank", again).select("doc_id", "rank", "section", "title", "item", "topic", F.col("text").alias("matched_query"), "strategy", (F.col("strategy") == "exact").alias("is_exact_phrase"), C.centred(F.col("context"), F.col("text"), MATCHED_CHARS).alias("matched_text"), "context", "score", "opened", "query_no")


def summary(matches: DataFrame) -> DataFrame:
    """(doc_id, exact_phrase_matches, expansion_matches, primary_source, hint, next_section) of each document's matches."""
    sections = matches.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.count_if("is_exact_phrase").alias("x"), F.min("rank").alias("first"))
    following = sections.groupBy("doc_id").agg(F.min_by("section", F.struct(-F.col("n"), -F.col("x"), F.col("first"))).alias("next_section"))
    counts = matches.groupBy("doc_id").agg(F.count_if("is_exact_phrase").alias("exact_phrase_matches"), F.count_if(~F.col("is_exact_phrase")).alias("expansion_matches"))
    exact, other = F.col("exact_phrase_matches") > 0, F.col("expansion_matches") > 0
    source = F.when(exact & other, "mixed").when(exact, "exact").when(other, "expansion_only").otherwise("none")
    hint = F.when(F.col("exact_phrase_matches") + F.col("expansion_matches") > TOO_MANY, "narrow").when(source == "expansion_only", "read_top").when(source == "mixed", "read_exact")
    return counts.join(following, "doc_id").withColumns({"primary_source": source, "hint": hint})


def no_result_hint(queries: list[str], n_matches: Column) -> Column:
    """Queries in Chinese that match nothing call for another language."""
    return F.when((n_matches == 0) & F.lit(any("一" <= c <= "鿿" for q in queries for c in q)), "try_english")
