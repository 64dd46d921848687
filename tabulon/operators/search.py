"""Ranked full-text search over document sections, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C

#: Field weights, length normalisation, saturation, and the cap on expansion hits.
WEIGHTS = {"title": 3.0, "item": 2.0, "topic": 2.0, "path": 2.0, "preview": 1.0, "content": 1.0}
LENGTH_B = {"title": 0.35, "item": 0.2, "topic": 0.2, "path": 0.2, "preview": 0.35, "content": 0.75}
K1 = 1.2
PRIORITY = {"exact": 0, "phrase_variant": 1, "synonym": 2, "token": 3}
CAP_FROM, CAP_SHARE, CAP_LEAST = 8, 0.3, 2


def sections(docs: DataFrame) -> DataFrame:
    """One row per line of a document, with its fields: (doc_id, section, title, item, topic, path, preview, content)."""
    lines = docs.select("doc_id", F.col("lang").alias("item"), F.col("source").alias("topic"), F.substring("text", 1, 40).alias("title"), F.posexplode(F.split("text", "\n")).alias("section", "content"))
    return lines.select("doc_id", "section", "title", "item", "topic", F.concat_ws(" ", "item", "topic").alias("path"), F.substring("content", 1, 200).alias("preview"), "content")


def profiled(found: DataFrame) -> DataFrame:
    """Sections with the tokens of every field, and of the profile, which is all fields but the content."""
    with_tokens = found.withColumns({f"t_{f}": C.tokens(F.coalesce(f, F.lit(""))) for f in WEIGHTS})
    return with_tokens.withColumn("profile", F.array_distinct(F.concat(*[f"t_{f}" for f in WEIGHTS if f != "content"])))


def term_scores(found: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, section, scores): for each section that holds a term the score of every term, within its document.

    A section is brought down to the numbers of its words and to those words that are terms, before anything is shuffled.
    Lengths and document frequencies are one aggregate per document, combined before the shuffle. Terms are an array that
    functions go over: a column for each outgrows what the JVM compiles, and the row is then interpreted.
    """
    fields = list(WEIGHTS)
    profile = [f for f in fields if f != "content"]
    cells = found.select("doc_id", "section", *[C.tokens(F.coalesce(f, F.lit(""))).alias(f) for f in fields])
    own = lambda f: F.filter(f, lambda w: w.isin(*terms) if terms else F.lit(False))
    # The content is apart, so that the aggregate doesn't take it into words.
    numbers = cells.select("doc_id", "section", F.array(*[F.size(f) for f in profile]).alias("n_words"), F.array(*[own(f) for f in profile]).alias("own"), F.size("content").alias("n_content"), own("content").alias("own_content"))
    averages = F.array(*[F.avg(F.get("n_words", F.lit(k))) for k in range(len(profile))]).alias("averages")
    df = F.array(*[F.count_if(F.array_contains("held", x)) for x in terms]).alias("df") if terms else F.array().cast("array<bigint>").alias("df")
    stats = numbers.withColumn("held", F.array_distinct(F.flatten("own"))).groupBy("doc_id").agg(F.count("*").alias("n"), averages, df)

    def length(f: str) -> Column:
        """What a field's counts are divided by for its length."""
        average, b = F.get("averages", F.lit(profile.index("preview" if f == "content" else f))), LENGTH_B[f]
        words = F.col("n_content") if f == "content" else F.get("n_words", F.lit(profile.index(f)))
        return F.when(average > 0, 1 - b + b * words / average).otherwise(F.lit(1.0))

    def score(x: Column, i: Column) -> Column:
        weighted: Column = F.lit(0.0)
        for k, (f, w) in enumerate(WEIGHTS.items()):
            texts = F.col("own_content") if f == "content" else F.get("own", F.lit(profile.index(f)))
            weighted = weighted + w * (F.size(F.filter(texts, lambda y: y == x)) / F.get("lengths", F.lit(k)))
        df = F.get("df", i)
        idf = F.when(df > 0, F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))).otherwise(0.0)
        return C.let(F.struct(idf.alias("idf"), weighted.alias("w")), lambda s: s["idf"] * (K1 + 1) * s["w"] / (K1 + s["w"]))

    holding = numbers.where((F.size("own_content") > 0) | F.exists("own", lambda o: F.size(o) > 0)).join(stats, "doc_id")
    rated = F.transform(F.array(*map(F.lit, terms)), score) if terms else F.array().cast("array<double>")
    return holding.withColumn("lengths", F.array(*map(length, fields))).select("doc_id", "section", rated.alias("scores"))


def bm25f(found: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, section, score) of every section that holds a term. A repeated term counts as often as it is given."""
    distinct = sorted(set(terms))
    total = sum((F.get("scores", F.lit(i)) * terms.count(x) for i, x in enumerate(distinct)), F.lit(0.0))
    return term_scores(found, distinct).select("doc_id", "section", F.round(total, 6).alias("score"))


def ambiguity(generic: Column, n_tokens: Column, mean_df: Column) -> Column:
    """How little a query says: the share of generic words, their document frequency, and whether it is short."""
    score = F.round((generic / n_tokens + mean_df + F.when(n_tokens <= 2, 1.0).otherwise(0.0)) / 3, 4)
    return F.when(n_tokens == 0, 0.0).otherwise(score)


def capped(hits: DataFrame, scope: list[str], order: list[Column], display_budget: int | None = None) -> DataFrame:
    """All exact hits, then expansions up to a share of all hits, once there are many hits and an exact one among them.
    Where the exact hits fit the ``display_budget``, expansions get no more than what it leaves, but two at least."""
    counted = Window.partitionBy(*scope)
    exact = F.col("strategy") == "exact"
    ranked = hits.withColumns({"n": F.count("*").over(counted), "n_exact": F.count_if(exact).over(counted), "__rank": F.row_number().over(Window.partitionBy(*scope, exact).orderBy(*order))})
    most = F.greatest(F.lit(CAP_LEAST), F.floor(F.col("n") * CAP_SHARE))
    if display_budget:
        most = F.when(F.col("n_exact") <= display_budget, F.least(most, F.greatest(F.lit(CAP_LEAST), display_budget - F.col("n_exact")))).otherwise(most)
    free = (F.col("n") < CAP_FROM) | (F.col("n_exact") == 0) | exact
    return ranked.where(free | (F.col("__rank") <= most)).drop("n", "n_exact", "__rank")


def sentences(text: Column) -> Column:
    """Pieces between full-width stops and question, exclamation and semicolon marks; the ASCII full stop doesn't split."""
    return F.filter(F.split(C.collapsed(text), "[。！？!?；;]"), lambda x: F.trim(x) != "")


def distinct_snippets(snippets: Column, most: int = 2) -> Column:
    """Without snippets that equal or lie within another: the first kept one that a snippet equals, lies within or holds
    decides, and in the last case gives its place to it. Blank ones go."""
    pair = "struct<text:string,norm:string>"
    named = F.filter(F.transform(snippets, lambda x: F.struct(C.collapsed(x).alias("text"), C.comparable(x).alias("norm"))), lambda s: s["norm"] != "")

    def step(kept: Column, x: Column) -> Column:
        alike = lambda k: F.contains(x["norm"], k["norm"]) | F.contains(k["norm"], x["norm"])
        place = F.array_position(F.transform(kept, alike), True).cast("int")
        swapped = F.concat(F.slice(kept, 1, place - 1), F.array(x), F.slice(kept, place + 1, F.size(kept)))
        inside = F.contains(F.get(kept, place - 1)["norm"], x["norm"])
        return F.when(place == 0, F.concat(kept, F.array(x))).when(inside, kept).otherwise(swapped)

    return F.slice(F.aggregate(named, F.array().cast(f"array<{pair}>"), step)["text"], 1, most)


def densest(lines: DataFrame, keys: list[str], text: str, terms: list[str], width: int) -> DataFrame:
    """(keys, start, n_terms): of each text, where the most distinct terms begin within ``width`` characters."""
    words = lines.select(*keys, F.posexplode(F.split(text, " ")).alias("i", "word"))
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("start", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("long"))
    hits = placed.where(F.lower("word").isin(terms)).withColumn("term", F.lower("word"))
    ahead = Window.partitionBy(*keys).orderBy("start").rangeBetween(0, width)
    counted = hits.withColumn("n_terms", F.size(F.collect_set("term").over(ahead)))
    best = Window.partitionBy(*keys).orderBy(F.desc("n_terms"), "start")
    return counted.withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, "start", "n_terms")
