"""License scans: an exact containment join of text blocks with license templates, with DataFrame functions alone.

A block is any run of WINDOW times a template's words within a paragraph (or the whole of a shorter paragraph), whether
its lines are wrapped or one very long. A template is found in a block if the block holds at least ``threshold`` of the
template's distinct words, and all of the words that tell its licence from others. A line that is no longer than that is
compared as a set of words; what is longer or wrapped, around its rare words.
Template words are ordered by how many texts of the whole table hold them, rarest first.
A block that shares the needed number of words shares one of the rarest of either side (prefix filter), has enough
template words at all (length filter), and has enough of them left from the shared word on (positional filter); what
passes is verified on the whole sets.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import content_key, stored, work_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Between paragraphs: at least one line without a word.
BLANK = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
#: Words of a block across lines, as a multiple of the template's.
WINDOW = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening sentences of common licences, the labels of blocks that contain them, and the words without which a block
#: may be of another licence.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license", "gnu"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null as an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def places(found: Column, phrase: str) -> Column:
    """Indexes in the word array where the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def at(word: Column, i: Column) -> Column:
        hit = word == parts[0]
        for k, other in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(found, i + k) == other, F.lit(False))
        return F.when(hit, i.cast("long"))

    return F.filter(F.transform(found, at), lambda i: i.isNotNull())


def needed(template: tuple[str, ...], threshold: float) -> int:
    return math.ceil(threshold * len(template) - 1e-9)


@dataclass(frozen=True)
class Side:
    """A template's distinct words, how many of them a block needs, the most words of a block, and the telling words."""

    label: str
    words: tuple[str, ...]
    need: int
    window: int
    telling: tuple[str, ...]


def sides(templates, threshold: float) -> list[Side]:
    sets = [(label, tuple(sorted(set(text.split()))), WINDOW * len(text.split()), tuple(telling.split())) for label, text, telling in templates]
    return [Side(label, own, needed(own, threshold), window, telling) for label, own, window, telling in sets]


def scanned(docs: DataFrame, phrases: dict[str, str], templates: list[Side]) -> DataFrame:
    """The one reading of all texts: (doc_id, n_words, hits, held, lower, content), written to the shared folder.

    hits: array<struct<label, place>> of the phrases; held: the distinct template words; lower: the text, only where it
    holds enough words of some template, and content its key.
    """
    vocabulary = F.array(*map(F.lit, sorted({w for s in templates for w in s.words} | {w for p in phrases for w in p.split(" ")})))
    rows = docs.select("doc_id", lowered(F.col("text")).alias("lower"))
    rows = rows.select("doc_id", "lower", words(F.col("lower")).alias("words"))
    rows = rows.select("doc_id", "lower", "words", F.array_intersect("words", vocabulary).alias("held"))
    none = F.array().cast("array<struct<label:string,place:bigint>>")
    labelled = lambda at, label: F.transform(at, lambda x: F.struct(F.lit(label).alias("label"), x.alias("place")))
    has = lambda own: functools.reduce(operator.and_, [F.array_contains("held", w) for w in own])
    hits = [F.when(has(p.split(" ")), labelled(places(F.col("words"), p), label)).otherwise(none) for p, label in phrases.items()]
    enough = [F.size(F.array_intersect("held", F.array(*map(F.lit, s.words)))) >= s.need for s in templates]
    may = (F.size("held") >= min(s.need for s in templates)) & functools.reduce(operator.or_, enough)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*hits).alias("hits"), "held", F.when(may, F.col("lower")).alias("lower"))
    rows = rows.withColumn("content", F.when(F.col("lower").isNotNull(), content_key("lower")))
    return stored(rows, work_dir(docs.sparkSession, "licenses"))


def lines(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(content, n, held): a row for each line that holds a template word; n: its words; held: the distinct ones."""
    each = texts.select("content", F.explode(F.split("lower", "\n")).alias("line"))
    each = each.select("content", words(F.col("line")).alias("words"))
    return each.select("content", F.size("words").alias("n"), F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("held")).where(F.size("held") > 0)


def passages(texts: DataFrame, rare: Column, short: int, reach: int) -> DataFrame:
    """(content, word, at, near): each rare word in a paragraph of several lines or over ``short`` words, and the words
    around it.

    near: the word with up to ``reach`` - 1 words before and after it; at: its index there. A line without a word ends a paragraph.
    """
    each = texts.select("content", F.explode(F.split("lower", BLANK)).alias("part"))
    each = each.select("content", words(F.col("part")).alias("words"), F.contains("part", F.lit("\n")).alias("wrapped"))
    each = each.where(F.col("wrapped") | (F.size("words") > short))
    begin = lambda i: F.greatest(i - (reach - 1), F.lit(0))
    spot = lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("word"), (i - begin(i)).alias("at"), F.slice("words", begin(i) + 1, i - begin(i) + reach).alias("near")))
    return each.select("content", F.explode(F.filter(F.transform("words", spot), lambda s: s.isNotNull())).alias("s")).select("content", "s.*")


def joined_blocks(found: DataFrame, templates: list[Side]) -> DataFrame:
    """(content, label, containment) of the texts that ``scanned`` left: the best containment of each label that a
    text's blocks meet. Equal texts are joined once."""
    spark = found.sparkSession
    vocabulary = sorted({w for s in templates for w in s.words})
    # A row for each template word: its size is that of the templates, whatever the corpus.
    counts = {r["word"]: r["n"] for r in found.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes = []
    for s in templates:
        mine = sorted(s.words, key=order.get)
        prefixes += [(s.label, mine, s.need, s.window, s.telling, w, i) for i, w in enumerate(mine[: len(mine) - s.need + 1])]
    listed = lambda own: f"CAST(array({', '.join(map(repr, own))}) AS array<string>)"
    values = ", ".join(f"('{label}', {listed(mine)}, {need}, {window}, {listed(telling)}, '{w}', {i})" for label, mine, need, window, telling, w, i in prefixes)
    side = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(label, template, need, window, telling, word, first)"))
    rare = F.array(*map(F.lit, sorted({p[5] for p in prefixes})))
    tells = lambda held: F.size(F.array_except("telling", held)) == 0
    total = F.size("template")
    texts = found.where("lower IS NOT NULL").select("content", "lower").dropDuplicates(["content"])

    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    sorted_held = F.transform(F.array_sort(F.transform("held", lambda w: F.struct(F.element_at(ranks, w), w.alias("w")))), lambda s: s["w"])
    each = lines(texts, vocabulary).where((F.size("held") >= min(s.need for s in templates)) & F.arrays_overlap("held", rare))
    joined = each.select("content", "n", sorted_held.alias("held")).select("content", "n", "held", F.posexplode("held").alias("pos", "word")).join(side, "word")
    size = F.size("held")
    joined = joined.where((F.col("n") <= F.col("window")) & tells(F.col("held")))
    joined = joined.where((size >= F.col("need")) & (F.col("pos") <= size - F.col("need")) & (1 + F.least(total - F.col("first") - 1, size - F.col("pos") - 1) >= F.col("need")))
    within = joined.select("content", "label", "need", total.alias("total"), F.size(F.array_intersect("held", "template")).alias("shared"))

    near = passages(texts, rare, min(s.window for s in templates), max(s.window for s in templates)).join(side, "word")
    near = near.where((F.size(F.array_intersect("near", "template")) >= F.col("need")) & tells(F.col("near")))
    starts = F.sequence(F.greatest(F.col("at") - F.col("window") + 1, F.lit(0)), F.col("at"))
    block = lambda s: F.slice("near", s + 1, F.col("window"))
    shared = F.array_max(F.transform(starts, lambda s: F.when(tells(block(s)), F.size(F.array_intersect(block(s), "template"))).otherwise(0)))
    across = near.select("content", "label", "need", total.alias("total"), shared.alias("shared"))
    verified = within.union(across).where("shared >= need").select("content", "label", (F.col("shared") / F.col("total")).alias("containment"))
    return verified.groupBy("content", "label").agg(F.max("containment").alias("containment"))


def template_hits(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, label, containment): the best containment of each label that a document's blocks meet."""
    own = sides(templates, threshold)
    found = scanned(docs, PHRASES, own)
    return found.where("lower IS NOT NULL").select("doc_id", "content").join(joined_blocks(found, own), "content").drop("content")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of ``docs``.

    A null text is an empty one: no words, no labels (empty strings), null first and last word, score 0. Rows repeated
    get the same answer, and so do equal texts whatever their doc_id, a null one too. An empty table gives no rows;
    other columns, whatever their names, are ignored. Score: 1 with a phrase, else the best containment of a template.
    """
    own = sides(templates, threshold)
    found = scanned(docs, phrases, own)
    mine = joined_blocks(found, own).groupBy("content").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    base = found.select("doc_id", "n_words", "hits", "content")
    no_match = base.where("content IS NULL").withColumns({"more": F.lit(None).cast("array<string>"), "containment": F.lit(None).cast("double")})
    both = base.where("content IS NOT NULL").join(mine, "content", "left").select(no_match.columns).unionByName(no_match)
    labels, at = F.transform("hits", lambda h: h["label"]), F.transform("hits", lambda h: h["place"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return both.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
