"""Sections of quarterly and foreign annual filings, from the parts and items that their lines head.

What heads a line goes into one array for each document, after a single exchange; a task folds over a document's marks,
so that tables of contents, running headers and guides are told apart by what follows. Each token's places are sorted
and searched by halving, so that a document with many anchors doesn't have its items read again for each of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import collapsed
from tabulon.operators.sectioning import CONTENTS_RUN, CONTENTS_SPAN

# Items of both parts of a quarterly report, and of a foreign annual one.
PART_ONE, PART_TWO = ("1", "2", "3", "4"), ("1", "1A", "2", "3", "4", "5", "6")
FOREIGN = tuple("1 2 3 4 4A 5 6 7 8 9 10 11 12 13 14 15 16 16A 16B 16C 16D 16E 16F 16G 16H 16I 16J 16K 17 18 19".split())
FOREIGN_KEY = ("3", "4", "5", "18")
# Least characters of a section that is no entry of a list, how many an anchor needs; parts this close are both in the contents.
LEAST_SPAN, LEAST_SECTIONS, CONTENTS_SPREAD = 1000, 2, 5000
LEAST_AFTER_CONTENTS, LEAST_MARKERS, LEAST_FOREIGN = 2, 3, 4
PART_ONE_HEADING = r"(?i)\bpart\s+i\b[\s.\-—–:]*f\s*i\s*n\s*a\s*n\s*c\s*i\s*a\s*l\s+i\s*n\s*f\s*o\s*r\s*m\s*a\s*t\s*i\s*o\s*n"
PART_TWO_HEADING = r"(?i)\bpart\s+ii\b[\s.\-—–:]*o\s*t\s*h\s*e\s*r\s+i\s*n\s*f\s*o\s*r\s*m\s*a\s*t\s*i\s*o\s*n"
QUARTERLY_ITEM = r"(?i)\bitem\s+(1A|[1-6])(?:\s*[.:\-–—]|\s+(?=[A-Za-z]))"
BARE_ITEM = r"(?i)^\s*(1A|[1-6])\s*(?:[.:\-–—]\s*|\s+)(?=(?:financial statements|management(?:\s*['’‘`´]\s*)?s?\s+discussion|quantitative and qualitative disclosures|controls and procedures|legal proceedings|risk factors|unregistered sales|defaults|mine safety|exhibits)\b)"
FOREIGN_ITEM = r"(?i)^\s*item\s+(16[A-K]|4A|1[0-9]|[1-9])\s*(?:[.:\-–—]|\s(?=[A-Za-z]))"
SIGNATURE = r"(?i)^\s*signatures?\s*$"
GUIDE_ROW = r"(?i)^\s*(?:item\s+)?(16[A-K]|4A|1[0-9]|[1-9])\b[^|]*\|\s*[\"“']?([A-Za-z][^|\"”]{3,120}?)[\"”']?\s*[,;:]?\s*(?:\(?pages?\s.*|\d{1,4}(?:\s*[-–,]\s*\d{1,4})*)?\s*$"

Marks = list[tuple[int, str]]


def documents(lines: DataFrame, **marks: Column) -> DataFrame:
    """``lines(doc_id, at, line)`` -> (doc_id, size, and for each mark two arrays, ``<mark>_at`` and ``<mark>``, of its
    lines' places in order and of their tokens)."""
    read = lines.select("doc_id", "at", (F.col("at") + F.length("line")).alias("end"), *[token.alias(name) for name, token in marks.items()])
    found = [F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("at", name)))).alias(name) for name in marks]
    found = read.groupBy("doc_id").agg(F.max("end").alias("size"), *found)
    return found.select("doc_id", "size", *[c for name in marks for c in (F.col(f"{name}.at").alias(f"{name}_at"), F.col(f"{name}.{name}").alias(name))])


def headed(pattern: str, group: int = 1) -> Column:
    """The upper-case group of a pattern in a line, null where it isn't found."""
    return F.nullif(F.upper(F.regexp_extract("line", pattern, group)), F.lit(""))


class Items:
    """A document's items in the order of their places."""

    def __init__(self, at: list[int], tokens: list[str]):
        self.at, self.tokens = at, tokens
        self.places: dict[str, list[int]] = {}
        for a, token in zip(at, tokens):
            self.places.setdefault(token, []).append(a)

    def picked(self, order: tuple[str, ...], start: int, end: int | None) -> Marks:
        """Of each token in order the first mark behind the one picked before, from ``start`` on and before ``end`` (None:
        to the last); tokens without one are left out."""
        out: Marks = []
        for token in order:
            places = self.places.get(token, [])
            k = bisect_left(places, start)
            if k < len(places) and (end is None or places[k] < end):
                out.append((places[k], token))
                start = places[k] + 1
        return out

    def behind_contents(self) -> int:
        """Where the contents end: at the last of a run of marks from the first on, each close to the next; 0 without such a
        run. The last one stays in play if tokens begin again with it."""
        stop = next((k for k in range(len(self.at)) if k + 1 == len(self.at) or self.at[k + 1] - self.at[k] >= CONTENTS_SPAN), -1)
        if stop < CONTENTS_RUN:
            return 0
        return self.at[stop] + (0 if self.tokens[stop] in self.tokens[:stop] else 1)


def full_sections(picks: Marks, end: int) -> int:
    """How many of the picks are LEAST_SPAN characters or more before the next one, the last before ``end``."""
    return sum(b - a >= LEAST_SPAN for (a, _), b in zip(picks, [*[a for a, _ in picks[1:]], end]))


def quarterly_sections(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, at, line)`` of quarterly reports -> ``(doc_id, title, start, end)``.

    Part II is where its heading stands last. Part I is the last of its headings before that from which items follow, two
    of them LEAST_SPAN characters or longer: so neither the contents nor a running header is taken. Its items lie between
    the two; without such a heading they are looked for behind the contents. Part II's items follow the last of Part I.
    A document with fewer than three markers has no section; after the last one ``SIGNATURE`` is a section too. Null
    lines have no heading.
    """
    item = F.coalesce(headed(QUARTERLY_ITEM), headed(BARE_ITEM))
    found = documents(lines, one=F.when(F.col("line").rlike(PART_ONE_HEADING), F.lit("I")), two=F.when(F.col("line").rlike(PART_TWO_HEADING), F.lit("II")), items=item, signs=F.when(F.col("line").rlike(SIGNATURE), F.lit("SIGNATURE")))
    return sections(found.select("doc_id", "size", "signs_at", "one_at", "two_at", "items_at", "items"), quarterly_marks)


def quarterly_marks(size: int | None, one: list[int], two: list[int], at: list[int], tokens: list[str]) -> Marks:
    """(start, title) of a document's items."""
    items = Items(at, tokens)
    second = two[-1] if two else None
    part: Marks = []
    for anchor in reversed(one[: bisect_left(one, second)] if two else one):
        trial = items.picked(PART_ONE, anchor, second)
        if trial and full_sections(trial, size if second is None else second) >= LEAST_SECTIONS:
            part = trial
            break
    else:
        close = one and two and second - one[0] < CONTENTS_SPREAD
        loose = items.picked(PART_ONE, items.behind_contents(), None if close else second)
        part = loose if len(loose) >= LEAST_AFTER_CONTENTS else []
    begin = part[-1][0] + 1 if part else items.behind_contents() if second is None else second
    return [*[(a, f"Part I - Item {t}") for a, t in part], *[(a, f"Part II - Item {t}") for a, t in items.picked(PART_TWO, begin, None)]]


def sections(found: DataFrame, marks: Callable[..., Marks]) -> DataFrame:
    """(doc_id, title, start, end) of the marks that ``marks`` makes of a document's size and what follows its signatures
    in ``found(doc_id, size, signs_at, ...)``, with the first signature behind the last one; LEAST_MARKERS of them at least."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, titles, starts, ends = [], [], [], []
            for k, (size, signs, *own) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                every = marks(size, *own)
                if len(every) < LEAST_MARKERS:
                    continue
                last = max(a for a, _ in every)
                every = sorted([*every, *[(s, "SIGNATURE") for s in signs if s > last][:1]])
                row += [k] * len(every)
                titles += [t for _, t in every]
                starts += [a for a, _ in every]
                ends += [*[a for a, _ in every[1:]], size]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(titles, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "title", "start", "end"])

    return found.mapInArrow(fold, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, title string, start long, end long")


def foreign_sections(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, at, line)`` of foreign annual reports -> ``(doc_id, title, start, end)``.

    Items in order behind the contents. Where fewer than four are found, or a key item is missing, a cross-reference guide
    repairs them: each of its rows, ``Item | heading, pages``, names the heading under which the document has the item, and
    the first later line that begins with that heading, outside the guide, is where it starts. What the guide finds counts
    if it is four items or more, not all within LEAST_SPAN of each other, and, with the items found by number where it has
    none, has every key item; else the numbered ones stay. Fewer than three give no section.
    """
    row = lambda group: F.when(F.contains("line", F.lit("|")), F.regexp_extract("line", GUIDE_ROW, group)).otherwise("")
    guide = lines.where(row(2) != "").select("doc_id", F.upper(row(1)).alias("token"), F.lower(collapsed(row(2))).alias("heading"), F.col("at").alias("listed"))
    guide = guide.groupBy("doc_id", "token").agg(F.min_by("heading", "listed").alias("heading"), F.min("listed").alias("listed"))
    # A document's guide has one heading for each token, so a line is compared with a bounded number of them; headings of up
    # to three words are met as whole words.
    short = F.size(F.split("heading", " ")) <= 3
    guide = guide.withColumn("heading", F.concat("heading", F.when(short, " ").otherwise("")))
    guide = guide.groupBy("doc_id").agg(F.max("listed").alias("guide_end"), F.collect_list(F.struct("token", "heading")).alias("guide"))
    read = lines.join(guide, "doc_id", "left").withColumn("plain", row(2) == "")
    read = read.withColumn("said", F.when(F.col("plain") & (F.col("at") > F.col("guide_end")), F.concat(F.lower(collapsed("line")), F.lit(" "))))
    begun = F.transform(F.filter("guide", lambda g: F.startswith(F.col("said"), g["heading"])), lambda g: g["token"])
    found = documents(read, items=F.when(F.col("plain"), headed(FOREIGN_ITEM)), signs=F.when(F.col("line").rlike(SIGNATURE), F.lit("SIGNATURE")), met=F.when(F.col("said").isNotNull(), F.nullif(F.array_join(begun, " "), F.lit(""))))
    return sections(found.select("doc_id", "size", "signs_at", "items_at", "items", "met_at", "met"), foreign_marks)


def foreign_marks(size: int | None, at: list[int], tokens: list[str], met_at: list[int], met: list[str]) -> Marks:
    """(start, title) of a document's items; ``met``: the tokens, parted by spaces, whose headings lines begin with."""
    items = Items(at, tokens)
    numbered = items.picked(FOREIGN, items.behind_contents(), None)
    first: dict[str, int] = {}
    for a, begun in zip(met_at, met):
        for token in begun.split(" "):
            first.setdefault(token, a)
    guided = [(a, token) for token, a in first.items()]
    merged = guided + [(a, token) for a, token in numbered if token not in first]
    covers = lambda picks: {token for _, token in picks}.issuperset(FOREIGN_KEY)
    kept = numbered
    broken = len(numbered) < LEAST_FOREIGN or not covers(numbered)
    if broken and len(guided) >= LEAST_FOREIGN and max(first.values()) - min(first.values()) >= LEAST_SPAN and covers(merged):
        kept = guided if covers(guided) else merged
    return [(a, f"Item {token}") for a, token in kept]
