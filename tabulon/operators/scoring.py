"""Quality scores of processed filings: six dimensions of 110 points, hard gates, grades, and the gate of a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.functions.forms import lookup


@dataclass(frozen=True)
class Profile:
    """What is expected of a form's sections."""

    order: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    lengths: tuple[tuple[str, int, int], ...] = ()  # item, least characters, points
    may_refer: tuple[str, ...] = ()  # items that may only refer elsewhere
    may_be_short: tuple[str, ...] = ()
    hard: tuple[str, ...] = ()
    sections: tuple[int, int] = (0, 1 << 30)
    topics: bool = False
    statements: bool = True
    keywords: tuple[tuple[str, tuple[str, ...]], ...] = ()  # of forms without items: what names a section, first match wins


def items(*numbers: str) -> tuple[str, ...]:
    return tuple(f"Item {n}" for n in numbers)


# The profile of each form.
PROFILES = {
    "10-K": Profile(
        order=items("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16"),
        required=items("1", "1A", "7", "7A", "8", "15"),
        lengths=(("Item 1A", 5000, 8), ("Item 7", 5000, 8), ("Item 8", 10000, 10), ("Item 7A", 500, 4)),
        may_refer=items("8"),
        may_be_short=items("1B", "1C", "3", "4", "5", "6", "9", "9C"),
        hard=items("1A", "7", "8"),
        sections=(15, 35),
        topics=True,
    ),
    "10-Q": Profile(
        order=("Part I - Item 1", "Part I - Item 2", "Part I - Item 3", "Part I - Item 4", "Part II - Item 1", "Part II - Item 1A", "Part II - Item 2", "Part II - Item 3", "Part II - Item 4", "Part II - Item 5", "Part II - Item 6"),
        required=("Part I - Item 1", "Part I - Item 2", "Part II - Item 1A"),
        lengths=(("Part I - Item 1", 5000, 10), ("Part I - Item 2", 3000, 12), ("Part II - Item 1A", 2000, 8)),
        may_refer=("Part II - Item 1A",),
        hard=("Part I - Item 1", "Part I - Item 2"),
        sections=(8, 20),
        topics=True,
    ),
    "20-F": Profile(
        order=items("1", "2", "3", "4", "4A", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "16A", "16B", "16C", "16D", "16E", "16F", "16G", "16H", "16I", "16J", "17", "18", "19"),
        required=items("3", "4", "5", "8", "11", "18"),
        lengths=(("Item 3", 5000, 8), ("Item 5", 5000, 8), ("Item 18", 10000, 10), ("Item 11", 500, 4)),
        may_refer=items("18"),
        hard=items("3", "5", "18"),
        sections=(20, 300),
        topics=True,
    ),
    "8-K": Profile(
        order=items("1.01", "1.02", "1.03", "1.04", "1.05", "2.01", "2.02", "2.03", "2.04", "2.05", "2.06", "3.01", "3.02", "3.03", "4.01", "4.02", "5.01", "5.02", "5.03", "5.04", "5.05", "5.06", "5.07", "5.08", "6.01", "6.02", "6.03", "6.04", "6.05", "6.06", "7.01", "8.01", "9.01"),
        sections=(2, 8),
        statements=False,
    ),
    "6-K": Profile(
        lengths=(("Financial Results", 300, 20), ("Safe Harbor", 100, 10)),
        sections=(3, 15),
        statements=False,
        keywords=(("Financial Results", ("financial results", "key highlights", "results of operations", "financial and business")), ("Safe Harbor", ("safe harbor", "forward-looking"))),
    ),
    "DEF 14A": Profile(
        lengths=(("Executive Compensation", 2000, 12), ("Directors", 500, 10), ("Security Ownership", 300, 8)),
        sections=(8, 25),
        statements=False,
        keywords=(("Executive Compensation", ("executive compensation", "compensation discussion")), ("Directors", ("election of director", "directors")), ("Security Ownership", ("security ownership", "beneficial ownership"))),
    ),
    "SC 13G": Profile(order=items(*map(str, range(1, 11))), required=items("2", "4"), lengths=(("Item 2", 50, 15), ("Item 4", 50, 15)), sections=(5, 12), statements=False),
}
# Rates of found queries that give 5, 7 and 9 points, by the kind of form.
COVERAGE = {"annual": (0.55, 0.7, 0.85), "event": (0.25, 0.4, 0.55), "governance": (0.5, 0.65, 0.8), "ownership": (0.65, 0.8, 0.9)}
# Grades, the batch's gates, and the lengths of too large sections.
PASS, WARN, BATCH_AVERAGE, BATCH_P10, HUGE_WARN, HUGE_FAIL = 93.0, 83.0, 93.0, 86.0, 200_000, 350_000
FINANCIAL_COVERAGE = {"10-K": 0.99, "10-Q": 0.99, "20-F": 0.99, "6-K": 0.9}
STATEMENTS = ("income", "balance_sheet", "cash_flow", "equity", "comprehensive_income")
# Broken characters, and last words of a text that was cut off.
MOJIBAKE = r"Ã.|Â.|â€.|ï¿½|\x{FFFD}|[\x{80}-\x{9F}]"
CUT_OFF = r"(?i)(?:^|\s)(?:to|and|or|the|of|in|for|with|by|that|at|from|as|a|an|refer|see|including|such|under|pursuant|per|into|upon)\s*$"


def per_form(pick, form: Column) -> Column:
    """What ``pick`` takes of the form's profile; null for a form without one."""
    out = F.lit(None)
    for name, profile in PROFILES.items():
        value = pick(profile)
        out = F.when(form == name, F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value)).otherwise(out)
    return out


def item_of(title: Column, form: Column) -> Column:
    """The item that a section's title names, in the way in which its form numbers items; null for none. Forms without
    items name their sections by words of the title."""
    part = F.concat(F.lit("Part "), F.upper(F.regexp_extract(title, r"(?i)Part\s+(I{1,4})\s*[-–—]\s*Item\s+\d+[A-Z]?", 1)), F.lit(" - Item "), F.regexp_extract(title, r"(?i)Part\s+I{1,4}\s*[-–—]\s*Item\s+(\d+[A-Z]?)", 1))
    decimal, plain = F.regexp_extract(title, r"(?i)Item\s+(\d+\.\d+)", 1), F.regexp_extract(title, r"(?i)Item\s+(\d+[A-Z]?)", 1)
    named = lambda n: F.when(n != "", F.concat(F.lit("Item "), n))
    words = F.lit(None).cast("string")
    for name, profile in PROFILES.items():
        for label, said in reversed(profile.keywords):
            hit = F.exists(F.array(*map(F.lit, said)), lambda w: F.contains(F.lower(title), w))
            words = F.when((form == name) & hit, label).otherwise(words)
    item = F.when(form == "10-Q", F.when(title.rlike(r"(?i)Part\s+I{1,4}\s*[-–—]\s*Item\s+\d"), part)).when(form == "8-K", named(decimal)).otherwise(named(plain))
    return F.coalesce(item, words)


def bands(value: Column, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Points of the first step whose least value is reached."""
    out = F.lit(otherwise)
    for least, points in reversed(steps):
        out = F.when(value >= least, F.lit(points)).otherwise(out)
    return out


def structure(sections: DataFrame) -> DataFrame:
    """(doc_id, form, a_structure, order_ok, n_missing, n_sections) of ``sections(doc_id, form, position, title)``."""
    order = per_form(lambda p: p.order, F.col("form"))
    placed = sections.withColumn("item", item_of(F.col("title"), F.col("form"))).withColumn("at", F.array_position(order, F.col("item")))
    # Sections that aren't in the order, or have no item, say nothing about it; a null looks through them.
    known = F.when(F.col("at") > 0, F.col("at"))
    before = F.last(known, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.withColumns({"back": F.coalesce(known < before, F.lit(False)), "known": known})
    per = marked.groupBy("doc_id", "form").agg(F.bool_or("back").alias("back"), F.count("known").alias("n_known"), F.collect_set("item").alias("items"), F.count("*").alias("n_sections"))
    low, high = per_form(lambda p: p.sections[0], F.col("form")), per_form(lambda p: p.sections[1], F.col("form"))
    off = F.greatest(F.lit(0), low - F.col("n_sections"), F.col("n_sections") - high)
    per = per.withColumns({"n_missing": F.size(F.array_except(per_form(lambda p: p.required, F.col("form")), "items")), "order_ok": F.when(F.size(per_form(lambda p: p.order, F.col("form"))) > 0, ~F.col("back") & (F.col("n_known") > 0))})
    in_order = F.when(F.coalesce("order_ok", F.lit(True)), 8.0).otherwise(0.0)  # a form without an order can't be out of it
    points = in_order + F.greatest(F.lit(0.0), 10.0 - 2 * F.col("n_missing")) + F.greatest(F.lit(0.0), 7.0 - 2 * F.ceil(off / 5))
    return per.select("doc_id", "form", points.alias("a_structure"), "order_ok", "n_missing", "n_sections")


def content(sections: DataFrame) -> DataFrame:
    """(doc_id, b_content, n_hard_missing) of ``sections(doc_id, form, title, length, refers)``: items that are long
    enough, or that may refer elsewhere and do."""
    named = sections.withColumn("item", item_of(F.col("title"), F.col("form"))).where("item IS NOT NULL")
    lengths = named.groupBy("doc_id", "form", "item").agg(F.sum("length").alias("length"), F.bool_or("refers").alias("refers"))
    needs = [(form, item, least, points, item in p.may_refer) for form, p in PROFILES.items() for item, least, points in p.lengths]
    met: Column = F.lit(0.0)
    for form, item, least, points, may in needs:
        ok = (F.col("length") >= least) | (F.col("refers") if may else F.lit(False))
        met = met + F.when((F.col("form") == form) & (F.col("item") == item) & ok, float(points)).otherwise(0.0)
    hard = F.array_contains(per_form(lambda p: p.hard, F.col("form")), F.col("item"))
    per = lengths.groupBy("doc_id", "form").agg(F.sum(met).alias("met"), F.count_if(hard).alias("n_hard"))
    every = sections.select("doc_id", "form").distinct().join(per.drop("form"), "doc_id", "left")
    free = F.col("form").isin(*[form for form, p in PROFILES.items() if not p.lengths])
    missing = F.size(per_form(lambda p: p.hard, F.col("form"))) - F.coalesce("n_hard", F.lit(0))
    return every.select("doc_id", F.when(free, 30.0).otherwise(F.coalesce("met", F.lit(0.0))).alias("b_content"), missing.alias("n_hard_missing"))


def retrieval(calls: DataFrame) -> DataFrame:
    """(doc_id, c_search, coverage) of ``calls(doc_id, kind, weight, hit, good, exact)``: queries weighed, and whether
    each found something, of good quality, and by its exact words."""
    per = calls.groupBy("doc_id", "kind").agg((F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("coverage"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("good")).alias("good"), F.count_if(F.col("hit") & F.col("exact")).alias("exact"))
    covered = F.lit(0.0)
    for kind, (five, seven, nine) in COVERAGE.items():
        covered = F.when(F.col("kind") == kind, bands(F.col("coverage"), [(nine, 9.0), (seven, 7.0), (five, 5.0)])).otherwise(covered)
    points = covered + bands(C.ratio(F.col("good"), F.col("hits")), [(0.9, 4.0), (0.75, 2.0)]) + bands(C.ratio(F.col("exact"), F.col("hits")), [(0.7, 2.0), (0.5, 1.0)])
    return per.select("doc_id", points.alias("c_search"), F.round("coverage", 4).alias("coverage"))


def consistency(documents: DataFrame, tables: DataFrame, section_refs: DataFrame, read_refs: DataFrame, statements: DataFrame) -> DataFrame:
    """(doc_id, d_consistency, dangling, refs_equal, mean_rows, n_statements) for every row of ``documents(doc_id)``.

    ``tables(doc_id, table_ref, section_ref, has_caption, has_data)``, ``section_refs`` and ``read_refs(doc_id, ref)``,
    ``statements(doc_id, kind, quality, n_rows, n_periods)``.
    """
    stray = tables.where("section_ref IS NOT NULL").select("doc_id", F.col("section_ref").alias("ref")).join(section_refs, ["doc_id", "ref"], "left_anti")
    dangling = stray.groupBy("doc_id").agg(F.count("*").alias("dangling"))
    one_way = section_refs.distinct().withColumn("s", F.lit(1)).join(read_refs.distinct().withColumn("r", F.lit(1)), ["doc_id", "ref"], "full")
    unequal = one_way.where("s IS NULL OR r IS NULL").select("doc_id").distinct().withColumn("unequal", F.lit(True))
    quality = tables.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.count_if("has_data").alias("n_data"), F.count_if("has_caption").alias("n_captions"))
    usable = statements.where(F.col("quality").isin("xbrl", "extracted") | (F.col("n_rows") > 0))
    found = usable.groupBy("doc_id").agg(F.count_distinct("kind").alias("n_statements"), F.avg("n_rows").alias("mean_rows"), F.bool_and(F.col("n_periods") >= 2).alias("periods_ok"))
    per = documents.select("doc_id").distinct()
    for side in (dangling, unequal, quality, found):
        per = per.join(side, "doc_id", "left")
    n = F.coalesce("n_tables", F.lit(0))
    d3 = F.greatest(F.lit(0.0), 2 - 0.5 * (len(STATEMENTS) - F.coalesce("n_statements", F.lit(0)))) + bands(F.coalesce("mean_rows", F.lit(0.0)), [(10, 1.0)]) + F.when(F.coalesce("periods_ok", F.lit(False)), 1.0).otherwise(0.0)
    d4 = F.when(n == 0, 3.0).otherwise(bands(F.col("n_data") / n, [(0.9, 3.0), (0.7, 2.0)]))
    d5 = F.when(n < 5, 2.0).otherwise(bands(F.col("n_captions") / n, [(0.4, 2.0), (0.2, 1.0)]))
    points = F.when(F.col("dangling").isNull(), 3.0).otherwise(0.0) + F.when(F.col("unequal").isNull(), 3.0).otherwise(0.0) + d3 + d4 + d5
    return per.select("doc_id", points.alias("d_consistency"), F.coalesce("dangling", F.lit(0)).alias("dangling"), F.col("unequal").isNull().alias("refs_equal"), F.round(F.coalesce("mean_rows", F.lit(0.0)), 1).alias("mean_rows"), F.coalesce("n_statements", F.lit(0)).alias("n_statements"))


def integrity(sections: DataFrame) -> DataFrame:
    """(doc_id, e_noise, max_length) of ``sections(doc_id, form, title, content, length, leaks)``: empty and short
    sections, broken characters, the largest one, ends cut off, and ends that run into the next part."""
    plain = C.collapsed(F.coalesce("content", F.lit("")))
    short = F.length(plain).between(1, 100) & ~F.coalesce(F.array_contains(per_form(lambda p: p.may_be_short, F.col("form")), item_of(F.col("title"), F.col("form"))), F.lit(False))
    per = sections.groupBy("doc_id").agg(
        F.count_if(plain == "").alias("empty"),
        F.count_if(short).alias("short"),
        F.count_if(F.coalesce("content", F.lit("")).rlike(MOJIBAKE)).alias("broken"),
        F.max("length").alias("max_length"),
        F.count_if(F.right(F.rtrim("content"), F.lit(80)).rlike(CUT_OFF)).alias("cut_off"),
        F.count_if("leaks").alias("leaks"),
    )
    few = lambda c: F.when(F.col(c) == 0, 3.0).when(F.col(c) <= 2, 1.0).otherwise(0.0)
    size = F.when(F.col("max_length") <= HUGE_WARN, 3.0).when(F.col("max_length") <= HUGE_FAIL, 1.0).otherwise(0.0)
    points = F.greatest(F.lit(0.0), 3.0 - F.col("empty") - 0.5 * F.col("short")) + F.when(F.col("broken") == 0, 3.0).otherwise(0.0) + size + few("cut_off") + few("leaks")
    return per.select("doc_id", points.alias("e_noise"), "max_length")


def addressability(sections: DataFrame) -> DataFrame:
    """(doc_id, s_semantic, filled) of ``sections(doc_id, form, level, title, topic)``: how many of the first level's
    sections, cover and signatures apart, have a topic."""
    counts = (F.col("level") == 1) & (F.coalesce("topic", F.lit("")) != "signature") & ~F.col("title").rlike(r"(?i)^cover\s+page$")
    per = sections.groupBy("doc_id", "form").agg(F.count_if(counts).alias("n"), F.count_if(counts & F.col("topic").isNotNull()).alias("filled"))
    free = ~per_form(lambda p: p.topics, F.col("form")) | (F.col("n") == 0)
    return per.select("doc_id", F.when(free, 10.0).otherwise(bands(C.ratio(F.col("filled"), F.col("n")), [(0.9, 10.0), (0.7, 6.0), (0.5, 3.0)])).alias("s_semantic"), "filled")


def graded(parts: DataFrame) -> DataFrame:
    """A document's total, grade and hard-gate reasons, from the six dimensions; one that is missing counts 0."""
    names = ("a_structure", "b_content", "c_search", "d_consistency", "e_noise", "s_semantic")
    total = F.round(sum((F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0)), 2)
    statements = per_form(lambda p: p.statements, F.col("form"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_hard_missing") > 0, "missing_items"),
            F.when(F.col("max_length") > HUGE_FAIL, "huge_section"),
            F.when(F.col("dangling") > 0, "dangling_refs"),
            F.when(~F.coalesce("refs_equal", F.lit(True)), "refs_differ"),
            F.when(statements & (F.col("mean_rows") == 0), "no_statement_rows"),
        )
    )
    return parts.withColumns({"total": total, "grade": F.when(total >= PASS, "pass").when(total >= WARN, "warn").otherwise("fail"), "reasons": reasons})


def batch(graded_documents: DataFrame) -> DataFrame:
    """(form, n, average, p10, hard_failures, coverage, failed) of each form's documents. Totals are counted by value
    before the percentile, which so sees no more rows than there are scores."""
    has = (F.col("n_statements") > 0) & (F.col("mean_rows") > 0)
    counted = graded_documents.groupBy("form", "total").agg(F.count("*").alias("c"), F.count_if(F.size("reasons") > 0).alias("hard"), F.count_if(has).alias("covered"), F.count_if(F.col("total") < WARN).alias("low"))
    per = counted.groupBy("form").agg(F.sum("c").alias("n"), F.round(F.sum(F.col("total") * F.col("c")) / F.sum("c"), 2).alias("average"), F.round(F.percentile("total", 0.1, F.col("c")), 2).alias("p10"), F.sum("hard").alias("hard_failures"), F.round(F.sum("covered") / F.sum("c"), 4).alias("coverage"), F.sum("low").alias("low"))
    short = lookup(FINANCIAL_COVERAGE, F.col("form")) > F.col("coverage")
    failed = [F.when(F.col("hard_failures") > 0, "hard_gate"), F.when(F.col("average") < BATCH_AVERAGE, "average"), F.when(F.col("p10") < BATCH_P10, "p10"), F.when(F.col("low") > 0, "low_document"), F.when(short, "financial_coverage")]
    return per.select("form", "n", "average", "p10", "hard_failures", "coverage", F.array_join(F.array_compact(F.array(*failed)), ",").alias("failed"))
