"""Column builders for text, dates, numbers and identifiers of filings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def ascii_tokens(text: str) -> list[str]:
    """What ``tokens`` has, for a word list in the plan."""
    return re.findall("[a-z0-9]+", text.lower())


def centred(text: Column, match: Column, width: int) -> Column:
    """At most ``width`` characters of the text around the match, whatever its case; its head where there is none."""
    n, at = F.length(text), F.instr(F.lower(text), F.lower(match))
    end = F.least(n, F.greatest(F.lit(0), at - 1 - width // 2) + width)
    return F.when((n <= width) | text.isNull(), F.coalesce(text, F.lit(""))).when((at == 0) | (F.trim(match) == ""), F.substring(text, 1, width)).otherwise(F.substring(text, F.greatest(F.lit(0), end - width) + 1, F.lit(width)))


def comparable(c: Column) -> Column:
    """Lower case without anything but word characters: what two snippets are compared by."""
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def around(text: Column, match: Column, width: int) -> Column:
    """``width`` characters of the text with the match in the middle, as far as the text reaches; empty without one."""
    at = F.instr(F.lower(text), F.lower(match))
    start = F.greatest(F.lit(1), at - F.floor((F.lit(width) - F.length(match)) / 2).cast("int"))
    return F.when(at > 0, F.substring(text, start, F.lit(width))).otherwise(F.lit(""))


def token_units(c: Column) -> Column:
    """Estimated model tokens: wide East Asian characters count two, others one, two to a token, at least one."""
    wide = F.length(c) - F.length(F.regexp_replace(c, r"[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", ""))
    return F.greatest(F.lit(1), F.ceil((F.length(c) + wide) / 2)).cast("long")


def reference(prefix: str, n: Column) -> Column:
    """s_0001, t_0001, ..."""
    return F.concat(F.lit(f"{prefix}_"), F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0")))


def untagged(c: Column) -> Column:
    return collapsed(F.regexp_replace(c, "<[^>]+>", " "))


def partial_date(c: Column, end: bool = False) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a date: the first day of what is given, or the last."""
    year = F.when(c.rlike(r"^\d{4}$"), F.make_date(F.substring(c, 1, 4).cast("int"), F.lit(12 if end else 1), F.lit(31 if end else 1)))
    first = F.concat(c, F.lit("-01")).try_cast("date")
    month = F.when(c.rlike(r"^\d{4}-\d{2}$"), F.last_day(first) if end else first)
    return F.coalesce(year, month, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")))


def tolerant_number(c: Column) -> Column:
    """Amounts as reports print them: brackets for negatives, currency signs, thousands separators, either decimal sign;
    null for dashes, n/a and what isn't an amount."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), "[−–—]", "-"), r"(?i)(US\$|HK\$|RMB|USD|EUR|[$€£¥]|\s)", "")
    negative = plain.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(plain, r"[()]", "")
    european = bare.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$") | bare.rlike(r"^-?\d+,\d{1,2}$")
    western = F.regexp_replace(bare, ",", "")
    number = F.when(european, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(western).try_cast("double")
    return F.when(negative, -number).otherwise(number)


def scale_of(decimals: Column) -> Column:
    """Name of the scale that a fact's ``decimals`` states."""
    d = decimals.try_cast("int")
    return F.when(d == -9, "billions").when(d == -6, "millions").when(d == -3, "thousands").when(d == 0, "units").when(d > 0, "decimals")


def canonical_ticker(raw: Column) -> Column:
    """struct<ticker, market, exchange>: Hong Kong codes have four digits at least, mainland ones six; else a US symbol."""
    t = F.upper(F.trim(raw))
    code = F.regexp_extract(t, r"^(?:HK[.:]?)?(\d{1,5})(?:\.HK)?$", 1)
    hong_kong = (code != "") & (F.length(code) <= 5)
    mainland = F.regexp_extract(t, r"^(?:(?:SH|SZ)[.:]?)?(\d{6})(?:\.(?:SS|SH|SZ))?$", 1)
    exchange = F.when(t.rlike(r"^SH|\.(SS|SH)$"), "SSE").when(t.rlike(r"^SZ|\.SZ$"), "SZSE").when(mainland.startswith("6"), "SSE").otherwise("SZSE")
    us = t.rlike(r"^[A-Z]{1,5}([.-][A-Z]{1,2})?$")
    made = lambda ticker, market, where: F.struct(ticker.alias("ticker"), F.lit(market).alias("market"), where.alias("exchange"))
    bare = F.regexp_replace(code, "^0+", "")
    return F.when(mainland != "", made(mainland, "CN", exchange)).when(hong_kong & (bare != ""), made(F.when(F.length(bare) < 4, F.lpad(bare, 4, "0")).otherwise(bare), "HK", F.lit("HKEX"))).when(us, made(t, "US", F.lit(None).cast("string")))


def local_name(concept: Column) -> Column:
    """A concept without its namespace, in lower case."""
    return F.lower(F.element_at(F.split(concept, "[:_ ]"), -1))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def canonical_json(c: Column) -> Column:
    """A flat JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def stable_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def span_kind(start: Column, end: Column) -> Column:
    """Whether two dates lie a quarter or half a year apart, as reports count it."""
    days = F.date_diff(end, start)
    return F.when(days.between(80, 100), "quarter").when(days.between(170, 190), "half").otherwise("other")


def unique_names(names: Column) -> Column:
    """A name's second occurrence becomes name_2, its third name_3."""

    def numbered(x: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x))
        return F.when(n > 1, F.concat(x, F.lit("_"), n.cast("string"))).otherwise(x)

    return F.transform(names, numbered)


def markdown_row(*columns: str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))


def markdown_cells(line: Column) -> Column:
    """Trimmed cells of a row of a pipe table."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def named(c: Column, names: dict[str, str]) -> Column:
    """The official name of what is written with blanks, underscores and in any case; itself where it has none."""
    key = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), c)


def suffix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1), F.lit(""))


def public_url(url: Column) -> Column:
    """An address of the web that isn't one of a private network."""
    private = url.rlike(r"://(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.)")
    return url.rlike(r"^https?://") & ~private


def tail_sentence(text: Column) -> Column:
    """What stands after the last full stop, semicolon or line end that anything follows."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"[.;。；\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.get(parts, F.size(parts) - 1))


def table_references(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[(t_\d{4,})\]\]"), F.lit(1)))


def with_placeholders(text: Column, references: Column) -> Column:
    """The text with the placeholders that it lacks, a line for each, at its end."""
    written = F.transform(references, lambda r: F.concat(F.lit("[["), r, F.lit("]]")))
    missing = F.array_join(F.filter(written, lambda w: ~F.contains(text, w)), "\n")
    return F.when(missing == "", text).otherwise(F.trim(F.concat_ws("\n", F.nullif(text, F.lit("")), missing)))


def accession(bare: Column) -> Column:
    """An accession number of 18 digits with its hyphens."""
    return F.regexp_replace(bare, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")


def cell_value(c: Column) -> Column:
    """A table cell: null where it is blank or a dash, a number in plain form, or its text."""
    text = collapsed(c)
    bare = F.regexp_replace(text, r"(?<=\d)(\[(\d+|[a-zA-Z])\]|\((\d+|[a-zA-Z])\)|[a-zA-Z])\s*$", "")
    negative = bare.rlike(r"^\(.*\)$")
    plain = F.regexp_replace(F.regexp_replace(bare, r"^\((.*)\)$", "$1"), r"[$¥€ ,]|^\+", "")
    number = F.when(~F.contains(bare, F.lit("%")) & plain.rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.when(negative, "-").otherwise(""), plain))
    return F.when(F.lower(text).isin("", "-", "—", "–", "n/a", "na", "nan", "none"), None).otherwise(F.coalesce(number, text))


def first_key(given: Column, keys: list[str]) -> Column:
    """The value of the first of the keys that a map has, whatever their case."""
    lowered = F.transform_keys(given, lambda k, _: F.lower(k))
    return F.coalesce(*[F.try_element_at(lowered, F.lit(k.lower())) for k in keys])
