"""Dates, fiscal periods, currencies, scales and numbers in the free text of report tables."""

from __future__ import annotations

import calendar
import datetime as dt
import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import collapsed, let

# Month names of English, Spanish, Portuguese and French tables; a longer name counts by its first three letters.
MONTHS = {
    1: "jan january ene enero janvier", 2: "fev feb february febrero", 3: "mar march marzo", 4: "apr april abr abril", 5: "may mayo mai", 6: "jun june junio",
    7: "jul july julio", 8: "aug august ago agosto", 9: "sep sept september set setembro septiembre", 10: "oct october out outubro", 11: "nov november", 12: "dez dec december dic diciembre",
}
# Last day of a fiscal period, and what a period ends in where its text only says how long it is.
PERIOD_ENDS = {"Q1": "03-31", "Q2": "06-30", "Q3": "09-30", "Q4": "12-31", "H1": "06-30", "H2": "12-31", "FY": "12-31"}
QUARTER_OF_MONTH = {3: "Q1", 6: "Q2", 9: "Q3", 12: "Q4"}
HALF_OF_MONTH = {6: "H1", 12: "H2"}
BALANCE_OF_MONTH = {3: "Q1", 6: "Q2", 9: "Q3", 12: "FY"}
QUARTER_LENGTHS, YEAR_LENGTHS = ("three months ended", "quarter ended", "three-month period"), ("twelve months ended", "year ended", "fiscal year")
YEAR_SCOPES = ("year ended", "fiscal year", "twelve months")
# What a currency is printed as, and its code.
PRINTED = ("HK$", "US$", "RMB", "BRL", "EUR", "GBP", "$")
CURRENCY_CODES = {"HK$": "HKD", "US$": "USD", "RMB": "CNY", "CNY": "CNY", "$": "USD"}

_YEAR, _NAME = r"19\d{2}|20\d{2}|2100", r"[A-Za-zÀ-ÿ]{3,12}"
#: What a date looks like, in the order in which forms are tried, and which group is what; "x" and "y" are day and month
#: in the order that their size allows, month first where both do. Without a day it is the month's last.
DATE_FORMS = tuple((re.compile(form), kinds) for form, kinds in (
    (rf"\b({_YEAR})[/-](\d{{1,2}})[/-](\d{{1,2}})\b", "YMD"),
    (rf"\b(\d{{1,2}})[-\s]({_NAME})[-\s]({_YEAR}|\d{{2}})\b", "DNY"),
    (rf"\b({_YEAR})\s+({_NAME})\.?\s+(\d{{1,2}})\b", "YND"),
    (rf"\b(\d{{1,2}})[/-](\d{{1,2}})[/-]({_YEAR})\b", "xyY"),
    (r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2})\b", "xyY"),
    (rf"\b({_NAME})\s+(\d{{1,2}})(?:,)?\s+({_YEAR})\b", "NDY"),
    (rf"\b(\d{{1,2}})\s+({_NAME})\s+({_YEAR})\b", "DNY"),
    (rf"\b({_NAME})\.?\s+({_YEAR})\b", "NY"),
    (rf"\b({_YEAR})\s+({_NAME})\b", "YN"),
))
#: Fiscal labels in the order in which they are tried: what they look like, and the label or the letter before its number.
LABEL_FORMS = tuple((re.compile("(?i)" + form), name) for form, name in (
    (r"\b(?:Q(?P<n>[1-4])|(?P<m>[1-4])Q)\s*[-/']?\s*(?:fy)?\s*(?P<y>\d{2,4})\b", "Q"),
    (r"\b(?P<y>\d{2,4})\s*(?:Q(?P<n>[1-4])|(?P<m>[1-4])Q)\b", "Q"),
    (r"\b(?:H(?P<n>[12])|(?P<m>[12])H)\s*[-/']?\s*(?P<y>\d{2,4})\b", "H"),
    (r"\b(?P<y>\d{2,4})\s*(?:H(?P<n>[12])|(?P<m>[12])H)\b", "H"),
    (r"\b9M\s*[-/']?\s*(?P<y>\d{2,4})\b", "Q3"),
    (r"\b6M\s*[-/']?\s*(?P<y>\d{2,4})\b", "H1"),
    (r"\b(?:FY|FYE)\s*[-/']?\s*(?P<y>\d{2,4})\b", "FY"),
    *[(rf"\b{word}\s+quarter\s+(?P<y>\d{{2,4}})\b", f"Q{k}") for k, word in enumerate(("first", "second", "third", "fourth"), 1)],
))
DIGIT = re.compile(r"\d")  # Every date and label has one.
BARE_YEAR, MONTH_DAY = re.compile(rf"\b({_YEAR})\b"), re.compile(rf"\b({_NAME})\s+(\d{{1,2}}),?\b")
FUSED = re.compile(r"(?i)\b(ended|ending|as\s+of|as\s+at)(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)\b")


def mapped(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


@functools.cache
def month_number(name: str) -> int | None:
    """Of a month's name, accents and all; None if it is none."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return NUMBERS.get(plain) or NUMBERS.get(plain[:3])


NUMBERS = {word: n for n, words in MONTHS.items() for word in words.split()}


def full_year(digits: str) -> int:
    year = int(digits)
    return year if year >= 100 else 2000 + year if year <= 69 else 1900 + year


def spaced(text: str | None) -> str:
    """White space collapsed, and a month apart from the word that it is printed onto."""
    return FUSED.sub(r"\1 \2", " ".join((text or "").split()))


def day_of(year: int, month: int | None, day: int | None) -> dt.date | None:
    """The date, the month's last without a day; None if there is none."""
    if month not in range(1, 13) or year not in range(1, 10_000):
        return None
    last = calendar.monthrange(year, month)[1]
    return dt.date(year, month, last if day is None else day) if day is None or 1 <= day <= last else None


def read_date(kinds: str, groups: tuple[str, ...]) -> dt.date | None:
    part = dict(zip(kinds, groups))
    if "x" in part:
        month, day = (part["y"], part["x"]) if int(part["x"]) > 12 else (part["x"], part["y"])
        return day_of(full_year(part["Y"]), int(month), int(day))
    month = month_number(part["N"]) if "N" in part else int(part["M"])
    return day_of(full_year(part["Y"]), month, int(part["D"]) if "D" in part else None)


def first_date(text: str | None) -> dt.date | None:
    """The first valid date of the first form of DATE_FORMS that has one."""
    if not text or not DIGIT.search(text):
        return None
    said = spaced(text)
    found = (read_date(kinds, m.groups()) for form, kinds in DATE_FORMS for m in form.finditer(said))
    return next((d for d in found if d), None)


def fiscal_label(text: str | None) -> tuple[str, int] | None:
    """The first form of LABEL_FORMS in the text, as Q1, H2 or FY and a year."""
    if not text or not DIGIT.search(text):
        return None
    said = spaced(text)
    for form, name in LABEL_FORMS:
        if m := form.search(said):
            return name + (m["n"] or m["m"] if "n" in form.groupindex else ""), full_year(m["y"])
    return None


def period_end(header: str | None, scope: str | None) -> dt.date | None:
    """End of the period of a column, from its header and the text around the table.

    A date counts before a fiscal label, and either before a bare year, which needs a month and day, "as of" or a year's
    length in the scope. Each is looked for in the header first, then in both.
    """
    head, around = " ".join((header or "").split()), " ".join((scope or "").split())
    both = (head, f"{head} {around}", f"{around} {head}")
    if found := next(filter(None, map(first_date, both)), None):
        return found
    if found := next(filter(None, map(fiscal_label, both)), None):
        return dt.date.fromisoformat(f"{found[1]:04d}-{PERIOD_ENDS[found[0]]}")
    year = BARE_YEAR.search(both[1])
    if not year:
        return None
    named = MONTH_DAY.search(around)
    if named and (month := month_number(named[1])) and 1 <= int(named[2]) <= 31:
        return day_of(int(year[0]), month, int(named[2])) or day_of(int(year[0]), month, None)
    return dt.date(int(year[0]), 12, 31) if any(x in around.lower() for x in ("as of", "as at", *YEAR_SCOPES)) else None


def fiscal_period(header: str | None, scope: str | None, end: dt.date) -> str | None:
    """Q1 to Q4, H1, H2 or FY of a column: as its header or scope names it, else from the scope's words and the end's month."""
    if label := fiscal_label(header) or fiscal_label(scope):
        return label[0]
    low = " ".join((scope or "").split()).lower()
    if any(x in low for x in QUARTER_LENGTHS):
        return QUARTER_OF_MONTH.get(end.month)
    if "nine months ended" in low and end.month == 9:
        return "Q3"
    if "six months ended" in low:
        return HALF_OF_MONTH.get(end.month)
    if any(x in low for x in YEAR_LENGTHS):
        return "FY"
    return BALANCE_OF_MONTH.get(end.month) if "as of" in low or "as at" in low else None


PERIOD = T.StructType([T.StructField("period_end", T.DateType()), T.StructField("fiscal_period", T.StringType())])
DEPTHS = T.ArrayType(T.StructType([T.StructField("scope", PERIOD), T.StructField("dated", T.BooleanType()), T.StructField("columns", T.ArrayType(PERIOD))]))
# Fixed value: headers with their scopes whose periods a task keeps, since tables are alike.
KEPT = 20_000


def periods_of_depths(headers: Column, scopes: Column, counts: Column, columns: Column, value_rows: int) -> Column:
    """array<struct<scope, dated, columns>>: for each depth of a table's header the period of the scope alone, whether the
    headers alone have a date or a fiscal label, and the period of each of its columns.

    The array ends with the first depth of which every column has a period of its own, and is a column of values: below
    it there are no more columns and no more rows, so that no deeper header reads more. In Arrow batches, since the
    cascade of forms outgrows what Spark compiles; equal headers of a task are read once."""

    def read(headers: pa.Array, scopes: pa.Array, counts: pa.Array, columns: pa.Array) -> pa.Array:
        one = pa.struct([("period_end", pa.date32()), ("fiscal_period", pa.string())])
        rows = zip(headers.to_pylist(), scopes.to_pylist(), counts.to_pylist(), columns.to_pylist())
        return pa.array([_depths(*row, value_rows) for row in rows], pa.list_(pa.struct([("scope", one), ("dated", pa.bool_()), ("columns", pa.list_(one))])))

    return F.arrow_udf(read, DEPTHS)(headers, scopes, counts, columns)


def _depths(headers: list[str], scopes: list[str], counts: list[list[int]], columns: list[list[str]], value_rows: int) -> list[dict]:
    out = []
    for head, scope, numbers, names in zip(headers, scopes, counts, columns):
        found = [_period(name or "", scope or "") for name in names]
        out.append({"scope": _period("", scope or ""), "dated": _dated(head or ""), "columns": found})
        ends = {(p["period_end"], p["fiscal_period"]) for p in found if p["period_end"]}
        if len(ends) == len(names) and (min(numbers) >= value_rows or max(numbers) < value_rows and out[-1]["dated"]):
            break
    return out


@functools.lru_cache(KEPT)
def _period(header: str, scope: str) -> dict:
    end = period_end(header, scope)
    return {"period_end": end, "fiscal_period": end and fiscal_period(header, scope, end)}


@functools.lru_cache(KEPT)
def _dated(headers: str) -> bool:
    return bool(first_date(headers) or fiscal_label(headers))


def printed_currency(header: Column, scope: Column) -> Column:
    """The currency as the table prints it; null if it prints none."""
    said = F.concat_ws(" ", header, scope)
    low = F.lower(said)
    named = F.when(F.contains(low, F.lit("hk$")), "HK$").when(F.contains(low, F.lit("us$")), "US$").when(F.contains(low, F.lit("rmb")), "RMB")
    for code in ("BRL", "EUR", "GBP"):
        named = named.when(said.rlike(rf"(?i)\b{code}\b"), code)
    return named.when(F.contains(said, F.lit("$")), "$")


def currency_code(printed: Column) -> Column:
    return F.coalesce(mapped(CURRENCY_CODES, printed), printed)


def printed_scale(caption: Column) -> Column:
    low = F.lower(collapsed(F.coalesce(caption, F.lit(""))))
    return F.when(F.contains(low, F.lit("in thousands")), "thousands").when(F.contains(low, F.lit("in millions")), "millions")


def units_label(printed: Column, scale: Column) -> Column:
    """"US$ in millions", or what there is of it."""
    return F.nullif(F.concat_ws(" in ", printed, scale), F.lit(""))


_MONEY = r"us\$|hk\$|nt\$|r\$|ps\.?|cop|usd|eur|gbp|cny|rmb|ars|brl|mxn|chf|jpy|krw"


def statement_number(cell: Column) -> Column:
    """The number that a cell prints: brackets or any minus for negatives, currencies before it, %, x, times, bps and
    points after it, either decimal sign; null where it prints none."""
    said = collapsed(F.coalesce(cell, F.lit("")))

    def stripped(plain: Column) -> Column:
        bare = F.trim(F.regexp_replace(plain, r"[()]", ""))
        bare = F.regexp_replace(F.regexp_replace(bare, rf"(?i)^(?:{_MONEY})\s*", ""), r"(?i)\s*(?:%|x|times|bps|pts?|points?)$", "")
        bare = F.regexp_replace(F.regexp_replace(bare, "[$€£¥₩₹]", ""), rf"(?i)\b(?:{_MONEY})\b", "")
        na = F.lower(plain).isin("nan", "none", "nat", "n/a", "na", "nm")
        return F.struct(F.when(~na, F.regexp_replace(bare, "[' ]", "")).alias("bare"), F.when(plain.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0).alias("sign"))

    def read(x: Column) -> Column:
        # A decimal comma: after the last dot, or the only comma, with a digit or two behind it.
        comma = x["bare"].rlike(r"\.[^.]*,[^.]*$") | x["bare"].rlike(r"^[^,.]*,[^,.]{1,2}$")
        digits = F.when(comma, F.replace(F.replace(x["bare"], F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x["bare"], F.lit(","), F.lit("")))
        return let(digits, lambda d: F.when(d.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), d.try_cast("double") * x["sign"]))

    return let(let(F.regexp_replace(said, "[−–—]", "-"), stripped), read)
