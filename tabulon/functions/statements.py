"""Which financial statement a table is, by the words of its caption, headers, context and rows (column expressions)."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.columns import collapsed, let

# Patterns that name each statement, in the order of the types.
NAMES = {
    "balance_sheet": (r"\bbalance\s+sheets?\b", r"\bstatement(?:s)?\s+of\s+financial\s+position\b", r"\bfinancial\s+position\b", r"\bassets?,\s+liabilities?\s+and\s+(?:stockholders'|shareholders'?)\s+equity\b"),
    "income": (r"\bstatement(?:s)?\s+of\s+operations\b", r"\bstatement(?:s)?\s+of\s+income\b", r"\bstatement(?:s)?\s+of\s+earnings\b", r"\bresults\s+of\s+operations\b", r"\bprofit\s+and\s+loss\b"),
    "cash_flow": (r"\bcash\s+flows?\b", r"\bstatement(?:s)?\s+of\s+cash\s+flows?\b"),
    "equity": (r"\bstatement(?:s)?\s+of\s+(?:stockholders'|shareholders'?)\s+equity\b", r"\bstatement(?:s)?\s+of\s+changes\s+in\s+equity\b", r"\bstatement(?:s)?\s+of\s+stockholders'?\s+investment\b"),
    "comprehensive_income": (r"\bstatement(?:s)?\s+of\s+comprehensive\s+income\b", r"\bstatement(?:s)?\s+of\s+comprehensive\s+(?:loss|earnings)\b", r"\bother\s+comprehensive\s+income\b", r"\bcomprehensive\s+income\b"),
}
# Patterns of rows that each statement has.
ROWS = {
    "balance_sheet": (r"\btotal\s+assets?\b", r"\btotal\s+(?:current\s+)?liabilit(?:y|ies)\b", r"\b(?:non[- ]?current|current)\s+assets?\b", r"\b(?:shareholders'?|stockholders'?)\s+equity\b", r"\btotal\s+equity\b"),
    "income": (r"\btotal\s+revenue\b", r"\brevenues?\b", r"\bcost\s+of\s+(?:sales|revenue)\b", r"\bgross\s+profit\b", r"\boperating\s+(?:income|loss|profit)\b", r"\bnet\s+(?:income|loss|earnings|profit)\b", r"\bearnings\s+per\s+share\b"),
    "cash_flow": (r"\boperating\s+activities\b", r"\binvesting\s+activities\b", r"\bfinancing\s+activities\b", r"\bnet\s+cash\s+(?:provided|used)\b", r"\bcash\s+and\s+cash\s+equivalents\b"),
    "equity": (r"\bcommon\s+stock\b", r"\badditional\s+paid[- ]in\s+capital\b", r"\bretained\s+earnings\b", r"\btreasury\s+stock\b", r"\baccumulated\s+other\s+comprehensive\s+(?:income|loss)\b", r"\bdividends?\b"),
    "comprehensive_income": (r"\bnet\s+income\b", r"\bother\s+comprehensive\s+(?:income|loss)\b", r"\bcomprehensive\s+income\b", r"\bforeign\s+currency\s+translation\b", r"\bunrealized\s+(?:gain|loss)\b"),
}
# Further rows that count where nothing else was found.
RELAXED_ROWS = ROWS | {"balance_sheet": ROWS["balance_sheet"] + (r"\bcash\s+and\s+cash\s+equivalents\b", r"\brestricted\s+cash\b", r"\bborrowings?\b", r"\bnet\s+debt\b")}
# Captions and headers of tables that are no statement.
OTHERS = (
    r"\btable\s+of\s+contents\b", r"\bexhibit\s+index\b", r"\bindex\s+to\s+exhibits\b", r"\bsignatures?\b", r"\bnotes?\s+to\s+(?:the\s+)?consolidated\s+financial\s+statements?\b",
    r"\bnotes?\s+to\s+financial\s+statements?\b", r"\bschedule\s+[ivx0-9]+\b", r"\bselected\s+financial\s+data\b", r"\bquarterly\s+(?:financial|results)\b", r"\bsupplementary\s+data\b",
    r"\bsecurities\s+registered\s+pursuant\s+to\s+section\s+12\b", r"\btrading\s+symbol(?:s)?\b", r"\bname\s+of\s+each\s+exchange\b",
)
# Weights of a pattern's hits, least scores, characters of context, hits and rows of tables found by rows.
CAPTION, HEADERS, CONTEXT, ROW = 6, 4, 1, 2
LEAST, LEAST_NAMED, CONTEXT_CHARS = 4, 2, 320
ROW_HITS, RELAXED_HITS, LEAST_ROWS = 2, 3, 6


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns the text has."""
    return functools.reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


def plain(text: Column) -> Column:
    return F.lower(collapsed(F.coalesce(text, F.lit(""))))


def statement_type(caption: Column, headers: Column, context: Column) -> Column:
    """The statement whose indicators weigh most; null below the least score, on a tie, or for a table of another kind."""
    texts = F.struct(plain(caption).alias("said"), plain(headers).alias("head"), plain(F.right(F.coalesce(context, F.lit("")), F.lit(CONTEXT_CHARS))).alias("around"))

    def scored(t: Column) -> Column:
        one = [
            F.struct(F.lit(kind).alias("kind"), hits(t["said"], names).alias("said"), hits(t["head"], names).alias("head"), hits(t["around"], names).alias("around"), hits(t["head"], ROWS[kind]).alias("rows"))
            for kind, names in NAMES.items()
        ]
        weigh = lambda x: F.struct((x["said"] * CAPTION + x["head"] * HEADERS + x["around"] * CONTEXT + x["rows"] * ROW).alias("score"), x["kind"].alias("kind"), x["said"].alias("said"), (x["said"] + x["head"]).alias("named"))
        other = F.struct((hits(t["said"], OTHERS) > 0).alias("by_caption"), (hits(F.concat_ws(" ", t["said"], t["head"]), OTHERS) > 0).alias("by_either"))
        return F.struct(F.transform(F.array(*one), weigh).alias("scores"), other.alias("other"))

    def chosen(x: Column) -> Column:
        scores = x["scores"]
        best = F.filter(scores, lambda s: s["score"] == F.array_max(F.transform(scores, lambda y: y["score"])))
        first = F.get(best, F.lit(0))
        unsaid, unnamed = F.forall(scores, lambda s: s["said"] == 0), F.forall(scores, lambda s: s["named"] == 0)
        other = (x["other"]["by_caption"] & unsaid) | (x["other"]["by_either"] & unnamed)
        return F.when(~other & (first["score"] >= LEAST) & (F.size(best) == 1), first["kind"]).when(~other & first["score"].between(LEAST_NAMED, LEAST - 1) & (first["named"] > 0), first["kind"])

    return let(let(texts, scored), chosen)
