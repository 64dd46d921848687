"""HTML documents to rows: sections, links, table cells, text. The parser is Python's own; Spark deals out the pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "template", "ix:header", "ix:hidden"}
BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol", "br", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: The most rows and columns that HTML lets a cell span.
MOST_SPAN = {"rowspan": 65_534, "colspan": 1_000}


def unseen(tag: str, attrs: list) -> bool:
    """Whether an element is never shown: by what it is, by its attributes, or by its style."""
    given = {k: v or "" for k, v in attrs}
    style = "".join(given.get("style", "").lower().split())
    return tag in HIDDEN or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class Table:
    """Where the next cell of a table goes: row spans of cells above keep their columns taken."""

    def __init__(self, number: int):
        self.number, self.row, self.col, self.taken = number, -1, 0, {}

    def next_row(self) -> None:
        self.row, self.col = self.row + 1, 0

    def place(self, rows: int, cols: int) -> list[tuple[int, int]]:
        """Row and column of every place that a cell takes."""
        if self.row < 0:
            self.next_row()
        while self.taken.get(self.col, 0) > self.row:
            self.col += 1
        first = self.col
        for c in range(first, first + cols):
            self.taken[c] = self.row + rows
        self.col = first + cols
        return [(self.row + r, first + c) for r in range(rows) for c in range(cols)]


def span(attrs: list, name: str) -> int:
    value = dict(attrs).get(name) or ""
    return min(int(value), MOST_SPAN[name]) if value.strip().isdigit() and int(value) > 0 else 1


class Page(HTMLParser):
    """Lines of visible text with the heading level of each, and the cells of each table, spans spread out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[0, ""]]
        self.hidden: list[str] = []  # the open elements from the first unseen one on
        self.cells: list[list] = []
        self.tables: list[Table] = []
        self.n_tables, self.open = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID and (self.hidden or unseen(tag, attrs)):
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in BLOCKS:
            self.lines.append([int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0, ""])
        if tag == "table":
            self.tables.append(Table(self.n_tables))
            self.open.append(None)
            self.n_tables += 1
        elif tag == "tr" and self.tables:
            self.tables[-1].next_row()
        elif tag in ("td", "th") and self.tables:
            places = self.tables[-1].place(span(attrs, "rowspan"), span(attrs, "colspan"))
            self.cells.append([self.tables[-1].number, places, tag == "th", ""])
            self.open[-1] = self.cells[-1]

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if tag in ("td", "th") and self.open:
            self.open[-1] = None
        elif tag == "table" and self.tables:
            self.tables.pop()
            self.open.pop()
        if tag in BLOCKS:
            self.lines.append([0, ""])

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.lines[-1][1] += data
            if self.open and self.open[-1]:
                self.open[-1][3] += data

    @classmethod
    def of(cls, html: str | None) -> Page:
        page = cls()
        page.feed(html or "")
        page.close()
        return page

    def sections(self) -> Iterator[tuple[int, int, str, str]]:
        """(position, level, title, content): a heading with the lines up to the next one."""
        at, level, title, held = 0, 0, "", []
        for depth, text in [*self.lines, [9, ""]]:
            text = " ".join(text.split())
            if depth:
                if title or held:
                    yield at, level, title, "\n".join(held)
                    at += 1
                level, title, held = depth, text, []
            elif text:
                held.append(text)

    def matrix(self) -> Iterator[tuple[int, int, int, bool, str]]:
        """(table, row, col, header, text) of every place that a cell takes."""
        for table, places, header, text in self.cells:
            text = " ".join(text.split())
            yield from ((table, row, col, header, text) for row, col in places)

    def text(self) -> str:
        """Visible lines, one below the other."""
        return "\n".join(x for x in (" ".join(text.split()) for _, text in self.lines) if x)


def parsed(pages: DataFrame, rows: Callable[[Page], Iterator[tuple]], schema: str) -> DataFrame:
    """(page_id, …) of ``pages(page_id, html)``; a page that isn't HTML is one of text."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = [(p, *r) for p, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows(Page.of(h))]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, schema)


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, position, level, title, content)."""
    return parsed(pages, Page.sections, "page_id long, position long, level int, title string, content string")


def cells(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, col, header, text) of every place of every table; a cell that spans several is at each."""
    return parsed(pages, Page.matrix, "page_id long, table long, row long, col long, header boolean, text string")


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, text): what is shown, line by line."""
    return parsed(pages, lambda page: iter([(page.text(),)]), "page_id long, text string")


def title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def charset(html: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(html, r'(?i)<meta[^>]+charset="?([a-z0-9_-]+)', 1)), F.lit("")), F.lit("utf-8"))


def visible(html: Column) -> Column:
    """Text without tags, scripts and styles, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))
