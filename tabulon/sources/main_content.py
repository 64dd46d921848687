"""The main content of web pages: candidate blocks scored by their text and links, a gate of quality, and Markdown.

A page is parsed into a small tree without what is never content; Spark deals out the pages in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.html import BLOCKS, VOID

# Elements that may hold the content and what each is worth, the first that fits counts; a value that begins
# with * need only be contained.
CANDIDATES = (
    ("tag", "article", 240), ("tag", "main", 220), ("role", "main", 220), ("class", "article-content", 230), ("class", "entry-content", 230), ("class", "post-content", 230), ("class", "news-content", 220),
    ("class", "g-articl-text", 220), ("class", "content", 180), ("class", "*article", 170), ("class", "*content", 140), ("id", "*article", 170), ("id", "*content", 140),
)
# Elements of text, elements and parts that are no content, limits of the score and of the gate.
TEXTS = {"h1", "h2", "h3", "h4", "p", "li", "blockquote"}
NOISE = {"script", "style", "noscript", "svg", "canvas", "template", "iframe", "nav", "footer", "aside", "form", "button"}
LEAST_BLOCK, LEAST_TEXT, MOST_TEXT, PER_BLOCK, LINKS = 8, 80, 6_000, 35, 300
GATE_CHARS, GATE_BLOCKS, GATE_LINKS, GATE_NAVIGATION = 80, 2, 0.45, 2
NAVIGATION = ("subscribe", "sign in", "sign up", "newsletter", "advertisement", "cookie", "privacy policy", "terms of use", "all rights reserved")
CHALLENGE = ("just a moment", "attention required", "verify you are human", "checking your browser", "access denied", "bot challenge", "captcha-delivery", "please enable js and disable any ad blocker")

SCHEMA = "page_id long, title string, source string, usable boolean, flags array<string>, n_chars long, n_blocks long, link_density double, text string, markdown string"
#: Markdown tells elements apart to this depth; what is deeper is text.
DEEPEST = 100
#: Elements that end an open one of the same kind.
CLOSING_ALIKE = {"p", "li", "td", "th", "tr", "option", "dt", "dd"}


@dataclass
class Node:
    tag: str
    given: dict = field(default_factory=dict)
    inside: list = field(default_factory=list)  # nodes and pieces of text

    def nodes(self) -> Iterator[Node]:
        """The nodes inside, in order."""
        stack = [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    yield x
                    stack.append(iter(x.inside))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        said, stack = [], [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    stack.append(iter(x.inside))
                    said.append(" " if x.tag in BLOCKS else "")
                    break
                said.append(x)
            else:
                stack.pop()
                said.append(" ")
        return " ".join("".join(said).split())


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root, self.meta, self.titles = Node("body"), {}, []
        self.open, self.skipped = [self.root], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((given.get("property") or given.get("name") or "").lower(), given.get("content", ""))
        if self.skipped or tag in NOISE or given.get("aria-hidden") == "true":
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in CLOSING_ALIKE and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, given)
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
        elif any(node.tag == tag for node in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.open[-1].tag == "title":
            self.titles.append(data)
        elif not any(node.tag == "head" for node in self.open):
            self.open[-1].inside.append(data)


def bonus(node: Node) -> int | None:
    """What a node is worth as a candidate; None if it is none."""
    classes = node.given.get("class", "").split()
    for where, value, worth in CANDIDATES:
        said = {"tag": [node.tag], "class": classes, "role": [node.given.get("role", "")], "id": [node.given.get("id", "")]}[where]
        if value in said or (value[0] == "*" and value[1:] in (node.given.get(where) or "")):
            return worth
    return None


def blocks(node: Node) -> list[str]:
    """The distinct texts of its elements of text, or all its text."""
    found = dict.fromkeys(t for x in node.nodes() if x.tag in TEXTS and len(t := x.text()) >= LEAST_BLOCK)
    return list(found) or [t for t in [node.text()] if t]


def links(node: Node) -> str:
    return " ".join(filter(None, (x.text() for x in node.nodes() if x.tag == "a")))


def best(root: Node) -> Node | None:
    """The candidate of the highest score, of equals the first in the order of CANDIDATES, then of the page."""
    top = None
    for k, node in enumerate(root.nodes()):
        if (worth := bonus(node)) is None:
            continue
        own = blocks(node)
        size = len("\n\n".join(own))
        if size < LEAST_TEXT:
            continue
        whole = len(node.text())
        score = min(size, MOST_TEXT) + len(own) * PER_BLOCK + worth - int(len(links(node)) / whole * LINKS)
        if top is None or (score, worth, -k) > top[0]:
            top = (score, worth, -k), node
    return top and top[1]


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists, quotes and links of the kept tree."""
    lines: list[str] = []

    def inline(x, depth: int = 0) -> str:
        if not isinstance(x, Node):
            return x
        inner = "".join(inline(y, depth + 1) for y in x.inside) if depth < DEEPEST else x.text()
        said = " ".join(inner.split())
        if x.tag == "a" and said and x.given.get("href"):
            return f"[{said}]({x.given['href']})"
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(x.tag)
        return f"{mark}{said}{mark}" if mark and said and not any(isinstance(y, Node) and y.tag in BLOCKS for y in x.nodes()) else "\n" if x.tag == "br" else inner

    def put(prefix: str, said: str) -> None:
        if said := " ".join(said.split()):
            lines.append(prefix + said)

    def walk(x: Node, prefix: str, order: int | None, depth: int = 0) -> None:
        held: list[str] = []
        if depth == DEEPEST:
            return put(prefix, x.text())

        def flush() -> None:
            put(prefix, "".join(held))
            held.clear()

        for child in x.inside:
            if not isinstance(child, Node) or not (child.tag in BLOCKS | TEXTS or any(y.tag in BLOCKS for y in child.nodes())) or child.tag == "br":
                held.append(inline(child))
                continue
            flush()
            if re.fullmatch("h[1-6]", child.tag):
                put("#" * int(child.tag[1]) + " ", inline(child))
            elif child.tag == "li":
                order = None if order is None else order + 1
                walk(child, "- " if order is None else f"{order}. ", None, depth + 1)
            else:
                walk(child, "> " if child.tag == "blockquote" else prefix if child.tag not in ("ul", "ol") else "", 0 if child.tag == "ol" else None, depth + 1)
        flush()

    walk(node, "", None)
    return "\n\n".join(lines)


def main_content(html: str | None) -> tuple:
    """(title, source, usable, flags, n_chars, n_blocks, link_density, text, markdown) of a page."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    titles = [tree.meta.get(k, "") for k in ("og:title", "twitter:title", "title")] + ["".join(tree.titles)]
    title = next((t for t in (" ".join(t.split()) for t in titles) if t), "")
    chosen = best(tree.root)
    node = chosen or tree.root
    text = node.text()
    n_blocks = sum(x.tag in TEXTS for x in node.nodes())
    density = len(links(node)) / len(text) if text else 0.0
    low = f"{title} {text}".lower()
    checks = {
        "too_short": len(text) < GATE_CHARS,
        "too_few_blocks": n_blocks < GATE_BLOCKS,
        "high_link_density": density > GATE_LINKS,
        "navigation_like": sum(x in low for x in NAVIGATION) >= GATE_NAVIGATION,
        "challenge_like": any(x in low for x in CHALLENGE),
    }
    flags = [name for name, hit in checks.items() if hit]
    return title, "candidate" if chosen else "body", not flags, flags, len(text), n_blocks, round(density, 4), text, markdown(node)


def contents(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> a row of SCHEMA for each page, an unusable one too, with the flags that say why.

    The candidate with the best score is the content (source ``candidate``), without one the whole body (``body``). A null
    page is an empty one; whatever isn't HTML is text.
    """
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = list(zip(*map(main_content, part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, kind) for c, kind in zip(found, kinds)]], names=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)
