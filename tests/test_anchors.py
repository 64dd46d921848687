"""Sections of quarterly and foreign annual reports: cases, and random lines against a walk over them."""

import random
import re
import time

import pytest

from tabulon.operators import anchors

LINES = "doc_id long, at long, line string"
FILL = "x" * 600


def placed(spark, docs):
    rows = []
    for doc, lines in docs.items():
        at = 0
        for line in lines:
            rows.append((doc, at, line))
            at += len(line or "") + 1
    return spark.createDataFrame(rows, LINES), {(d, a): x for d, a, x in rows}


def titles(df, text):
    got = {}
    for r in df.orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], text[r["doc_id"], r["start"]], r["end"]))
    return {d: [(t, line) for t, line, _ in x] for d, x in got.items()}


CONTENTS = ["PART I FINANCIAL INFORMATION", "Item 1. Financial Statements 3", "Item 2. Management's Discussion 9", "Item 3. Market risk 20", "Item 4. Controls 21", "PART II OTHER INFORMATION", "Item 1. Legal 22", "Item 1A. Risk 22", "Item 6. Exhibits 23"]
BODY = ["Part I - Financial Informa tion", "Item 1. Statements", FILL, FILL, "2. Management’s Discussion and Analysis", FILL, FILL, "Item 3 Market risk", "Item 4: Controls", "short"]
TAIL = ["PART II. Other Information", "Item 1. Legal Proceedings", FILL, "Item 1A. Risk Factors", "none", "Item 6. Exhibits", "list", "SIGNATURES", "someone"]


def test_quarterly_reports(spark):
    running = [*BODY[:4], "Part I. Financial Information (continued)", *BODY[4:], "Part I. Financial Information (continued)"]
    docs = {
        1: CONTENTS + BODY + TAIL,
        2: CONTENTS + running + TAIL,  # running headers, one behind all items of its part
        3: BODY[1:] + TAIL[1:],  # no parts at all
        4: ["Item 1. a", "nothing else"],
        5: [None, "", *TAIL],  # the second part alone
    }
    lines, text = placed(spark, docs)
    got = titles(anchors.quarterly_sections(lines), text)
    whole = [("Part I - Item 1", BODY[1]), ("Part I - Item 2", BODY[4]), ("Part I - Item 3", BODY[7]), ("Part I - Item 4", BODY[8]), ("Part II - Item 1", TAIL[1]), ("Part II - Item 1A", TAIL[3]), ("Part II - Item 6", TAIL[5]), ("SIGNATURE", "SIGNATURES")]
    assert got[1] == got[2] == got[3] == whole
    assert set(got) == {1, 2, 3, 5} and [t for t, _ in got[5]] == ["Part II - Item 1", "Part II - Item 1A", "Part II - Item 6", "SIGNATURE"]


def walk(lines, text_size):
    """The same by going through the lines again and again."""
    one, two, items, signs = [], [], [], []
    for at, line in lines:
        line = line or ""
        if re.search(anchors.PART_ONE_HEADING, line):
            one.append(at)
        if re.search(anchors.PART_TWO_HEADING, line):
            two.append(at)
        if m := re.search(anchors.QUARTERLY_ITEM, line) or re.search(anchors.BARE_ITEM, line):
            items.append((at, m[1].upper()))
        if re.search(anchors.SIGNATURE, line):
            signs.append(at)

    def pick(order, start, end):
        out, at = [], start - 1
        for token in order:
            for a, t in items:
                if t == token and a > at and (end is None or a < end):
                    out.append((a, token))
                    at = a
                    break
        return out

    def behind():
        k = 0
        while k + 1 < len(items) and items[k + 1][0] - items[k][0] < anchors.CONTENTS_SPAN:
            k += 1
        if not items or k < anchors.CONTENTS_RUN:
            return 0
        return items[k][0] + (0 if items[k][1] in {t for _, t in items[:k]} else 1)

    second, first = max(two, default=None), None
    for a in sorted(one, reverse=True):
        if first is None and (second is None or a < second):
            trial = pick(anchors.PART_ONE, a, second)
            ends = [x for x, _ in trial[1:]] + [text_size if second is None else second]
            if sum(e - x >= anchors.LEAST_SPAN for (x, _), e in zip(trial, ends)) >= 2:
                first = a
    if first is not None:
        part = pick(anchors.PART_ONE, first, second)
    else:
        close = second is not None and one and second - min(one) < anchors.CONTENTS_SPREAD
        part = pick(anchors.PART_ONE, behind(), None if close else second)
        part = part if len(part) >= 2 else []
    begin = part[-1][0] + 1 if part else behind() if second is None else second
    marks = [(a, f"Part I - Item {t}") for a, t in part] + [(a, f"Part II - Item {t}") for a, t in pick(anchors.PART_TWO, begin, None)]
    if len(marks) < 3:
        return []
    return sorted(marks + [(s, "SIGNATURE") for s in signs if s > max(marks)[0]][:1])


def test_quarterly_plan_against_a_walk(spark):
    from tabulon import plans
    from tabulon.plans import sectioned
    from tabulon.plans.registry import Tables

    folder, by_doc, got = "/root/testdata/sf0.001", {}, {}
    for r in sectioned.report_lines(Tables(spark, folder), sectioned.QUARTERLY).orderBy("doc_id", "position").collect():
        by_doc.setdefault(r["doc_id"], []).append((r["at"], r["line"]))
    for r in plans.queries()["doc4_quarterly_report"](spark, folder).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["title"]))
    want = {d: w for d, own in by_doc.items() if (w := walk(own, max(a + len(x) for a, x in own)))}
    assert {d: sorted(x) for d, x in got.items()} == want and len(want) > 20


def test_quarterly_reports_against_a_walk(spark):
    rng = random.Random(7)
    kinds = ["PART I FINANCIAL INFORMATION", "PART II OTHER INFORMATION", "Signature", "x" * 90, FILL, "y" * 1100, None, *[f"Item {t}. A" for t in anchors.PART_TWO]]
    docs = {d: [*(CONTENTS if rng.random() < 0.5 else []), *rng.choices(kinds, k=rng.choice([1, 10, 40]))] for d in range(150)}
    lines, text = placed(spark, docs)
    got = {}
    for r in anchors.quarterly_sections(lines).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["title"], r["end"]))
    for d in docs:
        own = sorted((a, x) for (doc, a), x in text.items() if doc == d)
        size = max(a + len(x) for a, x in own if x is not None) if any(x is not None for _, x in own) else 0
        want = walk(own, size)
        assert sorted((a, t) for a, t, _ in got.get(d, [])) == want, d
        assert sorted(e for *_, e in got.get(d, [])) == sorted([a for a, _ in want[1:]] + [size] * bool(want)), d


def test_a_document_with_many_anchors(spark):
    """Thousands of running headers, none of which has two full sections behind it: items aren't read again for each."""
    items = [x for _ in range(1500) for x in ("Item 1. A", "Item 2. A", "Item 3. A", "Part I. Financial Information", "Part I. Financial Information")]
    lines, _ = placed(spark, {1: [*items[:3], FILL, *items[3:], "PART II OTHER INFORMATION", "Item 1. B", "Item 6. B"]})
    start = time.monotonic()
    got = [r["title"] for r in anchors.quarterly_sections(lines).orderBy("start").collect()]
    assert got == ["Part I - Item 1", "Part I - Item 2", "Part I - Item 3", "Part II - Item 1", "Part II - Item 2", "Part II - Item 3", "Part II - Item 6"]
    assert time.monotonic() - start < 60


def test_a_foreign_reports_lines_are_placed_once_for_guides_and_once_for_items(spark):
    from tabulon import plans

    plan = plans.queries()["doc5_foreign_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2


def test_short_headings_of_a_guide_are_whole_words(spark):
    guide = ["3 Key | Risk, 12", "4 Company | Our business, 20", "5 Review | Operating review and prospects, 31", "18 Statements | Accounts, 90"]
    lines, text = placed(spark, {1: [*guide, "Risky", "RISK  of", FILL, "Our business", FILL, "Operating review and prospectss", FILL, "Accounts"]})
    assert titles(anchors.foreign_sections(lines), text)[1] == [("Item 3", "RISK  of"), ("Item 4", "Our business"), ("Item 5", "Operating review and prospectss"), ("Item 18", "Accounts")]


@pytest.mark.parametrize("key_found", [True, False])
def test_foreign_reports_by_number_and_by_guide(spark, key_found):
    guide = ["Form 20-F caption | Location", "Item 3 Key information | Risk factors, 12", "Item 4 Company | Our business in brief, pages 20-30", 'Item 5 Review | "Operating review", 31', "Item 6 Directors | Board and people, 40", "18 Statements | Consolidated accounts, 90"]
    body = ["Risk factors", FILL, "Our business in brief and more", FILL, FILL, "Operating review", FILL, "Board and people", FILL, *(["Consolidated accounts"] if key_found else ["Item 18. Statements"]), FILL, "SIGNATURE"]
    numbered = ["Item 3. Key", FILL, "Item 4. Company", FILL, "Item 5. Review", FILL, "Item 18. Statements", FILL]
    lines, text = placed(spark, {1: [*guide, *body], 2: [*[f"Item {k}. .... {k}" for k in range(1, 9)], FILL, *numbered], 3: guide, 4: ["Item 3. a", FILL, "Item 4. b", FILL, "Item 5. c"]})
    got = titles(anchors.foreign_sections(lines), text)
    assert got[1] == [("Item 3", "Risk factors"), ("Item 4", "Our business in brief and more"), ("Item 5", "Operating review"), ("Item 6", "Board and people"), ("Item 18", body[9]), ("SIGNATURE", "SIGNATURE")]
    assert got[2] == [("Item 3", numbered[0]), ("Item 4", numbered[2]), ("Item 5", numbered[4]), ("Item 18", numbered[6])]
    assert [t for t, _ in got[4]] == ["Item 3", "Item 4", "Item 5"]
