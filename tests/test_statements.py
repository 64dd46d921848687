"""Reading statements from tables: periods, numbers, kinds of tables and whole extractions, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.functions import periods
from tabulon.functions.statements import statement_type
from tabulon.operators import statements

CELLS, TABLES = "doc_id long, table int, row int, col int, text string", "doc_id long, table int, caption string, context string"


@pytest.mark.parametrize(
    "text,date,label",
    [
        ("December 31, 2023", "2023-12-31", None),
        ("three months endedSep 2025", "2025-09-30", None),
        ("31-Dez-24", "2024-12-31", None),
        ("2024-02-30 then 2024/03/01", "2024-03-01", None),
        ("31/12/2022 or 12/31/2021", "2022-12-31", None),
        ("03/04/21", "2021-03-04", None),
        ("5 février 2022", "2022-02-05", None),
        ("2019 March 7", "2019-03-07", None),
        ("junio 2020", "2020-06-30", None),
        ("Q3 FY2024", None, ("Q3", 2024)),
        ("2Q71", None, ("Q2", 1971)),
        ("2023 Q4", None, ("Q4", 2023)),
        ("1H 2022", None, ("H1", 2022)),
        ("9M 22", None, ("Q3", 2022)),
        ("fiscal 2022", None, None),
        ("fourth quarter 2021", None, ("Q4", 2021)),
        ("31 Nonsense 2020", None, None),
        (None, None, None),
    ],
)
def test_dates_and_labels(text, date, label):
    assert periods.first_date(text) == (date and dt.date.fromisoformat(date)) and periods.fiscal_label(text) == label


@pytest.mark.parametrize(
    "header,scope,end,fiscal",
    [
        ("2023", "Year ended December 31", "2023-12-31", "FY"),
        ("2023", "Six months ended June 30,", "2023-06-30", "H1"),
        ("2023", "Quarter ended February 30", "2023-02-28", None),
        ("2023", "as of", "2023-12-31", "FY"),
        ("2023", "nothing told", None, None),
        ("Q2 2022", "Year ended December 31, 2021", "2021-12-31", "Q2"),
        ("Q2 2022", "", "2022-06-30", "Q2"),
        ("", "As at 30 September 2020", "2020-09-30", "Q3"),
        ("30 September 2020", "nine months ended", "2020-09-30", "Q3"),
    ],
)
def test_periods_of_columns(header, scope, end, fiscal):
    found = periods.period_end(header, scope)
    assert str(found or "") == (end or "") and (found and periods.fiscal_period(header, scope, found)) == fiscal


def test_numbers_currencies_and_units(spark):
    printed = {"1,234": 1234, "(1,234.5)": -1234.5, "US$1.234,50": 1234.5, "12,5": 12.5, "1,234,567": 1234567, "— ": None, "n/a": None, "5%": 5, "3x": 3, "Net income": None, "−7": -7, "R$ 2": 2, "'12": 12, "": None, None: None, "1e3": 1000, "12 bps": 12, "-": None, "1.2.3": None}
    got = spark.createDataFrame([(k,) for k in printed], "t string").select("t", periods.statement_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == printed
    rows = [("2023", "in HK$ millions"), ("US$", "and HK$"), ("$", ""), ("GBP", "x"), ("2023", "none")]
    code = lambda h, s: periods.printed_currency(F.col(h), F.col(s))
    got = spark.createDataFrame(rows, "h string, s string").select(code("h", "s").alias("p"), periods.currency_code(code("h", "s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("HK$", "HKD"), ("HK$", "HKD"), ("$", "USD"), ("GBP", "GBP"), (None, None)]


def test_kinds_of_tables(spark):
    cases = [
        ("Consolidated Balance Sheets", "", "", "balance_sheet"),
        ("Statements of Operations", "2023 2022", "", "income"),
        ("Statements of cash flows and results of operations", "", "", "cash_flow"),
        ("Balance sheets and results of operations", "", "", None),
        ("", "total assets total liabilities", "", "balance_sheet"),
        ("", "total assets", "", None),
        ("", "balance sheet", "", "balance_sheet"),
        ("", "", "our results of operations", None),
        ("Notes to consolidated financial statements", "", "balance sheet", None),
        ("Table of contents", "net income gross profit revenue", "", None),
        ("Statement of comprehensive income (signatures)", "", "", "comprehensive_income"),
        (None, None, None, None),
    ]
    docs = spark.createDataFrame(cases, "caption string, headers string, context string, want string")
    for r in docs.withColumn("got", statement_type(F.col("caption"), F.col("headers"), F.col("context"))).collect():
        assert r["got"] == r["want"], r


def test_headers_are_read_no_deeper_than_needed():
    """Values of rows aren't read as headers once every column has its period; they are where one has none."""
    heads, scopes, counts = ["2023-12-31", "2023-12-31 7"], ["Balance 2023-12-31"] * 2, [[3], [2]]
    assert len(periods._depths(heads, scopes, counts, [["2023-12-31"], ["2023-12-31 7"]], 2)) == 1
    assert len(periods._depths(["x", "x 7"], ["", ""], counts, [["x"], ["x 7"]], 2)) == 2
    # Two columns of one period, or one that is too thin to be a column of values, leave the next depth open.
    assert len(periods._depths(heads, scopes, [[3, 3], [2, 2]], [["2023", "2023"], ["2023", "2022"]], 2)) == 2
    assert len(periods._depths(heads, scopes, [[3, 1], [2, 1]], [["FY2023", "FY2022"]] * 2, 2)) == 2


def frames(spark, docs):
    """docs: (doc_id, table, caption, context, lines), a line with its cells between bars."""
    cells = [(d, n, r, c, x) for d, n, _, _, lines in docs for r, line in enumerate(lines) for c, x in enumerate(line.split("|"))]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame([x[:4] for x in docs], TABLES)


INCOME = ["Revenue|10|9", "Cost of sales|(4)|(3)", "Net income|6|6"]
DOCS = [
    # A deep header: the year row is below two rows without a period.
    (1, 0, "Statements of operations", None, ["||", "(unaudited)||", "Three months ended|June 30,|June 30,", "|2023|2022", *INCOME]),
    # Two tables of one statement and period are one after the other; a row that comes twice counts once.
    (2, 0, "Statements of income (in millions)", "in US$", ["|FY2023|FY2022", *INCOME]),
    (2, 1, "Statements of income, continued", "in US$", ["|FY2023|FY2022", "Net income|6|6", "Earnings per share|1.5|1,4"]),
    # Fewer rows for other periods: not the statement.
    (2, 2, "Statements of income by half year", "in US$", ["|H1 2023|H2 2023", "Revenue|1|2", "Net income|3|4"]),
    # A currency anywhere above the columns counts for all of them; of two alike columns the first stays.
    (3, 0, "Statements of operations", None, ["|RMB|RMB|US$", "|2022-12-31|2023-12-31|2023-12-31", "Revenue|7|8|1", "Net income|2|3|0.5"]),
    # One column whose period only the context tells.
    (4, 0, "Statement of cash flows", "for the six months ended June 30, 2021", ["|Amount", "Net cash provided|5"]),
    # No period at all.
    (5, 0, "Balance sheets", None, ["|one|two", "Total assets|1|2", "Total equity|3|4"]),
    # No caption: six rows of which two are a balance sheet's.
    (6, 0, None, None, ["As of|31 March 2020", "Total assets|1", "Total equity|2", "a|3", "b|4", "c|5", "d|6"]),
    (7, 0, "Staff", None, ["|2020-12-31", "Men|1", "Women|2"]),
]


def test_whole_statements(spark):
    cells, tables = frames(spark, DOCS)
    cells = cells.where("text <> ''").withColumn("n", F.lit("x")).unionByName(spark.createDataFrame([(9, 0, 0, 3, None)], CELLS), allowMissingColumns=True)
    found = {}
    for r in statements.extract(cells, tables).collect():
        found.setdefault((r["doc_id"], r["statement_type"]), []).append((r["position"], r["label"], str(r["period_end"]), r["fiscal_period"], r["value"], r["currency"], r["units"]))
    assert set(found) == {(1, "income"), (2, "income"), (3, "income"), (4, "cash_flow"), (6, "balance_sheet")}
    assert sorted(found[1, "income"])[:2] == [(0, "Revenue", "2022-06-30", "Q2", 9.0, None, None), (0, "Revenue", "2023-06-30", "Q2", 10.0, None, None)] and len(found[1, "income"]) == 6
    assert {x[1] for x in found[2, "income"]} == {"Revenue", "Cost of sales", "Net income", "Earnings per share"} and len(found[2, "income"]) == 8
    assert {x[5:] for x in found[2, "income"]} == {("USD", "US$ in millions")} and (3, "Earnings per share", "2022-12-31", "FY", 1.4, "USD", "US$ in millions") in found[2, "income"]
    assert {(x[2], x[5]) for x in found[3, "income"]} == {("2022-12-31", "USD"), ("2023-12-31", "USD")}
    assert found[4, "cash_flow"] == [(0, "Net cash provided", "2021-06-30", "H1", 5.0, None, None)]
    assert len(found[6, "balance_sheet"]) == 6 and {x[3] for x in found[6, "balance_sheet"]} == {"Q1"}


def test_reasons(spark):
    cells, tables = frames(spark, DOCS)
    wanted = spark.createDataFrame([(1, "Income"), (1, "income"), (1, "equity"), (5, "balance_sheet"), (8, "income"), (1, "other"), (2, "income")], "doc_id long, statement_type string")
    facts = spark.createDataFrame([(2, "income", "Revenues", dt.date(2023, 12, 31), "FY", 3.0, "USD")], "doc_id long, statement_type string, label string, period_end date, fiscal_period string, value double, currency string")
    values, status = statements.statement_facts(wanted, facts, cells, tables)
    got = {(r["doc_id"], r["statement_type"]): (r["data_quality"], r["reason"]) for r in status.collect()}
    assert got == {
        (1, "income"): ("extracted", None), (1, "equity"): (None, "statement_not_found"), (5, "balance_sheet"): (None, "low_confidence_extraction"),
        (8, "income"): (None, "xbrl_not_available"), (1, "other"): (None, "unsupported_statement_type"), (2, "income"): ("xbrl", None),
    }
    assert [r["label"] for r in values.where("doc_id = 2").collect()] == ["Revenues"]


def test_nothing_to_read(spark):
    cells, tables = frames(spark, DOCS)
    assert statements.extract(cells.limit(0), tables).count() == 0
