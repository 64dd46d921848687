"""Statements of customers: printed as tables of a report, and read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import statements
from tabulon.plans.registry import Tables, plan


def yearly(t: Tables) -> DataFrame:
    """(doc_id, years): a customer's three last years with orders, the last first, as structs of year, revenue, orders.
    Dealt by customer once, which all that follows keeps;
    to a stated number of partitions, since reading a few bytes of orders as tables is much work."""
    orders = t.orders.select(F.col("o_custkey").cast("long").alias("doc_id"), F.year("o_orderdate").alias("year"), F.round("o_totalprice").cast("long").alias("price")).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    of_year = orders.groupBy("doc_id", "year").agg(F.sum("price").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return of_year.groupBy("doc_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("year", "revenue", "orders")))), 1, 3).alias("years"))


def money(n: Column) -> Column:
    """1,234 or (1,234), and a dash for nothing."""
    return F.when(n == 0, "—").when(n < 0, F.concat(F.lit("("), F.format_number(-n, 0), F.lit(")"))).otherwise(F.format_number(n, 0))


#: Rows of the two statements: the label and its value.
INCOME = {
    "Total revenue": "revenue",
    "Cost of sales": "-(revenue * 6 div 10)",
    "Gross profit": "revenue - revenue * 6 div 10",
    "Operating income": "revenue div 5 - orders * 9000",
    "Net income": "revenue div 10 - orders * 9000",
}
BALANCE = {
    "Cash": "orders",
    "Current assets": "revenue div 4",
    "Total assets": "revenue div 2",
    "Current liabilities": "revenue div 8",
    "Total liabilities": "revenue div 3",
    "Total equity": "revenue div 2 - revenue div 3",
}


def printed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Cells and tables: statements of income whose headers say the year in four ways, with a column of the notes between,
    and, of every third customer, a balance sheet that only its rows tell."""
    docs = yearly(t)
    year, way = F.col("year").cast("string"), F.col("doc_id") % 4
    column = (2 + F.col("at") * 2).cast("int")
    upper = F.when(way == 0, "Year ended December 31,").otherwise("Amount")
    lower = F.when(way == 0, year).when(way == 1, F.concat(F.lit("FY"), year)).when(way == 2, F.concat(F.lit("31 December "), year)).otherwise(F.concat(F.lit("December 31, "), year))

    def laid(table: int, top: list[tuple[int, Column]], rows: dict[str, str], first: int) -> Column:
        at = lambda r, c, text: F.struct(F.lit(table).alias("table"), F.lit(r).alias("row"), c.cast("int").alias("col"), text.alias("text"))
        values = [at(r, column, text) for r, text in top] + [at(first + k, column, money(F.expr(n))) for k, n in enumerate(rows.values())]
        labels = [at(first + k, F.lit(0), F.lit(label)) for k, label in enumerate(rows)] + [at(first, F.lit(1), F.lit("(note)"))]
        return F.concat(F.array(*values), F.when(F.col("at") == 0, F.array(*labels)).otherwise(F.array(*labels[:0]).cast("array<struct<table:int,row:int,col:int,text:string>>")))

    income = laid(0, [(0, upper), (1, lower)], INCOME, 2)
    balance = laid(1, [(0, F.concat(F.lit("As of December 31, "), year))], BALANCE, 1)
    years = docs.select("doc_id", F.posexplode("years").alias("at", "y")).select("doc_id", "at", "y.*")
    cells = years.select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.concat(income, balance)).otherwise(income)).alias("c")).select("doc_id", "c.*")
    named = lambda table, caption, context: F.struct(F.lit(table).alias("table"), F.lit(caption).alias("caption"), F.lit(context).cast("string").alias("context"))
    one, two = named(0, "Consolidated statements of operations for the fiscal year (US$ in thousands)", None), named(1, "Overview", "Amounts in US$")
    tables = docs.select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one))).alias("t")).select("doc_id", "t.*")
    return cells, tables


YEARLY_SQL = """WITH y AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, year(o_orderdate) AS year, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue, count(*) AS orders FROM orders GROUP BY 1, 2),
last AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY year DESC) AS r FROM y QUALIFY r <= 3)"""


@plan(f"""{YEARLY_SQL},
rows AS (
  SELECT doc_id, year, 'income' AS statement_type, 'FY' AS fiscal_period, 'US$ in thousands' AS units, 'thousands' AS scale,
    unnest([{{'position': 0, 'label': 'Total revenue', 'n': revenue}}, {{'position': 1, 'label': 'Cost of sales', 'n': -(revenue * 6 // 10)}}, {{'position': 2, 'label': 'Gross profit', 'n': revenue - revenue * 6 // 10}},
      {{'position': 3, 'label': 'Operating income', 'n': revenue // 5 - orders * 9000}}, {{'position': 4, 'label': 'Net income', 'n': revenue // 10 - orders * 9000}}]) AS x FROM last
  UNION ALL SELECT doc_id, year, 'balance_sheet', 'FY', 'US$', NULL,
    unnest([{{'position': 0, 'label': 'Cash', 'n': orders}}, {{'position': 1, 'label': 'Current assets', 'n': revenue // 4}}, {{'position': 2, 'label': 'Total assets', 'n': revenue // 2}},
      {{'position': 3, 'label': 'Current liabilities', 'n': revenue // 8}}, {{'position': 4, 'label': 'Total liabilities', 'n': revenue // 3}}, {{'position': 5, 'label': 'Total equity', 'n': revenue // 2 - revenue // 3}}]) FROM last WHERE doc_id % 3 = 0)
SELECT doc_id, statement_type, x.label AS label, CAST(x.position AS INTEGER) AS position, CAST(make_date(year, 12, 31) AS VARCHAR) AS period_end, fiscal_period, CAST(year AS INTEGER) AS fiscal_year, CAST(x.n AS DOUBLE) AS value, 'USD' AS currency, units, scale
FROM rows WHERE x.n <> 0""")
def doc9_statements(t: Tables) -> DataFrame:
    cells, tables = printed(t)
    return statements.extract(cells, tables).withColumn("period_end", F.col("period_end").cast("string"))


@plan("""WITH o AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS doc_id FROM orders),
w AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, kind AS statement_type FROM customer, (VALUES ('income'), ('balance_sheet'), ('cash_flow'), ('segments')) AS kinds(kind))
SELECT w.doc_id, statement_type,
  CASE WHEN statement_type = 'income' AND w.doc_id % 5 = 0 THEN 'xbrl' WHEN (statement_type = 'income' OR (statement_type = 'balance_sheet' AND w.doc_id % 3 = 0)) AND o.doc_id IS NOT NULL THEN 'extracted' END AS data_quality,
  CASE WHEN statement_type = 'income' AND (w.doc_id % 5 = 0 OR o.doc_id IS NOT NULL) THEN NULL WHEN statement_type = 'balance_sheet' AND w.doc_id % 3 = 0 AND o.doc_id IS NOT NULL THEN NULL
    WHEN statement_type = 'segments' THEN 'unsupported_statement_type' WHEN o.doc_id IS NULL THEN 'xbrl_not_available' ELSE 'statement_not_found' END AS reason
FROM w LEFT JOIN o USING (doc_id)""")
def doc9_reasons(t: Tables) -> DataFrame:
    """What each customer's statements come from: tagged facts of every fifth, else tables, else a reason."""
    cells, tables = printed(t)
    keys = t.customer.select(F.col("c_custkey").cast("long").alias("doc_id"))
    wanted = keys.select("doc_id", F.explode(F.array(*map(F.lit, ["income", "balance_sheet", "cash_flow", " Segments "]))).alias("statement_type"))
    facts = keys.where("doc_id % 5 = 0").select("doc_id", F.lit("income").alias("statement_type"), F.lit("Revenues").alias("label"), F.lit(None).cast("date").alias("period_end"), F.lit("FY").alias("fiscal_period"), F.lit(1.0).alias("value"), F.lit("USD").alias("currency"))
    return statements.statement_facts(wanted, facts, cells, tables)[1]
