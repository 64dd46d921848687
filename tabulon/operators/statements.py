"""Financial statements out of the cell matrices of report tables.

Everything of a table is put together once, as an array of its rows; what follows goes by rows of columns and periods, so
that a document with many tables is as many rows, and the only exchanges are by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import periods, statements
from tabulon.functions.columns import collapsed

# Rows looked at for the header, its depth where no row looks like data, cells to the left that head a
# column too, cells that may hold a row's label, rows with a number that make a column of values, characters of context.
HEADER_ROWS, DEFAULT_HEADER, LOOK_LEFT, LABEL_CELLS, VALUE_ROWS, CONTEXT_CHARS = 8, 3, 2, 6, 2, 240
# Words in the label of a header row.
HEADER_WORDS = ("as of", "as at", "ended", "unaudited", "note")
TABLE = ["doc_id", "table"]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once: Spark doesn't copy them into the filters and columns that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def matrices(cells: DataFrame) -> DataFrame:
    """(doc_id, table, m, width): rows in order, each a struct of what is asked of it at any depth of the header.

    texts and numbers: of its cells, without gaps; label, said: its first words, and all of its texts; heads: what stands
    in each column or in the cells before it; data: whether it looks like a row of data.
    """
    cells = cells.select(*TABLE, "row", "col", collapsed(F.coalesce("text", F.lit(""))).alias("text"))
    cells = once(cells, number=periods.statement_number(F.col("text")))
    rows = cells.groupBy(*TABLE, "row").agg(F.max("col").cast("int").alias("last"), F.map_from_entries(F.collect_list(F.struct("col", F.struct("text", "number")))).alias("at"))
    empty = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("number"))
    rows = once(rows, cells=F.transform(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long")), lambda c: F.coalesce(F.try_element_at("at", c), empty)))
    rows = once(rows.drop("at"), texts=F.transform("cells", lambda c: c["text"]), numbers=F.transform("cells", lambda c: c["number"]), label=label(F.col("cells")))
    rows = once(rows.drop("cells"), said=F.array_join(F.filter("texts", lambda t: t != ""), " "), heads=heads(F.col("texts"), F.col("last")), data=like_data(F.col("label"), F.col("numbers")))
    row = F.struct("row", "texts", "numbers", "label", "said", "heads", "data")
    return rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(row)).alias("m"), (F.max("last") + 1).alias("width"))


def label(row: Column) -> Column:
    """The first of a row's cells that has words."""
    return F.get(F.filter(F.slice(row, 1, LABEL_CELLS), lambda c: (c["text"] != "") & (F.lower(c["text"]) != "nan") & c["number"].isNull()), F.lit(0))["text"]


def like_data(label: Column, numbers: Column) -> Column:
    """A row with a label that is no header's, and numbers that aren't all years."""
    said = F.lower(F.coalesce(label, F.lit("")))
    heading = F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(said, w))
    found = F.filter(F.slice(numbers, 2, F.size(numbers)), lambda x: x.isNotNull())
    years = F.forall(found, lambda x: (x == F.floor(x)) & x.between(1900, 2100))
    return (said != "") & ~heading & (F.size(found) > 0) & ~years


def heads(texts: Column, last: Column) -> Column:
    """For each column, and as many beyond the row's last as its texts reach, the nearest text in it or before it."""
    window = lambda c: F.get(F.filter(F.reverse(F.slice(texts, F.greatest(F.lit(1), c + 1 - LOOK_LEFT), F.least(c + 1, F.lit(LOOK_LEFT + 1)))), lambda t: t != ""), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last + LOOK_LEFT), window)


def candidates(tables: DataFrame) -> DataFrame:
    """``options``: an array of the depths of the header that a table may have, from the first row that looks like data to
    HEADER_ROWS, each with its headers and, for each column with numbers below it, how many and what stands above."""
    n = F.size("m")
    first = F.array_position(F.slice(F.col("m")["data"], 1, HEADER_ROWS), True).cast("int") - 1
    inferred = F.when(first >= 0, F.greatest(F.lit(1), first)).otherwise(F.least(F.lit(DEFAULT_HEADER), n - 1))
    deep = F.greatest(inferred, F.least(n - 1, F.lit(HEADER_ROWS)))
    made = once(tables.where(n > 1), depths=F.filter(F.sequence(inferred, deep), lambda d: d < n), values=F.col("m")["numbers"], said=F.col("m")["said"], heads=F.col("m")["heads"])
    numbers = lambda d, c: F.size(F.filter(F.slice("values", d + 1, n), lambda row: F.get(row, c).isNotNull()))
    filled = lambda d: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("width") - 1)), lambda c: F.struct(c.alias("col"), numbers(d, c).alias("n"))), lambda x: x["n"] > 0)
    headers = lambda d: F.array_join(F.filter(F.slice("said", F.lit(1), d), lambda t: t != ""), " ")
    made = once(made, options=F.transform("depths", lambda d: F.struct(d.alias("depth"), headers(d).alias("headers"), filled(d).alias("filled"))))
    # What stands above a column in each header row, or in the cell before it, said once.
    above = lambda d, c: F.array_join(F.array_distinct(F.filter(F.transform(F.slice("heads", F.lit(1), d), lambda row: F.get(row, c)), lambda t: t.isNotNull())), " ")
    columns = lambda o: F.transform(o["filled"], lambda x: F.struct(x["col"].alias("col"), x["n"].alias("n"), above(o["depth"], x["col"]).alias("header")))
    scope = lambda o: collapsed(F.concat_ws(" ", F.right(collapsed(F.coalesce("context", F.lit(""))), F.lit(CONTEXT_CHARS)), "caption", o["headers"]))
    held = F.filter("options", lambda o: F.size(o["filled"]) > 0)
    return once(made, opened=F.transform(held, lambda o: F.struct(o["depth"].alias("depth"), o["headers"].alias("headers"), scope(o).alias("scope"), columns(o).alias("columns")))).select(*tables.columns, F.col("opened").alias("options"))


def parsed(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """The best reading of each table: ``cells(doc_id, table, row, col, text)`` with ``tables(doc_id, table, caption,
    context)`` -> ``(doc_id, table, caption, context, headers, depth, periods, rows)``.

    periods: array<struct<col, period_end, fiscal_period, currency>>; rows: array<struct<label, values>> with a value or
    null for each period. Of the depths of its header that give periods and rows the one with most periods, then most
    rows, then the least depth is kept; a table without any isn't returned. Null texts are empty cells.
    """
    known = tables.select(*TABLE, "caption", "context").dropDuplicates(TABLE)
    made = candidates(matrices(cells).join(known, TABLE, "left")).where("size(options) > 0")
    made = made.withColumn("told", periods.periods_of_depths(F.col("options")["headers"], F.col("options")["scope"], F.transform("options", lambda o: o["columns"]["n"]), F.transform("options", lambda o: o["columns"]["header"]), VALUE_ROWS))
    made = made.select(*TABLE, "m", "caption", "context", F.posexplode("told").alias("at", "told"), "options")
    made = once(made, o=F.get("options", F.col("at"))).select(*TABLE, "caption", "context", "m", "told", "o.depth", "o.headers", "o.scope", F.col("o.columns").alias("above"))
    each = F.transform(F.arrays_zip("above", F.col("told.columns").alias("own")), lambda x: F.struct(x["above"]["col"].alias("col"), x["above"]["n"].alias("n"), x["above"]["header"].alias("header"), x["own"].alias("own")))
    made = once(made, each=each, body=F.slice("m", F.col("depth") + 1, F.size("m"))).drop("m", "above")
    made = once(made, many=F.filter("each", lambda x: x["n"] >= VALUE_ROWS))
    # Columns with two numbers; else, below a header with a period, with one; else the only one, if the scope has a period.
    chosen = F.when(F.size("many") > 0, F.col("many")).when(F.col("told.dated"), F.col("each")).when(F.col("told.scope.period_end").isNotNull() & (F.size("each") == 1), F.col("each"))
    made = once(made, chosen=chosen).where("chosen IS NOT NULL")

    # A column on its own may have its period from the scope alone.
    period = lambda x: F.when(x["own"]["period_end"].isNotNull() | (F.size("chosen") != 1), x["own"]).otherwise(F.col("told.scope"))
    found = F.filter(F.transform("chosen", lambda x: F.struct(x["col"].alias("col"), x["header"].alias("header"), period(x).alias("p"))), lambda x: x["p"]["period_end"].isNotNull())
    made = once(made, found=found).where("size(found) > 0")
    named = F.transform("found", lambda x: F.struct(x["col"].alias("col"), F.struct(x["p"]["period_end"].alias("period_end"), x["p"]["fiscal_period"].alias("fiscal_period"), periods.printed_currency(x["header"], F.col("scope")).alias("currency")).alias("p")))
    made = once(made, named=named)
    # Of columns that are alike in all that is told the first.
    firsts = F.filter("named", lambda x, i: F.array_position(F.col("named")["p"], x["p"]) == i + 1)
    made = once(made, periods=F.transform(firsts, lambda x: F.struct(x["col"].alias("col"), x["p"]["period_end"].alias("period_end"), x["p"]["fiscal_period"].alias("fiscal_period"), x["p"]["currency"].alias("currency"))))
    lines = F.transform("body", lambda row: F.struct(row["label"].alias("label"), F.transform("periods", lambda p: F.get(row["numbers"], p["col"])).alias("values")))
    read = once(made, rows=F.filter(lines, lambda r: r["label"].isNotNull() & F.exists(r["values"], lambda v: v.isNotNull()))).where("size(rows) > 0")
    best = F.max_by(F.struct("caption", "context", "headers", "depth", "periods", "rows"), F.struct(F.size("periods"), F.size("rows"), -F.col("depth")))
    return read.groupBy(*TABLE).agg(best.alias("b")).select(*TABLE, "b.*")


def aligned(values: Column, source: Column, target: Column) -> Column:
    """The values whose period, by end and fiscal period, is one of the target's."""
    same = lambda p: F.exists(target, lambda t: (t["period_end"] == p["period_end"]) & t["fiscal_period"].eqNullSafe(p["fiscal_period"]))
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), source.alias("p")), lambda x: same(x["p"])), lambda x: x["v"])


def candidate_tables(read: DataFrame) -> DataFrame:
    """(statement_type, ...) for the tables that may be part of each statement of a document: those classified as it,
    else those with enough of its rows, else with enough rows by the relaxed patterns."""
    labels = statements.plain(F.array_join(F.col("rows")["label"], " "))
    kind = statements.statement_type(F.col("caption"), F.col("headers"), F.col("context"))
    options = []
    for name in statements.NAMES:
        strict, relaxed = statements.hits(F.col("labels"), statements.ROWS[name]), statements.hits(F.col("labels"), statements.RELAXED_ROWS[name])
        enough = F.size("rows") >= statements.LEAST_ROWS
        way = F.when(F.col("kind") == name, 1).when(enough & (strict >= statements.ROW_HITS), 2).when(enough & (relaxed >= statements.RELAXED_HITS), 3)
        options.append(F.struct(F.lit(name).alias("statement_type"), way.alias("way")))
    found = once(read, kind=kind, labels=labels)
    found = found.select("*", F.explode(F.array(*options)).alias("o")).select(*read.columns, "o.*").where("way IS NOT NULL")
    first = Window.partitionBy("doc_id", "statement_type")
    return found.withColumn("best", F.min("way").over(first)).where("way = best").drop("best")


def extract(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Statements of each document: ``(doc_id, statement_type, label, position, period_end, fiscal_period, fiscal_year,
    value, currency, units, scale)``, a row for each value.

    The tables of a statement are grouped by their periods in its main currency (the one of most columns, then by name);
    the group with most rows, then tables, then periods is the statement, then the one of the first table. Its rows are
    those of its tables in order, alike ones once. A statement without a table has no rows; see ``reasons``.
    """
    found = candidate_tables(parsed(cells, tables))
    of = ["doc_id", "statement_type"]
    # The currencies that tables print are few, so each is counted beside the tables.
    of_statement = Window.partitionBy(*of)
    printed = lambda code: F.sum(F.size(F.filter("periods", lambda p: p["currency"] == code))).over(of_statement)
    counts = F.array(*[F.struct((-printed(code)).alias("n"), F.lit(code).alias("currency")) for code in periods.PRINTED])
    found = found.withColumn("counts", counts).withColumn("main", F.array_min(F.filter("counts", lambda x: x["n"] < 0))["currency"]).drop("counts")
    mine = F.filter("periods", lambda p: F.col("main").isNull() | (p["currency"] == F.col("main")))
    found = once(found, target=F.when(F.size(mine) > 0, mine).otherwise(F.col("periods")))
    signature = F.transform("target", lambda p: F.struct(p["period_end"], p["fiscal_period"]))
    clipped = F.filter(F.transform("rows", lambda r: F.struct(r["label"].alias("label"), aligned(r["values"], F.col("periods"), F.col("target")).alias("values"))), lambda r: F.exists(r["values"], lambda v: v.isNotNull()))
    found = once(found, signature=signature, clipped=clipped, scale=periods.printed_scale(F.col("caption"))).drop("rows").withColumnRenamed("clipped", "rows").where("size(rows) > 0")
    first_scale = F.min_by("scale", "table").over(of_statement)
    found = found.withColumn("scale", first_scale)
    groups = found.groupBy(*of, "main", "scale", "signature").agg(
        F.array_sort(F.collect_list(F.struct("table", "rows"))).alias("parts"), F.min("table").alias("first"), F.sum(F.size("rows")).alias("n_rows"), F.count(F.lit(1)).alias("n_tables")
    )
    rank = F.struct("n_rows", "n_tables", F.size("signature"), -F.col("first"))
    best = groups.groupBy(*of).agg(F.max_by(F.struct("main", "scale", "signature", "parts"), rank).alias("b")).select(*of, "b.*")
    lines = best.withColumn("rows", F.array_distinct(F.flatten("parts.rows"))).select(*of, "main", "scale", "signature", F.posexplode("rows").alias("position", "row"))
    cellwise = lines.select(*of, "main", "scale", "position", F.col("row.label").alias("label"), F.explode(F.arrays_zip("signature", F.col("row.values").alias("values"))).alias("x"))
    return cellwise.select(
        *of, "label", "position", F.col("x.signature.period_end").alias("period_end"), F.col("x.signature.fiscal_period").alias("fiscal_period"), F.year("x.signature.period_end").alias("fiscal_year"),
        F.col("x.values").alias("value"), periods.currency_code(F.col("main")).alias("currency"), periods.units_label(F.col("main"), F.col("scale")).alias("units"), "scale",
    ).where("value IS NOT NULL")


def statement_facts(wanted: DataFrame, facts: DataFrame, cells: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each document states, first success wins, and why there is nothing else.

    ``wanted(doc_id, statement_type)`` against tagged ``facts(doc_id, statement_type, label, period_end, fiscal_period,
    value, currency)``, which come first (quality ``xbrl``), then the tables (``extracted``). The second frame has
    ``(doc_id, statement_type, data_quality, reason)`` for each wanted statement: reason is null, unsupported_statement_type,
    statement_not_found (tables, but none of this statement), low_confidence_extraction (candidates, but no periods in
    common) or xbrl_not_available (no tables either).
    """
    of = ["doc_id", "statement_type"]
    wanted = wanted.select("doc_id", F.lower(F.trim("statement_type")).alias("statement_type")).distinct()
    tagged = facts.join(wanted, of, "left_semi")
    open_ = wanted.join(facts.select(*of).distinct(), of, "left_anti")
    read = extract(cells, tables).join(open_, of, "left_semi")
    columns = [*of, "label", "period_end", "fiscal_period", "value", "currency"]
    values = tagged.select(*columns, F.lit("xbrl").alias("data_quality")).unionByName(read.select(*columns, F.lit("extracted").alias("data_quality")))
    status = wanted.join(values.groupBy(*of).agg(F.max("data_quality").alias("data_quality")), of, "left")
    has_tables = tables.select("doc_id", F.lit(True).alias("has_tables")).distinct()
    named = tables.select("doc_id", statements.statement_type(F.col("caption"), F.lit(""), F.col("context")).alias("statement_type"), F.lit(True).alias("named")).where("statement_type IS NOT NULL").distinct()
    status = status.join(has_tables, "doc_id", "left").join(named, of, "left")
    reason = (
        F.when(F.col("data_quality").isNotNull(), None)
        .when(~F.col("statement_type").isin(list(statements.NAMES)), "unsupported_statement_type")
        .when(F.col("has_tables").isNull(), "xbrl_not_available")
        .when(F.col("named"), "low_confidence_extraction")
        .otherwise("statement_not_found")
    )
    return values, status.select(*of, "data_quality", reason.alias("reason"))
