"""What plans do with whole texts, with parts that are dealt alike, and with ties."""

import duckdb
from pyspark.sql import functions as F

from tabulon import plans
from tabulon.operators import section_tree
from tabulon.plans import quality


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_dealt_by_document_are_dealt_again(spark):
    """Headings from a window and sizes from an aggregate are both dealt by document, and then merged unlike."""
    lines = spark.range(1000).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("at")).repartition("doc_id")
    headings = lines.where("at % 3 = 0").select("doc_id", "at", F.lit(1).alias("level"), F.lit("x").alias("title"))
    sizes = lines.groupBy("doc_id").agg(F.max("at").alias("size"))
    tree = section_tree.section_tree(headings, lines.where("at % 4 = 0").select("doc_id", F.col("at").alias("table"), "at"), sizes)
    assert "hashpartitioning(hash(doc_id" in executed(tree)
    assert tree.agg(F.sum(F.size("tables"))).first()[0] == sum(i % 4 == 0 and i >= min(j for j in range(i % 7, 1000, 7) if j % 3 == 0) for i in range(1000))


def test_words_of_whole_texts_need_no_exchange(spark, tmp_path):
    duckdb.sql("SELECT * FROM (VALUES (1::BIGINT, 'a b  A a_2 '), (1, ''), (NULL, 'x X x'), (2, NULL)) v(doc_id, text)").write_parquet(str(tmp_path / "documents.parquet"))
    got = plans.queries()["arr1_unique_words"](spark, str(tmp_path))
    assert "Exchange" not in executed(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b  a_2 a_2 _2"), (1, ""), (None, "x x_2 x_3")], key=str)


def test_labels_of_one_row_number_come_as_in_the_table(spark, tmp_path):
    duckdb.sql("SELECT * FROM (VALUES (1::BIGINT, 3, 5::BIGINT, 'R', 'O'), (1, 3, 5, 'A', 'O'), (1, NULL, 5, 'N', 'O'), (1, 2, NULL, 'Z', 'O')) v(l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus)").write_parquet(str(tmp_path / "lineitem.parquet"))
    got = plans.queries()["arr8_row_labels"](spark, str(tmp_path)).collect()
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert [tuple(r) for r in got] == con.execute(plans.oracle_sql()["arr8_row_labels"]).fetchall() == [(1, "Z,R,A,N")]


def test_labels_of_one_row_number_come_as_in_the_files_of_the_table(spark, tmp_path):
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, rows in (("a", "(2::BIGINT, 1, 5::BIGINT, 'X', 'O'), (1, 3, 5, 'R', 'O')"), ("b", "(1::BIGINT, 3, 5::BIGINT, 'A', 'O')")):
        duckdb.sql(f"SELECT * FROM (VALUES {rows}) v(l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus)").write_parquet(str(folder / f"{name}.parquet"))
    got = plans.queries()["arr8_row_labels"](spark, str(tmp_path)).collect()
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(plans.oracle_sql()["arr8_row_labels"]).fetchall()) == [(1, "R,A"), (2, "X")]


def test_statement_groups_are_dealt_once_over_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    duckdb.sql("SELECT CASE WHEN i % 11 > 0 THEN i // 6 % 200 END AS l_orderkey, i % 5 AS l_partkey, (i % 3)::DOUBLE AS l_quantity, ['A', 'N', NULL][1 + i % 3] AS l_returnflag, ['F', 'O'][1 + i % 2] AS l_linestatus FROM range(3000) r(i)").write_parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(quality, "ORDER_ROWS", 100)
    got = plans.queries()["agg18_statement_group"](spark, str(tmp_path))
    assert executed(got).count("Exchange") == 1
    assert got.rdd.getNumPartitions() == 31
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(plans.oracle_sql()["agg18_statement_group"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 201
