"""Workspaces over a table of rivers: paging, errors, profiles; then search."""

import pytest
from pyspark.sql import functions as F

from quillframe.operators import search
from quillframe.operators.query import Workspace, column_sketches, profile_of_sketches, profile_table
from quillframe.plans import load_all, questions, render
from quillframe.plans.catalogue import QUERIES

load_all()

RIVERS = [(i, f"river {i:03d}", ["north", "south", "delta"][i % 3], i * 1.5 if i % 4 else None) for i in range(90)]


@pytest.fixture
def ws(spark, tmp_path):
    rivers = spark.createDataFrame(RIVERS, "id long, label string, part string, km double").repartition(5)
    rivers.write.parquet(str(tmp_path / "rivers"))
    made = Workspace(spark)
    made.register_table("rivers", str(tmp_path / "rivers"))
    made.folder = tmp_path
    return made


@pytest.mark.parametrize("offset", [0, 1, 29, 30, 85, 89, 90, 1000])
def test_pages_are_slices_of_the_ordered_result(ws, offset):
    page = ws.execute_sql("SELECT id, id FROM rivers ORDER BY km DESC NULLS LAST, id", 7, offset)
    order = sorted(RIVERS, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    assert page.rows == [[r[0], r[0]] for r in order[offset : offset + 7]]
    assert page.total_rows == 90 and [c.name for c in page.columns] == ["id", "id"]


def test_pages_of_a_grouped_result_fit_together(ws):
    sql = "SELECT part, count(*) AS n FROM rivers GROUP BY part ORDER BY part;"
    parts = [ws.execute_sql(sql, 1, i).rows for i in range(4)]
    assert parts == [[["delta", 30]], [["north", 30]], [["south", 30]], []]


def test_schema_of_a_result_and_of_a_table(ws):
    page = ws.execute_sql("SELECT upper(label) AS u, km / 2 AS half FROM rivers", 1)
    assert [(c.name, c.type) for c in page.columns] == [("u", "string"), ("half", "double")]
    assert [c.name for c in ws.describe("rivers")] == ["id", "label", "part", "km"]
    assert ws.execute_sql('SELECT max("label") FROM rivers').rows == [["river 089"]]


@pytest.mark.parametrize(
    "sql",
    ["SELECT * FROM lakes", "SELECT FROM WHERE", "SELECT depth FROM rivers", "SELECT int(label) FROM rivers",
     "SELECT id / 0 FROM rivers", "SELECT * FROM parquet.`/tmp`"],
)
def test_what_fails_is_an_sql_error(spark, ws, sql):
    with pytest.raises(ValueError, match="SQL error"):
        ws.execute_sql(sql)
    with pytest.raises(ValueError, match="SQL error"):
        Workspace(spark).execute_sql("SELECT * FROM rivers")  # names stay in their workspace


def test_tables_are_replaced_and_bad_ones_refused(ws):
    (ws.folder / "c.csv").write_text("a,b\n1,x\n2,\n")
    ws.register_csv("rivers", str(ws.folder / "c.csv"))
    assert ws.execute_sql("SELECT a FROM rivers WHERE b IS NULL").rows == [[2]]
    with pytest.raises(FileNotFoundError):
        ws.register_table("gone", str(ws.folder / "gone"))
    (ws.folder / "junk.parquet").write_text("not parquet")
    with pytest.raises(ValueError, match="cannot read"):
        ws.register_table("junk", str(ws.folder / "junk.parquet"))


def test_csv_tables_keep_line_breaks_in_quotes(ws):
    (ws.folder / "breaks.csv").write_text('id,note\n1,"a\nb"\n2,c\n')
    ws.register_csv("breaks", str(ws.folder / "breaks.csv"))
    assert ws.execute_sql("SELECT * FROM breaks ORDER BY id").rows == [[1, "a\nb"], [2, "c"]]


def test_profile_has_every_column(ws):
    df = ws.spark.table("rivers").selectExpr(
        "*", "array(id % 2) AS l", "named_struct('a', part) AS s", "map(part, id % 2) AS m", "cast(part AS binary) AS b"
    )
    facts = {r.column_name: r for r in profile_table(df).collect()}
    assert list(facts) == df.columns
    assert (facts["km"].non_null, facts["km"].min_value, facts["km"].max_value) == (67, "1.5", "133.5")
    assert facts["part"].distinct_values == 3 and facts["part"].mean_value is None
    assert [facts[c].distinct_values for c in "lsmb"] == [2, 3, 6, 3]
    assert all(facts[c].non_null == 90 and facts[c].min_value is None for c in "lsmb")


@pytest.fixture
def found(spark):
    docs = spark.createDataFrame(
        [
            ("in/b.txt", "b.txt", "Hit one\nmiss\n  hit two  \n"),
            ("in/a.txt", "a.txt", "miss\nHIT " + "x" * 200),
        ],
        "path string, filename string, content string",
    )
    dump = spark.createDataFrame([(1, "name: hit"), (2, "")], "line_no long, line string")
    return docs, dump


def test_search_order_and_cut(found):
    docs, dump = found
    rows = search.search(docs, "hit", dump).collect()
    assert [(r.origin, r.name, r.line_no) for r in rows] == [
        ("source", "a.txt", 2), ("source", "b.txt", 1), ("source", "b.txt", 3),
        ("extracted", "data.txt", 1),
    ]
    assert len(rows[0].line) == 120 and rows[2].line == "hit two"
    assert len(search.search(docs, "hit", dump, max_results=2).collect()) == 2
    assert search.search(docs, "absent").collect() == []
    whole = search.search(docs, "hit", dump, shown_chars=None).collect()
    assert len(whole[0].line) == 204


def test_bad_pattern(found):
    with pytest.raises(ValueError, match="Invalid regex pattern"):
        search.search(found[0], "(open")


def test_unicode_classes(spark):
    docs = spark.createDataFrame([("p", "f", "été\nETE")], "path string, filename string, content string")
    assert [r.line_no for r in search.search(docs, r"^\w+$").collect()] == [1, 2]
    assert [r.line_no for r in search.search(docs, "ÉTÉ").collect()] == [1]


def test_two_pages_run_the_query_once(ws):
    sql = "SELECT id, km FROM rivers ORDER BY km DESC NULLS LAST, id"
    cursor = ws.cursor(sql)
    assert cursor is ws.cursor(f" {sql}; ") and cursor.total == 90
    rows = [tuple(r) for page in cursor.pages(40) for r in page.collect()]
    assert rows == [tuple(r) for r in ws.query(sql).collect()]
    first = ws.execute_sql(sql, 10, 30)
    assert first.total_rows == 90 and [tuple(r) for r in first.rows] == rows[30:40]
    assert ws.cursor(sql) is cursor
    ws.spark.range(3).write.parquet(str(ws.folder / "rivers2"))
    ws.register_table("rivers", str(ws.folder / "rivers2"))  # what the name meant is gone
    assert ws.cursor("SELECT id FROM rivers ORDER BY id").total == 3 and ws.cursor is not cursor


def test_sketches_merge_to_a_profile(spark):
    df = spark.range(40_000).selectExpr(
        "id % 7 AS part", "id", "id % 500 AS few", "if(id % 2 = 0, null, cast(id AS string)) AS text",
        "array(id % 30) AS list", "cast(null AS double) AS none"
    )
    sketches = column_sketches(df, ["part"])
    assert sketches.count() == 7 * 5
    rows = {r.column_name: r for r in profile_of_sketches(sketches).collect()}
    for name, distinct in (("id", 40_000), ("few", 500), ("text", 20_000), ("list", 30)):
        assert rows[name].distinct_values == pytest.approx(distinct, rel=0.04) and rows[name].rows == 40_000
    assert rows["text"].non_null == 20_000 and rows["text"].median_value is None
    assert rows["id"].median_value == pytest.approx(20_000, rel=0.02)
    assert rows["none"].median_value is None and rows["none"].distinct_values == 0
    some = {r.column_name: r for r in profile_of_sketches(sketches.where("part = 3")).collect()}
    assert some["id"].non_null == df.where("part = 3").count()


def test_recursion_of_any_depth_and_size(spark, tmp_path, monkeypatch):
    """A chain of more than 100 steps, and more than a million rows in all."""
    orders = spark.range(1_000_300).selectExpr(
        "id AS o_orderkey",
        # one customer with 130 orders, one with 20 and some without a price, some without a customer
        "CASE WHEN id < 130 THEN -1 WHEN id < 150 THEN -2 WHEN id < 155 THEN NULL ELSE id END AS o_custkey",
        "CASE WHEN id >= 130 AND id < 150 AND id % 3 = 0 THEN NULL ELSE CAST(id * 7919 % 1009 AS DOUBLE) END AS o_totalprice",
        "timestamp'2024-01-01' AS o_orderdate",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    rows = {r.o_custkey: (r.orders, r.best, r.highs) for r in QUERIES["cte_recursive"](spark, str(tmp_path)).where(
        "o_custkey < 0 OR o_custkey IS NULL OR orders <> 1 OR highs <> 1 OR o_custkey % 100000 = 0"
    ).collect()}

    def chain(ids, price):
        best, highs = price(ids[0]), 1
        for p in map(price, ids[1:]):
            highs += p is not None and best is not None and p > best
            best = max((x for x in (best, p) if x is not None), default=None)
        return len(ids), best, highs

    price = lambda i: float(i * 7919 % 1009)
    assert rows.pop(-1) == chain(range(130), price)
    assert rows.pop(-2) == chain(range(130, 150), lambda i: price(i) if i % 3 else None)
    assert rows.pop(None) == (1, price(150), 1)
    assert rows == {k: (1, price(k), 1) for k in range(100_000, 1_000_001, 100_000)}
    monkeypatch.setattr(questions, "CHAIN_RUN", 9)  # 15 steps
    few = tmp_path / "few"
    spark.read.parquet(str(tmp_path / "orders.parquet")).where("o_custkey < 0").write.parquet(str(few / "orders.parquet"))
    deep = {r.o_custkey: (r.orders, r.best, r.highs) for r in QUERIES["cte_recursive"](spark, str(few)).collect()}
    assert deep == {-1: chain(range(130), price), -2: chain(range(130, 150), lambda i: price(i) if i % 3 else None)}


def test_all_pages_in_one_scan(spark, ws, tmp_path):
    sql = "SELECT id, km, id FROM rivers ORDER BY km DESC NULLS LAST, id"
    cursor = ws.cursor(sql)
    rows = [tuple(r) for r in cursor.pages(7).numbered("at").collect()]
    by_page = [{tuple(r) for r in page.collect()} for page in cursor.pages(7)]
    assert len(rows) == 90 and [{r[1:] for r in rows if r[0] == i} for i in range(13)] == by_page
    orders = spark.range(12_001).selectExpr("id AS o_orderkey", "CAST(id % 4000 AS DOUBLE) AS o_totalprice")
    orders.repartition(3).write.parquet(str(tmp_path / "some" / "orders.parquet"))
    pages = QUERIES["page_cursor"](spark, str(tmp_path / "some"))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("FileScan") == 1  # the plan does not grow with the rows
    assert sorted(map(tuple, pages.collect())) == [(0, 5000, 2333.0, 3999.0), (1, 5000, 666.0, 2333.0), (2, 2001, 0.0, 666.0)]
    orders.limit(0).write.parquet(str(tmp_path / "none" / "orders.parquet"))
    assert QUERIES["page_cursor"](spark, str(tmp_path / "none")).collect() == []


def test_exact_figures_multiply_no_row(spark):
    values = [3.0, 1.0, None, 2.0, 2.0, None, 9.0, -0.0, 0.0]
    df = spark.createDataFrame([(v, str(v)) for v in values], "x double, t string")
    found = questions._exact(df, "x", 2.0)
    assert tuple(found.first()) == ("x", 5, 3, 5)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(questions._exact(df, "t", None).first()) == ("t", 7, 0, 0)
    assert tuple(questions._exact(df.limit(0), "x", 2.0).first()) == ("x", 0, 0, 0)


def test_orders_of_one_row_group_are_rendered_by_many_tasks(spark, tmp_path):
    spark.range(900).selectExpr(
        "id AS o_orderkey", "id % 9 AS o_custkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "timestamp'2024-01-01' AS o_orderdate", "IF(id % 2 = 0, '1-URGENT', '5-LOW') AS o_orderpriority",
    ).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(9).selectExpr("id AS c_custkey", "'n' AS c_name", "'s' AS c_mktsegment").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    made = render.order_documents(spark, str(tmp_path))
    tasks = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == 900
    assert made.where("doc_index IN (1, 2)").count() == 2
