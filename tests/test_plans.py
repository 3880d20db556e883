"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from quillframe.functions import text as tx
from quillframe.operators import search
from quillframe.plans import render
from quillframe.plans.catalogue import QUERIES, workspace
from quillframe.sources import csv_documents, ingest, markdown, plaintext

SF_DIR = "/root/testdata/sf0.001"
PYTHON = re.compile(r"MapInPandas|ArrowEvalPython|BatchEvalPython|MapInArrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(fn(spark, SF_DIR)) for name, fn in QUERIES.items()}


def test_no_pairwise_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_python_only_where_nothing_else_does(plans):
    users = {name for name, text in plans.items() if PYTHON.search(text)}
    assert users <= {"custom_parser", "extract_with_function"}  # user code


def test_parsers_do_not_shuffle(spark, tmp_path):
    spark.createDataFrame([("1", "# a\n\nb")], "document_id string, content string").write.parquet(
        str(tmp_path / "docs")
    )
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for parser in (csv_documents, markdown, plaintext):
        text = plan(parser.blocks(docs))
        assert "Exchange" not in text and not PYTHON.search(text)


def test_filters_and_columns_reach_the_scan(plans):
    text = plans["filter_predicates"]
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in pushed
    assert "In(o_orderstatus, [O,P])" in pushed
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plans["agg_global"]).group(1)
    assert set(scan.split(",")) == {
        "l_quantity:double", "l_extendedprice:double", "l_discount:double"
    }
    count = re.search(r"ReadSchema: struct<([^>]*)>", plans["join_semi"])
    assert "c_acctbal" not in count.group(1)


def test_limits_do_not_sort_everything(plans, spark):
    assert "TakeOrderedAndProject" in plans["topk_orders"]
    ordered = "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey"
    ws = workspace(spark, SF_DIR, "orders")
    for page in (ws.page(ordered, 10, 1000), ws.page(ordered, 10, 10**9)):
        text = plan(page)
        assert "Limit" not in text and "TakeOrdered" not in text, text
    assert "TakeOrderedAndProject" in plan(
        search.search(render.text_documents(spark, SF_DIR), "x")
    )


def test_windows_have_keys(plans):
    """Only the offsets of sorted partitions, one row each, share a task."""
    for name, text in plans.items():
        for window in re.findall(r"Window \[.*", text):
            keyed = re.search(r"windowspecdefinition\((\w+#\d+L?), ", window)
            first_is_order = re.search(r"windowspecdefinition\(\w+#\d+L? ASC", window)
            if first_is_order and not keyed:
                assert "_run#" in window, (name, window)


def test_parsers_share_one_scan(spark):
    """Expression parsers read the files once; the union has no other branch."""
    files = render.text_files(spark, SF_DIR)
    text = plan(ingest.parse(files))
    assert text.count("FileScan") == 1 and "Union" not in text


def test_sample_filters_the_scan(plans):
    assert re.search(r"PushedFilters: \[[^]]*In\(", plans["filter_predicates"])
    assert "Sort" not in plans["extract_sample"]


def test_partial_aggregation_before_shuffles(plans):
    for name in ("agg_group_having", "catalog_current", "extraction_summary", "json_scalar"):
        assert "partial_" in plans[name], name


def test_text_functions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a b",)], "s string")
    assert not PYTHON.search(plan(df.select(tx.strip(df.s), tx.split_lines(df.s), tx.table_name(df.s))))
