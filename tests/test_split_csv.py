"""CSV read in splits, against the reader of whole texts and Spark's own."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.sources import csv_documents, split_csv
from quillframe.sources.tables import read_csv_table

PIECES = ["a", "b1", ",", ",", '"', '""', '",', ',"', "\n", "\n", "\r\n", "é", " "]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_records_equal_those_of_whole_texts(spark, tmp_path, small_splits):
    """Random texts, torn quotes and all, cut into splits of 40 bytes."""
    rng = random.Random(11)
    texts = {}
    for i in range(40):
        text = "".join(rng.choices(PIECES, k=rng.choice([0, 1, 30, 200])))
        (tmp_path / f"t{i:03}.csv").write_bytes(text.encode())
        texts[f"t{i:03}.csv"] = text
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    want = {r.name: r.records for r in df.select("name", csv_documents.records(F.col("text")).alias("records")).collect()}
    found = {name: {} for name in texts}
    for r in split_csv.numbered_records(spark, str(tmp_path)).collect():
        found[r.path.rsplit("/", 1)[1]][r.record_no] = r.record
    for name, records in want.items():
        assert found[name] == {i + 1: r for i, r in enumerate(records)}, repr(texts[name])


def test_table_equals_sparks_reader(spark, tmp_path, small_splits):
    rows = [(i, f'line {i}\nsecond "quoted" line' if i % 3 else f"plain {i}", i / 4 if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, note string, price double").coalesce(1)
    path = str(tmp_path / "t")
    df.write.option("header", True).option("escape", '"').csv(path)
    records = split_csv.numbered_records(spark, path)
    table = split_csv.read_split_csv(spark, path)
    assert table.schema.simpleString() == "struct<id:int,note:string,price:double>"
    whole = read_csv_table(spark, path)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, whole.collect())) == sorted(rows)
    assert records.count() == 201
    given = split_csv.read_split_csv(spark, path, df.schema)
    assert given.schema == df.schema and sorted(map(tuple, given.collect())) == sorted(rows)
    assert spark.read.options(**split_csv.LINES).text(path).rdd.getNumPartitions() > 50  # one file, many tasks


def test_blocks_equal_those_of_whole_documents(spark, tmp_path, small_splits):
    text = 'name,"long\nhead"\n' + "".join(f'r{i},"a,\n\n{i}""x"""\n' for i in range(30))
    (tmp_path / "f.csv").write_text(text)
    doc = spark.createDataFrame([("d", text)], "document_id string, content string")
    want = [tuple(r)[1:] for r in csv_documents.blocks(doc).orderBy("block_index").collect()]
    assert [tuple(r)[1:] for r in split_csv.blocks(spark, str(tmp_path)).orderBy("block_index").collect()] == want


def test_empty_files_and_headers_alone(spark, tmp_path, small_splits):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text("")
    assert split_csv.numbered_records(spark, str(tmp_path / "e")).collect() == []
    assert split_csv.read_split_csv(spark, str(tmp_path / "e")).columns == []
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.csv").write_text("x,y")
    table = split_csv.read_split_csv(spark, str(tmp_path / "h"))
    assert table.columns == ["x", "y"] and table.collect() == []


def test_types_are_the_narrowest_that_fit(spark):
    df = spark.createDataFrame(
        [("1", "5000000000", "1.5", "2020-01-31", "true", "x", None), ("2", "1", "2", "2021-05-06", "false", "1", None)],
        "a string, b string, c string, d string, e string, f string, g string",
    )
    kinds = [f.dataType.simpleString() for f in split_csv.infer_types(df)]
    assert kinds == ["int", "bigint", "double", "date", "boolean", "string", "string"]
