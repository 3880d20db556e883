import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillframe.model import FieldDef, RecordSchema, typed_struct
from quillframe.operators import extraction, sinks
from quillframe.sources.tables import read_csv_table

SIMPLE = RecordSchema(
    "simple",
    (
        FieldDef("name", "string", required=True),
        FieldDef("amount", "number", required=True),
        FieldDef("active", "boolean"),
    ),
)
COMPLEX = RecordSchema(
    "complex",
    (
        FieldDef("title", "string"),
        FieldDef("tags", "array", items=FieldDef("t", "string")),
        FieldDef(
            "meta", "object", properties=(FieldDef("k", "string"), FieldDef("n", "number"))
        ),
    ),
)


def records(spark, schema, rows):
    shape = extraction.record_type(typed_struct(schema))
    return spark.createDataFrame(
        [(f"d{i}", i, f"f{i}.txt", data, status, errors) for i, (data, status, errors) in enumerate(rows, 1)],
        shape,
    )


@pytest.fixture
def with_failure(spark):
    return records(
        spark,
        SIMPLE,
        [
            (("Ada", 10.0, True), "success", []),
            (None, "failed", ["timeout"]),
            (("Bob", 12345678.5, None), "partial", []),
            (("Cy", 1.0, False), "success", []),
        ],
    )


def test_csv(spark, with_failure, tmp_path):
    path = sinks.write_csv(with_failure, SIMPLE, str(tmp_path / "deep" / "out"))
    assert path.endswith("out.csv")
    rows = read_csv_table(spark, path).orderBy("amount").collect()
    assert [r.name for r in rows] == ["Cy", "Ada", "Bob"] and rows[2].active is None
    first_lines = {p.read_text().splitlines()[0] for p in Path(path).glob("part-*")}
    assert first_lines == {"name,amount,active"}


def test_parquet_types_and_nulls(spark, with_failure, tmp_path):
    path = sinks.write_parquet(with_failure, SIMPLE, str(tmp_path / "out.parquet"))
    back = spark.read.parquet(path)
    assert back.dtypes == [("name", "string"), ("amount", "double"), ("active", "boolean")]
    assert back.count() == 3 and back.filter("active IS NULL").count() == 1


def test_nested_values(spark, tmp_path):
    df = records(spark, COMPLEX, [(("T", ["a", "b", "c"], ("v", None)), "success", [])])
    flat = spark.read.parquet(sinks.write_parquet(df, COMPLEX, str(tmp_path / "a"))).first()
    assert json.loads(flat.tags) == ["a", "b", "c"]
    assert json.loads(flat.meta) == {"k": "v", "n": None}
    csv_row = read_csv_table(spark, sinks.write_csv(df, COMPLEX, str(tmp_path / "b"))).first()
    assert json.loads(csv_row.meta) == {"k": "v", "n": None}
    nested = sinks.write_parquet(df, COMPLEX, str(tmp_path / "c"), json_text=False)
    assert spark.read.parquet(nested).first().meta.k == "v"


@pytest.mark.parametrize("name", sinks.FORMATS)
def test_no_records_still_give_a_schema(spark, with_failure, tmp_path, name):
    path = sinks.write_records(with_failure.limit(0), SIMPLE, name, str(tmp_path / "e"))
    df = read_csv_table(spark, path) if name == "csv" else spark.read.parquet(path)
    assert df.columns == ["name", "amount", "active"] and df.count() == 0


def test_unknown_format(with_failure, tmp_path):
    with pytest.raises(ValueError, match="Unknown format 'xml'.*csv, parquet"):
        sinks.write_records(with_failure, SIMPLE, "xml", str(tmp_path / "x"))


def test_missing_and_extra_fields(spark, tmp_path):
    wider = RecordSchema("w", (FieldDef("amount", "number"), FieldDef("other", "string")))
    df = records(spark, SIMPLE, [(("Ada", 10.0, True), "success", [])])
    row = spark.read.parquet(sinks.write_parquet(df, wider, str(tmp_path / "w"))).first()
    assert row.asDict() == {"amount": 10.0, "other": None}


def test_text_dump(with_failure, tmp_path):
    wider = RecordSchema("w", (*SIMPLE.fields, FieldDef("other", "string")))
    lines = sinks.dump_lines(with_failure, wider)
    path = sinks.write_dump(lines, str(tmp_path / "dump"))
    text = "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))
    assert text.splitlines() == [
        "=== Record 1: f1.txt ===", "name: Ada", "amount: 10.0", "active: True", "other: ", "",
        "=== Record 3: f3.txt ===", "name: Bob", "amount: 12345678.5", "active: None", "other: ", "",
        "=== Record 4: f4.txt ===", "name: Cy", "amount: 1.0", "active: False", "other: ", "",
    ]


def test_storage_plan(with_failure):
    plan = sinks.storage_plan(with_failure, threshold=2).first()
    assert plan.asDict() == {
        "record_count": 2, "write_csv": True, "write_parquet": True, "write_text": True
    }
    assert not sinks.storage_plan(with_failure, threshold=3).first().write_parquet
    assert sinks.PARQUET_ADVISED == 500


def test_snapshot(spark, tmp_path):
    heads = spark.createDataFrame([("a", "A"), ("b", "B")], "dataset_id string, name string")
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dataset_id string, n int")
    path = sinks.export_snapshot({"datasets": heads, "documents": docs}, "a", str(tmp_path / "s"))
    found, tables = sinks.import_snapshot(spark, path, ("datasets", "documents"))
    assert found == "a"
    assert tables["documents"].exceptAll(docs.filter("dataset_id = 'a'")).isEmpty()
    assert tables["documents"].count() == 2


def test_bad_snapshots(spark, tmp_path):
    with pytest.raises(ValueError, match="missing datasets"):
        sinks.import_snapshot(spark, str(tmp_path / "none"), ("datasets",))
    two = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    two.write.parquet(str(tmp_path / "two" / "datasets"))
    with pytest.raises(ValueError, match="exactly one"):
        sinks.import_snapshot(spark, str(tmp_path / "two"), ("datasets",))
    two.withColumn("dataset_id", F.lit(None).cast("string")).write.parquet(
        str(tmp_path / "nul" / "datasets")
    )
    with pytest.raises(ValueError, match="exactly one"):
        sinks.import_snapshot(spark, str(tmp_path / "nul"), ("datasets",))
