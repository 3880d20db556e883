"""Members beyond the schema keep their types and places."""

import json

import pytest

from quillframe.model import FieldDef, RecordSchema
from quillframe.operators.open_members import with_open_members

SCHEMA = RecordSchema(
    name="trip",
    fields=[
        FieldDef(name="id", type="number"),
        FieldDef(name="free", type="object"),
        FieldDef(name="who", type="object", properties=[FieldDef(name="name", type="string")]),
        FieldDef(
            name="legs",
            type="array",
            items=FieldDef(name="leg", type="object", properties=[FieldDef(name="to", type="string")]),
        ),
    ],
)


def case(text, expected):
    return pytest.param(text, expected, id=str(text)[:40])


CASES = [
    case('{"id": 1, "free": {"any": 1}, "who": {"name": "a"}, "legs": [{"to": "b"}]}', None),
    case('{"id": 1, "paid": true, "cost": 2.5, "n": null, "s": "12"}', {"paid": True, "cost": 2.5, "n": None, "s": "12"}),
    case('{"who": {"name": "a", "age": 7, "tags": ["x", 1]}}', {"who": {"age": 7, "tags": ["x", 1]}}),
    case('{"legs": [{"to": "b"}, {"to": "c", "km": 3}, 4], "x.y": {"z": 1}}', {"legs": [None, {"km": 3}, None], "x.y": {"z": 1}}),
    case('{"legs": "none", "who": 5}', None),
    case('{}', None),
    case('[1]', None),
    case('{"a": 1', None),
    case('', None),
    case(None, None),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_members(spark, text, expected):
    rows = spark.createDataFrame([(1, text)], "k int, json string")
    got = with_open_members(rows, SCHEMA).selectExpr("to_json(open_members)").first()[0]
    assert (None if got is None else json.loads(got)) == expected


def test_stored_and_read_by_type(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, '{"extra": {"n": 41, "s": "41"}}'), (2, '{"extra": 3}'), (3, '{"id": 3}')], "k int, json string"
    )
    with_open_members(rows, SCHEMA).drop("json").write.parquet(str(tmp_path / "o"))
    read = spark.read.parquet(str(tmp_path / "o")).selectExpr(
        "k", "try_variant_get(open_members, '$.extra.n', 'int') + 1 AS n", "schema_of_variant(open_members) AS kind"
    )
    assert sorted(tuple(r) for r in read.collect()) == [
        (1, 42, "OBJECT<extra: OBJECT<n: BIGINT, s: STRING>>"), (2, None, "OBJECT<extra: BIGINT>"), (3, None, None),
    ]
