import json

import pytest

from quillframe.model import (
    FieldDef, RecordSchema, spark_type, storage_struct, typed_struct,
)
from quillframe.operators import contracts
from quillframe.operators.contracts import validate_schema


def schema(*fields, name="s"):
    return RecordSchema(name, tuple(fields))


def f(name, type="string", **more):
    return FieldDef(name, type, **more)


def test_valid_schema(spark):
    nested = f("items", "array", items=f("item", "object", properties=(f("a"), f("b", "number"))))
    assert validate_schema(spark, schema(f("x"), nested)) == []


@pytest.mark.parametrize("name", ["1st", "a-b", "two words", ""])
def test_bad_names(spark, name):
    errors = validate_schema(spark, schema(f(name)))
    assert errors == [
        f"Field '{name}': name must be a valid identifier (letters, digits, "
        "underscores, not starting with digit)"
    ]


def test_missing_name_and_fields(spark):
    assert validate_schema(spark, schema(name=" ")) == [
        "Schema name is required", "Schema must have at least one field"
    ]


def test_duplicates_among_siblings_only(spark):
    same = schema(f("a"), f("b", "object", properties=(f("a"), f("x"), f("x"), f("x"))), f("a"))
    assert validate_schema(spark, same) == [
        "Field 'b.x': duplicate field name",
        "Field 'b.x': duplicate field name",
        "Field 'a': duplicate field name",
    ]


def test_nested_rules_have_paths(spark):
    errors = validate_schema(
        spark,
        schema(
            f("list", "array"),
            f("thing", "object"),
            f("address", "object", properties=(f("bad name"),)),
            f("rows", "array", items=f("row", "object", properties=(f("9"),))),
        ),
    )
    assert [e.split(":")[0] for e in errors] == [
        "Field 'list'", "Field 'thing'", "Field 'address.bad name'", "Field 'rows.items.row.9'"
    ]


def test_type_names_are_checked():
    with pytest.raises(ValueError, match="Invalid field type 'integer'"):
        f("x", "integer")


def test_many_schemas_at_once(spark):
    schemas = [schema(f("a"), f("a"), name="one"), schema(f("ok"), name="two"), schema(name="three")]
    heads = contracts.schema_heads(spark, schemas)
    fields = contracts.schema_fields(spark, schemas)
    rows = {(r.schema_name, r.message) for r in contracts.validate_schemas(heads, fields).collect()}
    assert rows == {
        ("one", "Field 'a': duplicate field name"),
        ("three", "Schema must have at least one field"),
    }


def test_field_errors_with_a_hot_name(spark):
    rows = [("s", 1, 0, "", "a", 0, i, "a", "string", "", False, False, 0) for i in range(50)]
    from quillframe.model import SCHEMA_FIELDS

    fields = spark.createDataFrame(rows, SCHEMA_FIELDS)
    found = contracts.field_errors(fields, max_group_rows=10)
    assert sorted(r.ordinal for r in found.collect()) == list(range(1, 50))


def test_json_round_trip_and_types():
    text = json.dumps(
        {
            "name": "invoice",
            "fields": [
                {"name": "v", "type": "string", "required": True},
                {"name": "n", "type": "number"},
                {"name": "d", "type": "date"},
                {"name": "b", "type": "boolean"},
                {"name": "rows", "type": "array", "items": {
                    "name": "row", "type": "object",
                    "properties": [{"name": "q", "type": "number"}]}},
            ],
        }
    )
    made = RecordSchema.from_json(text)
    assert RecordSchema.from_json(made.to_json()) == made
    assert typed_struct(made).simpleString() == (
        "struct<v:string,n:double,d:string,b:boolean,rows:array<struct<q:double>>>"
    )
    stored = storage_struct(made)
    assert stored["rows"].dataType.simpleString() == "string"
    assert not stored["v"].nullable and stored["n"].nullable
    assert spark_type(f("o", "object")).simpleString() == "map<string,string>"


def test_describe(spark):
    tree = schema(
        f("a", required=True, description="first"),
        f("rows", "array", items=f("row", "object", properties=(f("q", "number"),))),
    )
    lines = contracts.describe_schemas(contracts.schema_fields(spark, [tree])).orderBy("ordinal")
    assert [r.line for r in lines.collect()] == [
        "- a: string (required) -- first", "- rows: array", "  - row: object", "    - q: number"
    ]


def test_versions(spark):
    stored = contracts.schema_heads(
        spark, [RecordSchema("a", version=1), RecordSchema("a", version=2, description="old")]
    )
    incoming = contracts.schema_heads(
        spark, [RecordSchema("a", description="new"), RecordSchema("b", description="first")]
    )
    heads = stored.unionByName(contracts.next_versions(stored, incoming))
    found = {r.schema_name: (r.version, r.description) for r in contracts.latest_versions(heads).collect()}
    assert found == {"a": (3, "new"), "b": (1, "first")}


CONFORM = schema(
    f("vendor", required=True), f("amount", "number", required=True), f("paid", "boolean"),
    f("tags", "array", items=f("t")),
    f("about", "object", properties=(f("k", "number"),)),
)


def conformed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_index long, json string")
    raw = contracts.parse_json_records(df, CONFORM)
    out = contracts.conform(raw, CONFORM, error="parse_error")
    return [r for r in out.orderBy("doc_index").collect()]


def test_conform(spark):
    rows = conformed(
        spark,
        [
            '{"vendor": "A", "amount": 10, "paid": true, "tags": ["x", "y"], "about": {"k": 1}}',
            '{"vendor": "B", "amount": "$1,234.50", "paid": "no", "extra": 1}',
            '{"vendor": "C"}',
            '{"vendor": "D", "amount": "soon", "paid": "maybe"}',
            "not json",
            '{"vendor": "E", "amount": 1, "tags": "x"}',
        ],
    )
    assert rows[0].status == "success" and rows[0].errors == []
    assert rows[0].data.tags == ["x", "y"] and rows[0].data.about.k == 1.0
    assert rows[1].data.amount == 1234.5 and rows[1].data.paid is False
    assert rows[1].data.tags is None
    assert rows[2].errors == ["amount: required field is missing"] and rows[2].data is None
    assert rows[3].errors == [
        "amount: not a valid number: soon; paid: not a valid boolean: maybe"
    ]
    assert rows[4].status == "failed" and rows[4].errors == ["not a JSON object"]
    assert rows[5].errors == ["tags: not a valid array: x"]


def test_long_messages_are_cut(spark):
    row = conformed(spark, ['{"vendor": "A", "amount": "' + "z" * 500 + '"}'])[0]
    assert len(row.errors[0]) == 203 and row.errors[0].endswith("...")


@pytest.mark.parametrize(
    "text, value",
    [
        ("12", 12.0), ("-1,234,567.5", -1234567.5), ("€ 12.50", 12.5), ("12 EUR", 12.0),
        ("USD 3", 3.0), ("1e3", 1000.0), ("1,23", None), ("12 apples", None), ("", None),
    ],
)
def test_numbers(spark, text, value):
    row = conformed(spark, [json.dumps({"vendor": "A", "amount": text})])[0]
    assert (row.data.amount if row.data else None) == value


def test_equal_paths_of_two_parents_are_no_duplicates(spark):
    inner = FieldDef("x", "string")
    schema = RecordSchema(
        "s", tuple(FieldDef("a", "object", properties=(inner,)) for _ in range(2))
    )
    assert contracts.validate_schema(spark, schema) == ["Field 'a': duplicate field name"]
    twice = RecordSchema("s", (FieldDef("a", "object", properties=(inner, inner)),))
    assert contracts.validate_schema(spark, twice) == ["Field 'a.x': duplicate field name"]


NESTED = RecordSchema(
    "n",
    (
        FieldDef("o", "object", properties=(FieldDef("a", "number", required=True), FieldDef("b", "boolean"))),
        FieldDef("l", "array", items=FieldDef("i", "object", properties=(FieldDef("k", "number"),))),
        FieldDef("n", "array", items=FieldDef("i", "number")),
        FieldDef("m", "object"),
    ),
)


@pytest.mark.parametrize("checked", [True, False])
@pytest.mark.parametrize(
    ("text", "problem", "data", "left_out"),
    [
        ('{"o":{"a":"$1,200.00","b":"yes","z":9}}', "", {"o": (1200.0, True)}, [("o.z", "9")]),
        ('{"o":{"a":"bad"}}', "o.a: not a valid number: bad", {"o": (None, None)}, [("o.a", "bad")]),
        ('{"o":{"b":"x"}}', "o.b: not a valid boolean: x; o.a: required field is missing",
         {"o": (None, None)}, [("o.b", "x")]),
        ('{"l":[{"k":"oops"},{"k":"3"},null]}', "l[0].k: not a valid number: oops",
         {"l": [(None,), (3.0,), None]}, [("l[0].k", "oops")]),
        ('{"n":["$1,200.00",2,"x"]}', "n[2]: not a valid number: x", {"n": [1200.0, 2.0, None]}, [("n[2]", "x")]),
        ('{"m":{"p":[1],"q":null}}', "", {"m": {"p": "[1]", "q": None}}, []),
    ],
)
def test_nested_rules(spark, checked, text, problem, data, left_out):
    raw = contracts.parse_json_records(spark.createDataFrame([(text,)], "json string"), NESTED)
    row = contracts.conform(
        raw, NESTED, error="parse_error", nested_check=checked, left_out="more"
    ).first()
    extra = [tuple(x) for x in row.more]
    if checked:
        assert row.errors == ([problem] if problem else []), row
        assert row.status == ("failed" if problem else "success")
        if not problem:
            assert extra == left_out
    else:
        assert row.status == "success" and extra == left_out
    if row.status == "success":
        plain = lambda v: tuple(v) if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v
        assert {k: plain(row.data[k]) for k in data} == data


@pytest.mark.parametrize("checked", [True, False])
def test_a_nested_field_itself_is_always_checked(spark, checked):
    raw = contracts.parse_json_records(spark.createDataFrame([('{"o":"text","l":{}}',)], "json string"), NESTED)
    row = contracts.conform(raw, NESTED, error="parse_error", nested_check=checked, error_chars=None).first()
    assert row.errors == ["o: not a valid object: text; l: not a valid array: {}"]
