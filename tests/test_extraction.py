import json

import pytest

from quillframe.model import FieldDef, RecordSchema
from quillframe.operators import extraction, prompts

SCHEMA = RecordSchema(
    "invoice",
    (
        FieldDef("vendor", "string", "Who sends it", True),
        FieldDef("amount", "number", required=True),
        FieldDef("paid", "boolean"),
    ),
    "An invoice.",
)
RULES = extraction.RuleStrategy(
    {"vendor": r"from (Vendor \d+)", "amount": r"Total: (\S+)", "paid": r"Paid: (\w+)"}
)


@pytest.fixture
def docs(spark):
    rows = [
        (f"doc-{i}", i, f"doc{i}.txt", ".txt", f"Invoice #{i} from Vendor {i}. Total: ${i}00.00")
        for i in range(7, 0, -1)
    ]
    return spark.createDataFrame(
        rows, "document_id string, doc_index long, filename string, file_type string, content string"
    )


def test_batch_by_rules(docs):
    records = extraction.extract_batch(docs, SCHEMA, RULES).orderBy("doc_index").collect()
    assert [r.data.amount for r in records] == [i * 100.0 for i in range(1, 8)]
    assert [r.data.vendor for r in records] == [f"Vendor {i}" for i in range(1, 8)]
    assert {r.data.paid for r in records} == {None}


def test_sample_takes_the_first_documents(docs):
    records = extraction.extract_sample(docs, SCHEMA, RULES)
    assert sorted(r.doc_index for r in records.collect()) == [1, 2, 3, 4, 5]
    assert extraction.extract_sample(docs, SCHEMA, RULES, 50).count() == 7
    assert extraction.extract_sample(docs.limit(0), SCHEMA, RULES).count() == 0


def test_empty_schema_is_refused(docs):
    with pytest.raises(ValueError, match="no fields"):
        extraction.extract_batch(docs, RecordSchema("x"), RULES)


def test_function_strategy_isolates_failures(docs):
    def read(content):
        number = int(content.split("#")[1].split()[0])
        if number == 2:
            raise RuntimeError("timeout " + "x" * 400)
        return {"vendor": f"V{number}", "amount": number, "paid": number > 3, "other": 1}

    records = extraction.extract_batch(docs, SCHEMA, extraction.FunctionStrategy(read, 3))
    rows = {r.doc_index: r for r in records.collect()}
    assert rows[2].status == "failed" and rows[2].data is None
    assert rows[2].errors[0].startswith("timeout x") and len(rows[2].errors[0]) == 203
    assert rows[5].data.paid is True and rows[1].data.amount == 1.0
    found = extraction.summary(records)
    assert (found.total, found.succeeded, found.failed) == (7, 6, 1)
    errors = extraction.record_errors(records).collect()
    assert [e.doc_index for e in errors] == [2]


def test_function_runs_once_per_document(docs, tmp_path):
    log = str(tmp_path / "calls")

    def read(content):
        with open(log, "a") as f:
            f.write("call\n")
        return {"vendor": "v", "amount": 1}

    records = extraction.extract_batch(docs, SCHEMA, extraction.FunctionStrategy(read))
    records.count()
    extraction.summary(records)
    assert len(open(log).readlines()) == 7


def test_partial_counts_only_in_total(spark):
    rows = [("success",), ("failed",), ("partial",)]
    found = extraction.summary(spark.createDataFrame(rows, "status string"))
    assert (found.total, found.succeeded, found.failed) == (3, 1, 1)


def test_skip_non_records(spark):
    kinds = [(".csv",), ("md",), (".Markdown",), (".txt",), (".pdf",)]
    docs = spark.createDataFrame(kinds, "file_type string")
    kept = extraction.skip_non_records(docs)
    assert sorted(r.file_type for r in kept.collect()) == [".pdf", ".txt"]
    assert extraction.skip_non_records(docs, ()).count() == 5
    assert extraction.skipped_count(docs).first().skipped == 3


def test_preview(docs):
    bad = extraction.RuleStrategy({"vendor": r"from (Vendor \d+)", "amount": r"#([3-9])"})
    records = extraction.extract_batch(docs, SCHEMA, bad)
    rows = extraction.preview_fields(records).orderBy("doc_index", "position").collect()
    first = [r for r in rows if r.doc_index == 1]
    assert [(r.field, r.value) for r in first] == [
        ("ERROR", "amount: required field is missing")
    ]
    third = [(r.field, r.value) for r in rows if r.doc_index == 3]
    assert third == [("vendor", "Vendor 3"), ("amount", "3.0"), ("paid", "None")]


def test_prompts(docs):
    schema = RecordSchema(
        "invoice",
        (
            *SCHEMA.fields,
            FieldDef("rows", "array", items=FieldDef("row", "object", properties=(FieldDef("q", "number"),))),
        ),
        "An invoice.",
    )
    assert prompts.field_table(schema) == [
        "vendor | string | needed | Who sends it",
        "amount | number | needed",
        "paid | boolean | optional",
        "rows | array | optional",
        "rows.items.row | object | optional",
        "rows.items.row.q | number | optional",
    ]
    said = prompts.hints(schema)
    assert not any(h.startswith("date") for h in said) and any("vendor, amount" in h for h in said)
    rows = prompts.render_prompts(docs, schema, "Be brief.").collect()
    assert len(rows) == 7
    assert all("An invoice." in r.system and "\nBe brief.\n" in r.system for r in rows)
    assert {r.user.split("Invoice ")[1][:2] for r in rows} == {f"#{i}" for i in range(1, 8)}
    assert "Notes" not in prompts.system_text(schema)


def test_array_rule(spark):
    schema = RecordSchema("m", (FieldDef("tags", "array", items=FieldDef("t", "string")),))
    docs = spark.createDataFrame(
        [("1", 1, "a", "x #one y #two"), ("2", 2, "b", "none")],
        "document_id string, doc_index long, filename string, content string",
    )
    rows = extraction.extract_batch(docs, schema, extraction.RuleStrategy({"tags": r"#(\w+)"}))
    assert [r.data.tags for r in rows.orderBy("doc_index").collect()] == [["one", "two"], None]
    assert json.loads('["one"]') == ["one"]


def test_stopped_run_asks_for_each_text_once(spark, docs, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "answers")
    log.mkdir()

    def read(content):
        import uuid

        (log / uuid.uuid4().hex).write_text(content)
        if "#5" in content:
            raise RuntimeError("no answer")
        return {"vendor": "v", "amount": 1}

    twice = docs.unionByName(docs.withColumn("doc_index", docs.doc_index + 100))
    strategy = extraction.ResumableStrategy(read, path, batches=3)
    extraction.extract_batch(twice.where("doc_index IN (1, 2, 5, 101)"), SCHEMA, strategy)  # half of the work
    records = extraction.extract_batch(twice, SCHEMA, strategy)
    found = extraction.summary(records)
    assert (found.total, found.succeeded, found.failed) == (14, 12, 2)
    calls = [f.read_text() for f in log.iterdir()]
    assert len(calls) == len(set(calls)) == 7
    assert strategy.answers(spark).count() == 7
    again = extraction.ResumableStrategy(read, path, retry_failures=True)
    assert extraction.summary(extraction.extract_batch(docs, SCHEMA, again)).failed == 1
    assert len(list(log.iterdir())) == 8
    other = extraction.ResumableStrategy(read, path, version="another question")
    extraction.extract_batch(docs, SCHEMA, other)
    assert len(list(log.iterdir())) == 15
