from datetime import datetime

import pytest

from quillframe.operators import catalog


@pytest.mark.parametrize(
    "old, new",
    [
        ("draft", "schema_ready"), ("schema_ready", "previewed"), ("schema_ready", "extracted"),
        ("previewed", "extracted"), ("previewed", "schema_ready"), ("extracted", "schema_ready"),
        ("failed", "draft"), ("extracted", "failed"), ("draft", "failed"),
    ],
)
def test_allowed(old, new):
    catalog.check_transition(old, new)


@pytest.mark.parametrize(
    "old, new",
    [
        ("draft", "extracted"), ("draft", "draft"), ("draft", "previewed"),
        ("failed", "extracted"), ("extracted", "previewed"), ("previewed", "previewed"),
        ("unknown", "draft"),
    ],
)
def test_refused(old, new):
    with pytest.raises(ValueError, match="cannot go from"):
        catalog.check_transition(old, new)


def test_schema_ready_needs_a_schema():
    with pytest.raises(ValueError, match="needs a schema"):
        catalog.check_transition("draft", "schema_ready", has_schema=False)


def day(n):
    return datetime(2024, 1, n)


@pytest.fixture
def history(spark):
    rows = [
        ("a", "draft", day(1)), ("a", "schema_ready", day(2)), ("a", "previewed", day(3)),
        ("b", "draft", day(1)), ("b", "extracted", day(4)), ("c", "draft", day(1)),
        ("c", "failed", day(2)), ("c", "failed", day(3)),
    ]
    return spark.createDataFrame(
        [(i, "n" + i, s, t, day(1)) for i, s, t in rows],
        "dataset_id string, name string, status string, updated_at timestamp, created_at timestamp",
    )


@pytest.mark.parametrize("limit", [100, 1])
def test_violations(history, limit):
    found = catalog.status_violations(
        history, "dataset_id", ["updated_at"], max_group_rows=limit
    )
    assert sorted((r.dataset_id, r.previous, r.status) for r in found.collect()) == [
        ("b", "draft", "extracted"), ("c", "failed", "failed")
    ]


def test_current_summary_and_delete(spark, history):
    current = catalog.current_rows(history)
    assert {r.dataset_id: r.status for r in current.collect()} == {
        "a": "previewed", "b": "extracted", "c": "failed"
    }
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "dataset_id string")
    counts = {r.dataset_id: r.document_count for r in catalog.summary(current, docs).collect()}
    assert counts == {"a": 2, "b": 1, "c": 0}
    late, early = datetime(2999, 1, 1), datetime(1999, 1, 1)
    gone = spark.createDataFrame(
        [("b", late), ("b", early), ("c", early), ("zzz", late)], "dataset_id string, deleted_at timestamp"
    )
    left = catalog.live_rows(current, gone)  # c was made again after its deletion
    assert sorted(r.dataset_id for r in left.collect()) == ["a", "c"]


def test_state(spark, history):
    docs = spark.createDataFrame([("a",), ("a",)], "dataset_id string")
    fields = spark.createDataFrame([("a",)], "dataset_id string")
    records = spark.createDataFrame(
        [("a", "success"), ("a", "failed"), ("a", "partial")], "dataset_id string, status string"
    )
    rows = catalog.dataset_state(catalog.current_rows(history), docs, fields, records)
    a = rows.filter("dataset_id = 'a'").first()
    assert (a.documents, a.fields, a.total, a.succeeded, a.failed) == (2, 1, 3, 1, 1)
    assert rows.filter("dataset_id = 'c'").first().total == 0
