"""A dataset's way from a folder of documents to answers."""

import json

import pytest

from quillframe.library import Library
from quillframe.operators.extraction import RuleStrategy, labelled

SCHEMA = json.dumps(
    {
        "name": "employee",
        "description": "One employee.",
        "fields": [
            {"name": "name", "type": "string", "required": True},
            {"name": "department", "type": "string"},
            {"name": "base_salary", "type": "number", "required": True},
            {"name": "start_date", "type": "date"},
        ],
    }
)
RULES = RuleStrategy(
    {
        "name": labelled("Name"),
        "department": labelled("Department"),
        "base_salary": r"(?m)^\s*Base Salary: (.*)$",
        "start_date": labelled("Start Date"),
    }
)


@pytest.fixture
def library(spark, tmp_path):
    source = tmp_path / "people"
    source.mkdir()
    people = [("Ann Bell", "Sales", "$90,000"), ("Cid Dow", "Sales", "$110,000"),
              ("Eva Fox", "Design", "$120,500"), ("Gil Hay", "Design", "open")]
    for i, (name, team, pay) in enumerate(people, 1):
        (source / f"person_{i}.txt").write_text(
            f"EMPLOYEE\n\nName: {name}\nDepartment: {team}\nStart Date: 2024-0{i}-01\n\n"
            f"Compensation:\n  Base Salary: {pay}\n"
        )
    (source / "roster.csv").write_text('name,place\nAnn Bell,"Bonn, DE"\n')
    (source / "notes.md").write_text("# Teams\n\n## Sales\nAnn leads.\n")
    (source / "photo.jpg").write_bytes(b"\xff\xd8")
    (source / "empty.log").write_bytes(b"")
    made = Library(spark, str(tmp_path / "root"))
    made.source = str(source)
    return made


def test_whole_way(library):
    ds = library.create_dataset("Startup People", library.source)
    assert library.load(ds).status == "draft"
    assert library.list_source_files(ds, "*.csv").first().name == "roster.csv"
    assert library.read_file_sample(ds, "notes.md", 2).count() == 2
    assert library.get_file_info(ds, "notes.md").line_count == 4
    assert library.get_file_info(ds, "empty.log").modified is not None

    assert library.ingest(ds) == (6, 2)
    assert library.ingest(ds) == (0, 0)
    messages = [r.message for r in library.ingest_errors(ds).collect()]
    assert ".log" in messages[0] and ".jpg" in messages[1]
    assert [r.filename for r in library.list_documents(ds).collect()][:2] == [
        "notes.md", "person_1.txt"
    ]
    assert library.read_document(ds, "2").filename == "person_1.txt"
    with pytest.raises(FileNotFoundError):
        library.read_document(ds, "nobody.txt")
    kinds = {r.block_type for r in library.blocks(ds).select("block_type").collect()}
    assert kinds == {"header", "paragraph", "row"}

    with pytest.raises(ValueError, match="no schema"):
        library.extract_all(ds, RULES)
    with pytest.raises(ValueError, match="not a schema"):
        library.set_schema(ds, "{")
    with pytest.raises(ValueError, match="duplicate field name"):
        fields = [{"name": "a", "type": "string"}] * 2
        library.set_schema(ds, json.dumps({"name": "x", "fields": fields}))
    assert library.set_schema(ds, SCHEMA).version == 1
    assert library.load(ds).status == "schema_ready"
    assert library.set_schema(ds, SCHEMA).version == 2

    preview = library.extract_sample(ds, RULES, 2).collect()
    assert [r.value for r in preview if r.field == "name"] == ["Ann Bell", "Cid Dow"]
    assert library.load(ds).status == "previewed"

    found = library.extract_all(ds, RULES)
    assert library.spark.read.parquet(f"{library.root}/parquet/dataset_id={ds}/data.parquet").count() == 3
    assert (found.total, found.succeeded, found.failed) == (4, 3, 1)
    assert library.load(ds).status == "extracted"
    assert library.extract_all(ds, RULES).total == 4  # again, status stays
    assert library.load(ds).status == "extracted"

    answer = library.query_sql(
        ds,
        "SELECT department, avg(base_salary) AS pay FROM startup_people "
        "GROUP BY department ORDER BY department",
    )
    assert answer.rows == [["Design", 120500.0], ["Sales", 100000.0]]
    hits = library.search(ds, "ann").collect()
    assert [(r.origin, r.name) for r in hits] == [
        ("source", "notes.md"), ("source", "person_1.txt"), ("source", "roster.csv"),
        ("extracted", "data.txt"),
    ]
    state = library.state(ds)
    assert state["documents"] == 6 and len(state["fields"]) == 4
    assert state["extraction"].failed == 1


def test_catalog(library):
    a = library.create_dataset("A", library.source)
    b = library.create_dataset("B")
    library.ingest(a, "txt")
    rows = {r.dataset_id: r for r in library.list_datasets().collect()}
    assert rows[a].document_count == 4 and rows[b].document_count == 0
    assert library.delete_dataset(b) and not library.delete_dataset(b)
    assert [r.dataset_id for r in library.list_datasets().collect()] == [a]
    with pytest.raises(FileNotFoundError):
        library.load(b)
    with pytest.raises(ValueError, match="nothing was extracted"):
        library.query_sql(a, "SELECT 1")
    with pytest.raises(ValueError, match="no source folder"):
        library.ingest(library.create_dataset("C"))
    with pytest.raises(ValueError, match="cannot go from"):
        library.update_status(a, "extracted")
    other = Library(library.spark, library.root, user_id="somebody else")
    assert other.list_datasets().count() == 0


def test_schema_before_ingest_leaves_the_draft(library):
    ds = library.create_dataset("Early", library.source)
    library.set_schema(ds, SCHEMA)
    assert library.load(ds).status == "draft"
    library.ingest(ds)
    library.extract_all(ds, RULES)
    assert library.load(ds).status == "draft"


def test_export_and_import(spark, library, tmp_path):
    ds = library.create_dataset("Moving", library.source)
    library.ingest(ds)
    library.set_schema(ds, SCHEMA)
    library.extract_all(ds, RULES)
    bundle = library.export_dataset(ds, str(tmp_path / "bundle"))
    other = Library(spark, str(tmp_path / "elsewhere"))
    assert other.import_dataset(bundle) == ds
    assert other.load(ds).status == "extracted"
    assert other.documents(ds).count() == 6
    sql = "SELECT name FROM moving ORDER BY name"
    assert other.query_sql(ds, sql).rows == library.query_sql(ds, sql).rows
    hits = [tuple(r) for r in library.search(ds, "ann").collect()]
    assert [tuple(r) for r in other.search(ds, "ann").collect()] == hits
    assert any(h[0] == "extracted" for h in hits)
    assert other.ingest_errors(ds).count() == library.ingest_errors(ds).count() == 2


def test_append_takes_new_files_only(library, tmp_path):
    ds = library.create_dataset("Growing", library.source)
    assert library.append(ds) == (6, 2)  # an empty dataset is filled
    more = tmp_path / "more"
    more.mkdir()
    (more / "late.txt").write_text("Name: Late Comer\n")
    assert library.append(ds, str(more)) == (1, 0)
    assert library.append(ds, str(more)) == (0, 0) and library.append(ds)[0] == 0
    rows = {r.doc_index: r.filename for r in library.documents(ds).collect()}
    assert sorted(rows) == list(range(1, 8)) and rows[7] == "late.txt"


def test_search_reads_every_file(library, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "z.log").write_text("a\nneedle in a log\n")
    (folder / "b.txt").write_bytes(b"\xff needle in bad bytes\x0c")
    (folder / "page").write_bytes(b"one\x0c\nneedle\r\nlast\x0c")
    ds = library.create_dataset("Odd", str(folder))
    hits = [(r.name, r.line_no) for r in library.search(ds, "needle").collect()]
    assert hits == [("b.txt", 1), ("page", 3), ("z.log", 2)]
