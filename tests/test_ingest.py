import pytest
from pyspark.sql import functions as F

from quillframe.operators import search
from quillframe.sources import ingest, large_text, listing, paged, plaintext
from quillframe.sources.tables import read_csv_table
from quillframe.streaming.ingest import ingest_stream


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "b.txt").write_text("para one\n\npara two")
    (root / "a.MD").write_text("# Title\nbody")
    (root / "empty.txt").write_bytes(b"")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "broken.csv").write_bytes(b"a\rb\n")
    (root / "notes.log").write_text("nothing")
    (root / "sub" / "t.csv").write_text("x,y\n1,2\n")
    (root / "sub" / "b.txt").write_text("same name")
    return root


def test_read_folder(spark, folder):
    docs, errors = ingest.read_folder(spark, str(folder))
    rows = docs.orderBy("doc_index").collect()
    assert [r.filename for r in rows] == ["a.MD", "b.txt", "empty.txt", "b.txt", "t.csv"]
    assert [r.doc_index for r in rows] == [1, 2, 3, 4, 5]
    assert rows[2].content == "" and rows[2].metadata["paragraph_count"] == "0"
    assert rows[0].file_type == ".md"
    assert len({r.document_id for r in rows}) == 5
    problems = {r.filename: r.message for r in errors.collect()}
    assert set(problems) == {"bad.txt", "broken.csv", "notes.log"}
    assert problems["notes.log"].startswith("Unsupported file extension '.log'. Supported: .csv")
    assert problems["bad.txt"].startswith("Failed to parse 'bad.txt': ")
    assert "new-line" in problems["broken.csv"]


def test_extension_filter(spark, folder):
    docs, errors = ingest.read_folder(spark, str(folder), " TXT, .csv ")
    assert sorted({r.file_type for r in docs.collect()}) == [".csv", ".txt"]
    assert {r.filename for r in errors.collect()} == {"bad.txt", "broken.csv"}
    assert ingest.extension_filter("TXT,.md, ") == [".txt", ".md"]


def test_blocks_by_type(spark, folder):
    docs, _ = ingest.read_folder(spark, str(folder))
    found = ingest.blocks(docs).groupBy("block_type").count().collect()
    assert {r.block_type: r["count"] for r in found} == {"paragraph": 4, "header": 2, "row": 1}


def test_second_ingest_adds_only_new_files(spark, folder):
    files = listing.read_files(spark, str(folder))
    docs, _ = ingest.read_folder(spark, str(folder))
    again = ingest.append_documents(docs, files)
    assert again.count() == 5
    (folder / "z.txt").write_text("late")
    more = ingest.append_documents(docs, listing.read_files(spark, str(folder)))
    late = more.filter("filename = 'z.txt'").first()
    assert more.count() == 6 and late.doc_index == 6


def test_stream_ingest_is_incremental(spark, folder, tmp_path):
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        ingest_stream(spark, str(folder), target, state).awaitTermination(120)
        return spark.read.parquet(f"{target}/documents")

    # the stream's file source does not deliver empty files
    assert run().count() == 4
    assert run().count() == 4
    (folder / "sub" / "new.md").write_text("# new")
    docs = run()
    assert docs.count() == 5
    assert docs.filter("filename = 'new.md'").first().doc_index == 5
    assert spark.read.parquet(f"{target}/errors").count() == 3


def test_listing(spark, folder):
    found = listing.list_source_files(spark, str(folder))
    names = {r.name: r for r in found.collect()}
    assert "t.csv" not in names  # the folder itself has matches
    assert names["b.txt"].extension == ".txt" and names["b.txt"].size == "18 B"
    assert names["empty.txt"].size == "0 B"
    below = listing.list_source_files(spark, str(folder), "t.*").collect()
    assert [r.name for r in below] == ["t.csv"]


def test_empty_files_with_odd_names(spark, tmp_path):
    for name in ("a b.txt", "c+d.txt", "e%41.txt", "\u00e9.txt", "_hidden.txt"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "full one+.txt").write_text("x")
    rows = listing.read_files(spark, str(tmp_path), "*.txt").collect()
    names = {r.path.rsplit("/", 1)[1]: r.length for r in rows}
    assert names == {"a b.txt": 0, "c+d.txt": 0, "e%41.txt": 0, "\u00e9.txt": 0, "full one+.txt": 1}


def test_file_info_sample_and_preview(spark, folder):
    (folder / "lines.txt").write_text("".join(f"line {i}\n" for i in range(60)))
    files = listing.read_files(spark, str(folder), "lines.txt")
    info = listing.file_info(files).first()
    assert info.line_count == 60 and info.size_bytes == (folder / "lines.txt").stat().st_size
    docs = files.withColumn("content", F.col("content").cast("string"))
    sample = listing.file_sample(docs, "path", max_lines=50).collect()
    assert len(sample) == 50 and {r.total_lines for r in sample} == {60}
    bad = listing.hex_preview(listing.read_files(spark, str(folder), "bad.txt")).first()
    assert bad.preview == "fffe"


def test_read_document(spark, folder):
    docs, _ = ingest.read_folder(spark, str(folder))
    assert ingest.read_document(docs, "1").first().filename == "a.MD"
    named = ingest.read_document(docs, "b.txt", max_chars=4).first()
    assert (named.content, named.remaining_chars, named.doc_index) == ("para", 14, 2)
    assert ingest.read_document(docs, "99").first() is None
    refs = spark.createDataFrame([("b.txt",), ("b.txt",), ("t.csv",)], "reference string")
    found = ingest.read_documents(docs, refs).collect()
    assert sorted(r.doc_index for r in found) == [2, 5]
    listed = ingest.list_documents(docs).orderBy("doc_index").collect()
    assert [r.chars for r in listed] == [12, 18, 0, 9, 8]


def test_number_like_filename_is_found_by_name(spark, tmp_path):
    (tmp_path / "7").mkdir()
    docs = spark.createDataFrame(
        [("7", 1, ".txt", "x")], "filename string, doc_index long, file_type string, content string"
    )
    assert ingest.read_document(docs, "7").first().content == "x"


def test_csv_table_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,pay,ok\n1,"a, b",2.5,true\n2,"c\nd",3.0,false\n')
    df = read_csv_table(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert [t for _, t in df.dtypes] == ["int", "string", "double", "boolean"]
    assert df.orderBy("id").collect()[1].name == "c\nd"


def test_csv_table_keeps_line_breaks_in_quotes_unless_told_otherwise(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('id,note\n1,"a\nb"\n2,c\n')
    df = read_csv_table(spark, path)
    assert dict(df.dtypes)["id"] == "int"
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a\nb"), (2, "c")]
    assert read_csv_table(spark, path, df.schema).count() == 2
    assert read_csv_table(spark, path, multi_line=False).count() == 3


def test_large_text_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    lines[7] = "two\x0bparts"
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.txt").write_text("a\r\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = large_text.numbered_lines(spark, str(tmp_path), "*.txt")
        rows = {(r.filename, r.line_no): r.line for r in found.collect()}
        hits = search.first_matches(search.matching_source_lines(found, "^line 4999 ")).collect()
        counts = {r.filename: r.line_count for r in large_text.line_counts(found).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = (tmp_path / "big.txt").read_text().splitlines()
    assert [rows["big.txt", i] for i in range(1, len(want) + 1)] == want
    assert rows["other.txt", 2] == "b" and counts == {"big.txt": 5001, "other.txt": 2}
    assert [r.line_no for r in hits] == [5001]


def test_files_over_the_cell_size_become_errors(spark, folder, monkeypatch):
    monkeypatch.setattr(ingest, "MAX_DOCUMENT_BYTES", 10)
    docs, errors = ingest.read_folder(spark, str(folder), "txt")
    assert sorted(r.filename for r in docs.collect()) == ["b.txt", "empty.txt"]
    large = errors.filter("message LIKE '%too large%'").collect()
    assert [r.filename for r in large] == ["b.txt"]


def test_appended_files_are_documents_or_errors(spark, folder):
    files = listing.read_files(spark, str(folder))
    docs, _ = ingest.read_folder(spark, str(folder), "md")
    all_docs, errors = ingest.append_files(docs, files, max_bytes=10)
    names = {r.filename for r in all_docs.collect()} | {r.filename for r in errors.collect()}
    assert names == {r.path.rsplit("/", 1)[1] for r in files.select("path").collect()}
    assert [r.filename for r in errors.filter("message LIKE '%too large%'").collect()] == ["b.txt"]


def test_large_files_are_documents_in_parts(spark, folder):
    (folder / "big + 1%.txt").write_text("one\n\ntwo " * 20)
    (folder / "big.md").write_text("# T\n\nbody\n```py\nx\n\n```\n" * 9)
    (folder / "big.csv").write_text('a,b\n' + '1,"x\ny"\n' * 9)
    (folder / "torn.txt").write_bytes(b"fine\n" * 30 + b"\xff")
    whole, errors = ingest.read_folder(spark, str(folder))
    docs, split_errors = ingest.read_folder(spark, str(folder), max_bytes=60, large="parts")
    key = lambda df: sorted((r.filename, r.doc_index) for r in df.select("filename", "doc_index").collect())
    assert key(docs) == key(whole)
    said = lambda df: sorted(map(tuple, df.collect()))
    assert said(split_errors) == said(errors)
    parts = {r.filename for r in docs.filter("content IS NULL").collect()}
    assert parts == {"big + 1%.txt", "big.md", "big.csv"}
    rows = lambda df: sorted((r.document_id, r.block_index, r.block_type, r.content, sorted(r.metadata.items())) for r in df.collect())
    assert rows(ingest.all_blocks(spark, str(folder), docs)) == rows(ingest.blocks(whole))


def test_paged_files_and_user_parsers(spark, folder):
    registry = ingest.default_registry()
    registry.register([".log"], plaintext.PARSER)
    registry.register(
        [".pag"], paged.page_parser("pag", lambda raw: raw.decode("ascii").split("|"))
    )
    (folder / "doc.pag").write_bytes(b" one\n\nmore | |three")
    (folder / "bad.pag").write_bytes(b"\xff")
    docs, errors = ingest.read_folder(spark, str(folder), ".pag,.log", registry)
    rows = {r.filename: r for r in docs.collect()}
    assert set(rows) == {"doc.pag", "notes.log"}
    assert rows["doc.pag"].content == " one\n\nmore \n\n \n\nthree"
    assert rows["doc.pag"].metadata["page_count"] == "3"
    assert rows["doc.pag"].metadata["char_count"] == str(len(rows["doc.pag"].content))
    assert "decode" in errors.filter("filename = 'bad.pag'").first().message
    found = ingest.blocks(docs.filter("filename = 'doc.pag'"), registry)
    blocks = found.orderBy("block_index").collect()
    assert [(b.content, b.metadata) for b in blocks] == [
        ("one\n\nmore", {"page": "1"}), ("three", {"page": "3"})
    ]


def test_mixed_folder_with_a_page_parser(spark, folder):
    registry = ingest.default_registry()
    registry.register([".log"], paged.page_parser("log", lambda raw: [raw.decode()]))
    docs, errors = ingest.read_folder(spark, str(folder), registry=registry)
    assert docs.count() == 6 and errors.count() == 2
    assert ingest.blocks(docs, registry).filter("content = 'nothing'").count() == 1
