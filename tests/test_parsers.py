import csv
import io

import pytest

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.sources import csv_documents, ingest, markdown, paged, plaintext

LINES = [
    "# A", "## B ", "#x", "#", "####### z", "", "  ", "text", "more text\r", "```",
    "```python", "  ``` js ", "``", "# ", "#\tTab", "\x1c", "a b", "    # no header", "\r",
    "###### six", "　", "tail ```",
]


def docs(spark, texts):
    return spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts)], "document_id string, content string"
    )


def parsed(df):
    found = {}
    for r in df.orderBy("document_id", "block_index").collect():
        found.setdefault(r.document_id, []).append((r.block_type, r.content, r.metadata))
    return found


def expected_markdown(text):
    """Line by line, with state, as a reader would do it by hand."""
    out, para, code, lang = [], [], None, ""

    def close_paragraph():
        if para:
            out.append(("paragraph", "\n".join(para), {}))
            para.clear()

    def close_code():
        out.append(("code", "\n".join(code), {"language": lang} if lang else {}))

    for line in text.split("\n"):
        bare = line.strip()
        header = re.match(r"(#{1,6})\s+(.*)", line)
        if code is not None:
            if bare.startswith("```"):
                close_code()
                code = None
            else:
                code.append(line)
        elif bare.startswith("```"):
            close_paragraph()
            code, lang = [], bare[3:].strip()
        elif header:
            close_paragraph()
            out.append(("header", header[2].strip(), {"level": str(len(header[1]))}))
        elif not bare:
            close_paragraph()
        else:
            para.append(line)
    close_paragraph()
    if code is not None:
        close_code()
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=14), min_size=60, max_size=120))
def test_markdown_matches_line_by_line_reading(spark, documents):
    texts = ["\n".join(lines) for lines in documents]
    found = parsed(markdown.blocks(docs(spark, texts)))
    for i, text in enumerate(texts):
        assert found.get(str(i), []) == expected_markdown(text), text


def test_markdown_examples(spark):
    texts = [
        "# Title\n\nIntro text\n\n## Part\nBody",
        "```python\nprint('x')\n```",
        "```\nplain\n```",
        "```sql\nnever closed\n# still code",
        "",
    ]
    found = parsed(markdown.blocks(docs(spark, texts)))
    assert [b[2].get("level") for b in found["0"] if b[0] == "header"] == ["1", "2"]
    assert found["1"] == [("code", "print('x')", {"language": "python"})]
    assert found["2"] == [("code", "plain", {})]
    assert found["3"] == [("code", "never closed\n# still code", {"language": "sql"})]
    assert "4" not in found


def test_markdown_metadata(spark):
    df = docs(spark, ["# a\n\nb\n```\nc\n```"])
    meta = df.select(markdown.metadata(F.col("content")).alias("m")).first().m
    assert meta == {"char_count": "16", "block_count": "3"}


def test_markdown_long_document_is_linear(spark):
    text = "\n".join(f"# h{i}\nline {i}\n" for i in range(20_000))
    assert markdown.blocks(docs(spark, [text])).count() == 40_000


def test_paragraphs(spark):
    texts = ["one\n\ntwo\nlines\n\n\n\n  three  ", "", "a\r\n\r\nb", " \n\n\t\n\n"]
    found = parsed(plaintext.blocks(docs(spark, texts)))
    assert [b[1] for b in found["0"]] == ["one", "two\nlines", "three"]
    assert [b[1] for b in found["2"]] == ["a\r\n\r\nb"]
    assert "1" not in found and "3" not in found
    meta = docs(spark, texts[:1]).select(plaintext.metadata(F.col("content"))).first()[0]
    assert meta == {"char_count": str(len(texts[0])), "paragraph_count": "3"}


def test_csv(spark):
    texts = [
        "name,age,city\nAda,36,London\nBob,25,Paris\n",
        'a,b\n1,"x,y"\n\n2,"q""z"\n3,"m\nn"\n',
        "",
        "a,b,c\n",
        "a\rb\n",
    ]
    df = docs(spark, texts)
    found = parsed(csv_documents.blocks(df))
    assert [b[:2] for b in found["0"]] == [
        ("header", "name,age,city"), ("row", "Ada,36,London"), ("row", "Bob,25,Paris")
    ]
    assert found["0"][0][2] == {"columns": '["name", "age", "city"]'}
    assert [b[2]["row_index"] for b in found["1"][1:]] == ["0", "1", "2", "3"]
    assert [b[1] for b in found["1"]] == ["a,b", "1,x,y", "", '2,q"z', "3,m\nn"]
    assert "2" not in found and len(found["3"]) == 1 and "4" not in found
    meta = [
        r[0] for r in df.orderBy("document_id").select(csv_documents.metadata(F.col("content"))).collect()
    ]
    assert (meta[0]["row_count"], meta[0]["column_count"]) == ("2", "3")
    assert (meta[2]["row_count"], meta[2]["column_count"]) == ("0", "0")
    assert (meta[3]["row_count"], meta[3]["column_count"]) == ("0", "3")
    failures = df.filter("document_id = '4'").select(csv_documents.failure(F.col("content")))
    assert "new-line character" in failures.first()[0]


@pytest.mark.parametrize(
    "text",
    ['a,"b', '"a"x"y",z\n"",,\n', 'x"y,"",\n\n', '"\n\r\n","a""b""",c', "a,b\r\n1,2\r\n", ",", '"a,b', '""""', "a\n ", "a,"],
)
def test_csv_as_python_reads_it(spark, text):
    want = list(csv.reader(io.StringIO(text, newline="")))
    row = docs(spark, [text]).select(
        F.transform(csv_documents.records(F.col("content")), csv_documents.fields)
    ).first()
    assert row[0] == want


def test_csv_blocks_of_a_long_file(spark):
    rows = 20_005
    text = "n\n" + "\n".join(str(i) for i in range(rows)) + "\n"
    found = csv_documents.blocks(docs(spark, [text]))
    assert found.count() == rows + 1
    assert found.agg(F.max("block_index")).first()[0] == rows


def test_pages(spark):
    pages = spark.createDataFrame(
        [("d", 1, " first "), ("d", 2, "  "), ("d", 3, "third"), ("e", 1, "x")],
        "document_id string, page_no long, text string",
    )
    blocks = paged.page_blocks(pages).orderBy("document_id", "block_index").collect()
    assert [(b.document_id, b.content, b.metadata) for b in blocks] == [
        ("d", "first", {"page": "1"}), ("d", "third", {"page": "3"}), ("e", "x", {"page": "1"})
    ]
    whole = " first \n\n  \n\nthird"
    facts = {r.document_id: r for r in paged.paged_documents(pages).collect()}
    assert facts["d"].page_count == 3 and facts["d"].char_count == len(whole)
    assert {r.document_id: r.content for r in paged.page_contents(pages).collect()} == {
        "d": whole, "e": "x"
    }


def test_page_contents_in_parts_lose_nothing(spark):
    pages = spark.createDataFrame(
        [("d", i, f"page {i} " + "x" * (i % 7)) for i in range(1, 200)],
        "document_id string, page_no long, text string",
    )
    whole = "\n\n".join(r.text for r in pages.orderBy("page_no").collect())
    parts = paged.page_contents(pages, part_chars=100, max_group_rows=20)
    rows = parts.orderBy("part_no").collect()
    assert len(rows) > 10
    assert "\n\n".join(r.content for r in rows) == whole


def test_pages_from_bytes_isolates_failures(spark):
    files = spark.createDataFrame(
        [("a", b"one|two"), ("b", b"\xff")], "document_id string, content binary"
    )
    pages = paged.pages_from_bytes(files, lambda raw: raw.decode("utf-8").split("|"))
    rows = {(r.document_id, r.page_no): r for r in pages.collect()}
    assert rows["a", 2].text == "two" and rows["a", 1].error is None
    assert rows["b", 1].text is None and "decode" in rows["b", 1].error


def test_registry():
    registry = ingest.default_registry()
    assert registry.extensions() == [".csv", ".md", ".txt"]
    assert registry.get(".MD") is markdown.PARSER
    registry.register(["log"], plaintext.PARSER)
    assert registry.get(".log") is plaintext.PARSER
    try:
        registry.get(".xyz")
    except ValueError as problem:
        assert "Unsupported file extension '.xyz'" in str(problem)
    else:
        raise AssertionError("no error")
