"""Documents in parts: blocks and parts equal those of whole texts at any split size."""

import random

import pytest

from quillframe.sources import large_documents as large
from quillframe.sources import markdown, plaintext

PIECES = ["word", "two words", "\n", "\n", "\n\n", "# Head", "```", "``` python", "\n```\n", "  ", "\t", "é", "\r\n", "\n## B\n"]


@pytest.fixture(params=["25", "1000000"])
def split_bytes(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    yield int(request.param)
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    rng, folder, out = random.Random(21), tmp_path_factory.mktemp("large"), {}
    for i in range(30):
        text = "".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 40, 150])))
        (folder / f"t{i:02}.txt").write_bytes(text.encode())
        out[f"t{i:02}.txt"] = text
    return str(folder), out


def whole(spark, module, out):
    docs = spark.createDataFrame(list(out.items()), "document_id string, content string")
    rows = module.blocks(docs).collect()
    return sorted((r.document_id, r.block_index, r.block_type, r.content, sorted(r.metadata.items())) for r in rows)


def in_parts(spark, found, folder, out):
    from pyspark.sql import functions as F

    ids = {r.d: r.path.rsplit("/", 1)[1] for r in spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), large.document_id(F.col("_metadata.file_path")).alias("d")).collect()}
    return sorted((ids[r.document_id], r.block_index, r.block_type, r.content, sorted(r.metadata.items())) for r in found.collect())


@pytest.mark.parametrize("kind", ["text", "markdown"])
def test_blocks_equal_those_of_whole_texts(spark, texts, split_bytes, kind):
    folder, out = texts
    module, blocks = (plaintext, large.text_blocks) if kind == "text" else (markdown, large.markdown_blocks)
    assert in_parts(spark, blocks(spark, folder), folder, out) == whole(spark, module, out)


def test_parts_put_together_are_the_text(spark, texts, split_bytes):
    folder, out = texts
    found = {}
    for r in large.parts(spark, folder, part_bytes=30).orderBy("path", "part").collect():
        name = r.path.rsplit("/", 1)[1]
        assert r.offset == len("".join(found.get(name, [])).encode()) and r.part == len(found.get(name, []))
        found.setdefault(name, []).append(r.content)
    assert {n: "".join(p) for n, p in found.items()} == {n: t for n, t in out.items() if t}


def test_files_that_are_not_utf8(spark, tmp_path, split_bytes):
    (tmp_path / "good.txt").write_bytes("é\n".encode() * 30)
    (tmp_path / "bad.txt").write_bytes(b"fine line\n" * 20 + b"\xff\n")
    rows = large.invalid_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["bad.txt"]


def test_chosen_paths_only(spark, texts):
    folder, _ = texts
    names = large._lines(spark, folder).where("path LIKE '%t03.txt' OR path LIKE '%t04.txt'").select("path").distinct()
    found = large.parts(spark, folder, paths=names).select("path").distinct().count()
    assert found == names.count()
