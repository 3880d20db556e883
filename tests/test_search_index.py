"""The index finds what the scan finds, and reads less for it."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.operators import search, search_index
from quillframe.operators.search_index import build_index, required_grams, required_texts

ODD = [
    ("odd/null", "null", None),
    ("odd/empty", "empty", ""),
    ("odd/case", "case", "LINES\nline\nKınd of a Kind\nſelfİsh"),
    ("odd/same", "same", "twice needle"),
    ("odd/same", "same", "twice needle"),
    ("odd/long", "long", "x" * 4095 + "needle" + "y" * 9000 + "\n" + "z" * 4094 + "needle"),
    ("odd/signs", "signs", "a@b.org\nf(x) = [1]\n50% off\na|b"),
]


@pytest.fixture(scope="module")
def documents(spark):
    dice = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "line", "wood", "wooden"]
    many = [(f"d/{i:03d}", f"{i:03d}", "\n".join(" ".join(dice.choices(words, k=6)) for _ in range(5))) for i in range(200)]
    many[70] = (*many[70][:2], many[70][2] + "\nrare marker 70")
    return spark.createDataFrame(many + ODD, "path string, filename string, content string").cache()


@pytest.fixture(scope="module")
def index(documents, tmp_path_factory):
    return build_index(documents, str(tmp_path_factory.mktemp("index") / "i"), block_chars=4000)


PATTERNS = [
    "needle", "rare MARKER", "kind", "selfish", "wooden (alpha|beta)", "gamma$|^needle|twice", "wood(en)? line", "woodx?en",
    "woo[d]en", r"[a-z]+@[a-z]+\.org", r"\w{6,}", "al", "ab*", r"f\(x\) = \[\d\]", "50%", r"a\|b", "[^]]x", "(?i)NEEDLE",
    "(?x) ne edle", r"\Qa|b\E", r"\x6eeedle", "absent words", "xneedley", "alpha{1,2}", "wooden{0}", "[a-c&&[b]]eta", "",
    "l.ne|", "(?=needle)n", "(?:rare) m", "alphä?a",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows_as_the_scan(documents, index, pattern):
    def rows(found):
        return sorted(tuple(r) for r in found.collect())

    assert rows(index.matching_lines(pattern)) == rows(search.matching_lines(documents, pattern))


def test_what_every_match_must_hold():
    assert required_texts("Ab+c?d{2}e") == [["ab", "d", "e"]]
    assert required_texts(r"x(y|z)w|\[q\d[|)\]]r") == [["x", "w"], ["[q", "r"]]
    assert required_texts("(?i)abc") is required_texts(r"\p{L}abc") is required_texts(r"[\Q]\E]abc") is None
    assert required_grams("abcd|@") == [["abc", "bcd"], ["@"]]
    assert required_grams("abcd|ef") is None


def test_only_the_blocks_of_candidates_are_read(spark, index):
    blocks = index.texts.select("block").distinct().count()
    assert blocks > 5
    found = index.matching_lines("rare marker")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "BroadcastHashJoin" in plan
    assert index.candidates("rare marker").select("block").distinct().count() == 1
    looked_up = index.grams.where(F.col("gram").isin("rar", "are"))
    assert "PushedFilters: [In(gram" in looked_up._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark, documents, tmp_path):
    empty = build_index(documents.limit(0), str(tmp_path / "none"))
    assert empty.matching_lines("needle").count() == 0 and empty.matching_lines("n").count() == 0


def test_blocks_and_their_lists_are_bounded(spark, documents, tmp_path, monkeypatch):
    """However small a block may be, there are only so many; each run of a document is listed once."""
    monkeypatch.setattr(search_index, "SMALL_BLOCKS", 6)
    index = build_index(documents, str(tmp_path / "i"), block_chars=100)
    assert index.texts.select("block").distinct().count() <= 6
    grams = index.grams
    assert grams.columns == ["gram", "block", "doc"] and grams.count() == grams.distinct().count()
    texts = {r.doc: r.content for r in index.texts.collect()}
    want = set()
    for doc, text in texts.items():
        text = (text or "").translate(str.maketrans(search_index._ALSO, search_index._LETTERS))
        want |= {(text[i : i + 3].lower(), doc) for i in range(len(text) - 2) if re.fullmatch("[ -~]{3}", text[i : i + 3])}
        want |= {(c, doc) for c in text if re.fullmatch(r"[!-/:-@\[-`{-~]", c)}
    assert {(r.gram, r.doc) for r in grams.collect()} == want
    rows = sorted(tuple(r) for r in index.matching_lines("needle").collect())
    assert rows == sorted(tuple(r) for r in search.matching_lines(documents, "needle").collect())


def test_runs_across_pieces_and_rows(monkeypatch):
    text = np.frombuffer(("abécd.\n" + "x" * 30 + "Yz{" * 9).encode(), np.uint8)
    whole = search_index._codes(text).tolist()
    monkeypatch.setattr(search_index, "PIECE", 4)
    assert search_index._codes(text).tolist() == whole
    assert [search_index._gram(c) for c in whole] == [".", "{", "cd.", "xxx", "xxy", "xyz", "yz{", "z{y", "{yz"]
    monkeypatch.setattr(search_index, "HELD", 3)
    batch = pa.RecordBatch.from_pydict(
        {"block": pa.array([0, 0, 0, 1], pa.int32()), "doc": [5, 6, 7, 8], "text": [b"abcd", None, b"xabc", b"abc"]}
    )
    listed = [r for b in search_index._list_grams(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert listed == [
        {"gram": "abc", "block": 0, "docs": [5, 7]},
        {"gram": "bcd", "block": 0, "docs": [5]},
        {"gram": "xab", "block": 0, "docs": [7]},
        {"gram": "abc", "block": 1, "docs": [8]},
    ]
