"""Merkle fingerprints: the tree, equality, likeness, where edits are, next documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillframe.llm import fingerprints as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(text):
    """The same tree by plain loops."""
    pieces = re.findall(M.PIECE, text)
    assert "".join(pieces) == text
    root, section, paragraph, short = "", "", "", ""
    for i, p in enumerate(pieces):
        code = sha(p)
        sign = "," if "\n" not in p else "|" if "\n\n" in p or code[0] in "01" else ";"
        paragraph += f"{code}{len(p)}{sign}"
        short += f"{code[:8]}{len(p)}{sign}"
        if sign != "," or i + 1 == len(pieces):
            section += sha(paragraph)
            paragraph = ""
        if sign == "|" or i + 1 == len(pieces):
            root += sha(section)
            section = ""
    return f"{sha(root)}:{short}"


def prose(rng, n):
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ". ", ".\n", "\n\n", "! ", "; "]) for w in words)


TEXTS = [None, "", "x", "\n", "\n\n\n", "a.\n\nb.", "no end mark " * 100, "é😀" * 500, "..." * 300, "a. " * 50]


def test_tree_equals_plain_loops(spark):
    rng = random.Random(3)
    texts = TEXTS + [prose(rng, n) for n in (1, 5, 40, 400, 4000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.f for r in rows.select("i", M.fingerprint(F.col("t")).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == tree(t or "")
    assert found[0] == found[1]


def compare(spark, pairs):
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>")
    a, b = F.col("p.a"), F.col("p.b")
    rows = df.select(
        "i",
        M.likeness(M.fingerprint(a), M.fingerprint(b)).alias("like"),
        M.edit_span(M.tree_of(a), M.tree_of(b)).alias("span"),
    ).collect()
    return [(r.like, r.span and tuple(r.span)) for r in sorted(rows, key=lambda r: r.i)]


def test_likeness_and_edit_span(spark):
    rng = random.Random(5)
    text = prose(rng, 1500)
    other = prose(rng, 1500)
    middle = len(text) // 2
    edit = text[:middle] + "INSERTED " + text[middle:]
    pairs = [(text, text), (text, other), (text, edit), (edit, text), ("", text), ("", None), (text, ""), (text + "End", text)]
    found = compare(spark, pairs)
    assert found[0] == (1.0, None) and found[5] == (1.0, None)
    assert found[1][0] < 0.1
    for like, (start, end) in found[2:4]:
        assert like > 0.97 and start <= middle <= end and end - start < 2 * M.SENTENCE
    assert found[4][0] == 0.0 and found[6] == (0.0, (0, len(text)))
    assert found[7][1][1] == len(text) + 3 and found[7][1][0] > len(text) - M.SENTENCE


def test_half_of_a_text_is_about_half_alike(spark):
    rng = random.Random(8)
    pairs = [(a, a[: len(a) - len(a) // 2] + prose(rng, 900)[: len(a) // 2]) for a in (prose(rng, n) for n in (200, 900))]
    for (like, span), (a, _) in zip(compare(spark, pairs), pairs, strict=True):
        assert 0.4 < like < 0.6 and abs(span[0] - len(a) / 2) < 2 * M.SENTENCE and span[1] == len(a)


def next_rows(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string, next_key string")
    half = M.half_of(F.col("text"))
    return M.with_next(docs, {"up": F.upper("text")}, half).collect()


def test_next_document(spark):
    rows = [(7, "seven!", "k"), (1, "one", "k"), (3, None, None), (5, "é😀fünf", "k"), (None, "none", "k")]
    got = {r.doc_id: (r.next_text, r.up, r.next_key) for r in next_rows(spark, rows)}
    assert got == {
        7: ("é😀f", "É😀FÜNF", "k"),
        5: ("", None, "k"),  # the next text is null
        3: ("", "ONE", None),
        1: ("n", "NONE", "k"),
        None: ("se", "SEVEN!", "k"),
    }


def test_repeated_rows_and_tables_of_one_or_none(spark):
    again = [(2, "bb", "k")] * 5 + [(1, "aaaa", "k")] * 3
    got = sorted((r.doc_id, r.next_text) for r in next_rows(spark, again))
    assert got == [(1, "bb")] * 3 + [(2, "a")] * 5
    assert [(r.next_text, r.up) for r in next_rows(spark, [(4, "four", "k")])] == [("fo", "FOUR")]
    assert next_rows(spark, []) == []
    same_id = next_rows(spark, [(1, "a1", "k"), (1, "b1", "k"), (1, "c1", "k")])
    assert sorted(r.up for r in same_id) == ["A1", "B1", "C1"]


def test_very_long_texts(spark):
    text = "".join(f"Sentence number {i} stands here.{' ' if i % 7 else chr(10)}" for i in range(60_000))
    pairs = [(text, text[:-40]), ("x" * 3_000_000, "x" * 3_000_000 + "y")]
    found = compare(spark, pairs)
    assert found[0][0] > 0.999 and found[0][1][0] > len(text) - 400
    assert found[1][1][0] >= 3_000_000 - M.SENTENCE


def test_native_only(spark):
    df = spark.createDataFrame([(1, "a. b.")], "doc_id long, text string")
    plan = M.with_next(df, {"f": M.fingerprint(F.col("text"))}, M.half_of(F.col("text")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("bad", ["\r\n", " ", "\x00"])
def test_other_line_ends_are_characters(spark, bad):
    like = compare(spark, [(f"a{bad}b.", f"a{bad}b.")])
    assert like == [(1.0, None)]
