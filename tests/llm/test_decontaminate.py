"""Benchmark windows by brute force, in one block and in many."""

import random
import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - 12)) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((key, len(w), len(hit), sorted(items)))
    return out


def tables():
    rng = random.Random(7)
    vocabulary = ["Alpha", "béta", "g4mma", "δ", "exceptionallylongword", "exceptionallylongwOrd2", "x", "İ", "ß"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(n)) for i, n in enumerate((1, 5, 12, 13, 14, 40, 13))]
    bench += [(20, bench[3][1]), (20, bench[3][1]), (21, None), (22, "--- ---"), (None, text(15)), (100, text(30))]
    docs = [(i, text(rng.randrange(80))) for i in range(60)]
    for i in range(40):
        item = rng.choice(bench)[1] or ""
        docs.append((100 + i, f"{text(rng.randrange(300))} {item.upper() if i % 3 else item} {text(rng.randrange(30))}"))
    docs += [(300, None), (301, ""), (302, "..."), (303, bench[3][1]), (303, bench[3][1]), (None, bench[5][1])]
    docs.append((304, text(60_000) + " " + bench[5][1]))
    return docs, bench


@pytest.mark.parametrize(("block_bytes", "windows", "hashes"), [(1 << 20, 1, 1), (100, 1 << 20, 1 << 20), (100, 16, 40)])
def test_against_brute_force(spark, monkeypatch, block_bytes, windows, hashes):
    """A small benchmark, and a large one in one pass and in several."""
    sizes = {"block_bytes": block_bytes, "block_windows": windows, "hashes": hashes}
    monkeypatch.setattr(decontaminate, "with_hits", partial(decontaminate.with_hits, **sizes))
    docs, bench = tables()
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_words int")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.with_hits(df, benchmark, "h")
    got = found.select("doc_id", F.col("h.items"), *[c.alias(k) for k, c in decontaminate.verdict(F.col("h")).items()])
    want = brute(docs, bench)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()) == sorted(
        (k or -1, n, h, i) for k, n, h, i in want
    )
    clean = decontaminate.decontaminate(df, benchmark).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in clean) == sorted(
        (d[0] or -1, d[1] or "") for d, w in zip(docs, want) if not (w[2] > 0 and 20 * w[2] >= w[1])
    )
    cut = decontaminate.decontaminate(df, benchmark, remove="spans").collect()
    assert len(cut) == len(docs)
    long_items = [(i, t) for i, t in bench if len(words(t)) > 14]
    for r in cut:  # cutting may bring other words together, never a long window
        assert r.text is None or not [x for x in brute([(0, r.text)], long_items) if x[2] > 30]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 1
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_very_long_text(spark):
    """A window deep inside one text of many words, and one that a line break cuts."""
    passage = " ".join(f"passage{i}" for i in range(15))
    filler = " ".join(f"word{i % 997}" for i in range(300_000))
    docs = [(1, f"{filler} {passage} {filler}"), (2, filler), (3, passage.replace("passage7", "pass\nage7"))]
    bench = [(1, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.with_hits(d, b, "h")
    rows = found.select("doc_id", *(c.alias(k) for k, c in decontaminate.verdict(F.col("h")).items())).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows}
    assert got == {1: (600_015, 15, 1, False), 2: (300_000, 0, 0, False), 3: (16, 0, 0, False)}
    cut = decontaminate.decontaminate(d, b, remove="spans").where("doc_id = 1").first().text
    assert cut == f"{filler}  {filler}"
