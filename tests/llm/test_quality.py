"""Base counts by brute force, trees by their constraints and accuracy."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillframe.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    duplicates = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)]


def texts():
    rng = random.Random(5)
    words = ["a", "b", "é", "😀x", "#", "\x1c", " y", "c<d>"]
    yield from (None, "", " \t\n\x0b\x0c\r ", "one", "a " * 8, "a " * 9, "\n\n\n", "x\nx\nx \nx")
    for _ in range(60):
        gap = rng.choice([" ", "\n", " \n", "\t"])
        yield gap.join(rng.choice(words[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 60)))
    passage = " ".join(f"w{i}" for i in range(12))
    yield f"{passage} z {passage} {passage}\n{passage}"
    yield "long " * 100_000


def test_counts():
    for text in texts():
        if text is None or len(text) < 1000:
            assert quality.document_statistics((text or "").encode())[0] == brute(text), repr(text)
    counts = quality.document_statistics(b"long " * 100_000)[0]
    assert counts == [100_000, 400_000, 0, 0, 100_000]


def sample(n=3000):
    rng = np.random.default_rng(1)
    x = rng.random((n, 4))
    y = ((x[:, 0] < 0.4) & (x[:, 1] > 0.2) | (x[:, 2] > 0.9)).astype(float)
    return x, np.where(rng.random(n) < 0.03, 1 - y, y)


def test_trees_learn_and_keep_their_order():
    x, y = sample()
    order = np.array([-1, 1, 0, 0])
    forest = quality.train_trees(x[:2000], y[:2000], order)
    right = ((forest.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean()
    assert right > 0.93
    for f, sign in ((0, -1), (1, 1)):
        for row in x[:100]:
            line = np.tile(row, (50, 1))
            line[:, f] = np.linspace(-0.5, 1.5, 50)
            assert (np.diff(forest.score(line)) * sign >= -1e-12).all()


def test_one_class_and_few_rows():
    x = np.random.default_rng(0).random((30, 3))
    assert (quality.train_trees(x, np.ones(30), np.zeros(3)).score(x) > 0.99).all()
    assert quality.train_trees(x[:1], np.zeros(1), np.zeros(3)).score(x).max() < 0.01


def test_table(spark):
    rows = [(i, t, "mine", False) for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, n_words string, kept boolean")
    labels = spark.createDataFrame([(9, 1), (9, 0), (None, 1), (12, None)], "doc_id long, quality int")
    forest = quality.fit_quality(df, labels)
    found = df.select("doc_id", quality.quality_of(spark, F.col("text"), forest).alias("q"))
    got = [r for r in found.select("doc_id", "q.*").collect()]
    assert len(got) == len(rows) + 1
    for r in got:
        want = brute(rows[r.doc_id][1]) if len(rows[r.doc_id][1] or "") < 1000 else None
        if want:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.fit_quality(df, labels.limit(0)) is None
    kept = df.select(quality.quality_of(spark, F.col("text"), None).alias("q")).where("q.kept and q.base_failed")
    assert kept.count() == 0
    assert df.limit(0).select(quality.quality_of(spark, F.col("text"), forest)).count() == 0


def test_held_out_labels_of_the_tables(spark):
    """Fitted on one half of the labels, right on the other."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    judged = docs.select("doc_id", quality.quality_of(spark, F.col("text"), forest).alias("q"))
    rows = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").select("q.kept", "q.base_failed", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(len(bad), 1) < 0.1
