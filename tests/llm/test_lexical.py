"""K2-treap search: the grid, the bounds, whole results against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import lexical as X


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(X.TERM, low)


def brute(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // words
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                for t in wanted
                if t in b
            )
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=lambda r: (r[0], r[1]))


def run(spark, docs, items, top=5, shard_bytes=X.SHARD_BYTES, block_bytes=X.BLOCK_BYTES, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    index = X.build_index(d, shard_bytes=shard_bytes)
    found = X.search(index, i, top=top, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1]))


def corpus(rng, n, words=60):
    vocabulary = ["".join(rng.choices("abcdeé1", k=rng.randint(1, 5))) for _ in range(words)]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.randint(3, words)]) for _ in range(rng.choice([1, 5, 30, 200])))
    return [(k, text()) for k in range(n)], [(k, text()) for k in range(6)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs, items = corpus(rng, 150)
    docs += [(1000 + k, docs[3][1]) for k in range(40)]  # ties, decided by the id
    rng.shuffle(docs)
    want = brute(docs, items, 5)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, shard_bytes=900, block_bytes=300, parts=2) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "One TWO"), (None, "two é"), (5, "two " * 400_000), (6, "one"), (6, "one")]
    items = [(1, None), (2, ""), (None, "one"), (3, "One"), (3, "é"), (4, "absent"), (5, "two two")]
    assert run(spark, docs, items) == brute(docs, items, 5)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_text_keys(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "name string, body string")
    i = spark.createDataFrame([("q", "x")], "label string, body string")
    index = X.build_index(d, "name", "body")
    rows = X.search(index, i, "label", "body", "name").select("label", "rank", "name").collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.rank)] == [("q", 1, "a"), ("q", 2, "b")]


def test_grid_holds_every_point_and_its_maxima():
    rng = np.random.default_rng(2)
    rows, columns = rng.integers(0, 700, 2000), rng.integers(0, 90, 2000)
    points = {(int(r), int(c)): int(v) for r, c, v in zip(rows, columns, rng.integers(1, 10**6, 2000))}
    r, c = (np.array(x) for x in zip(*points))
    grid = X.build_grid(r, c, np.array(list(points.values())))
    assert grid.height == 10 and len(grid.maxima) == len(grid.masks) + len(points)

    def walk(cell, level, row, column):
        if level == grid.height:
            return {(row, column): int(grid.maxima[cell])}
        found, child = {}, int(grid.child[cell])
        for quarter in range(4):
            if grid.masks[cell] >> quarter & 1:
                found |= walk(child, level + 1, 2 * row + quarter // 2, 2 * column + quarter % 2)
                child += 1
        assert max(found.values()) == grid.maxima[cell]
        return found

    assert walk(0, 0, 0, 0) == points


def test_descent_opens_few_nodes_when_bounds_allow():
    """One document has a rare term: its range alone is followed to the end."""
    n = 4096
    rows, columns = np.zeros(n, np.int64), np.arange(n)
    impacts = np.full(n, 10)
    impacts[777] = 500
    grid = X.build_grid(rows, columns, impacts)
    known = np.zeros((1, 1), np.int64)
    item, column, score = X.descend(grid, np.array([0]), np.array([0]), np.array([3]), known, 1)
    assert (item.tolist(), column.tolist(), score.tolist()) == ([0], [777], [1500])


def test_terms_of_a_long_text_are_cut_at_gaps(monkeypatch):
    monkeypatch.setattr(X, "STEP", 10)
    text = ("Ab é1-" * 50 + "x" * 95 + " end").encode()
    assert [t for part in X.terms_in(text) for t in part] == X.TERM_BYTES.findall(text.lower())
