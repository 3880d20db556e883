"""Spelling variants: words, blocks, near pairs and forms against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(docs):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 6:
                count[low] += 1
    return {w: n for w, n in count.items() if n >= 5}


def brute(words):
    out = []
    best = {}
    for w in words:
        others = [x for x in words if near(w, x)]
        top = min(others, key=lambda x: (-words[x], x), default=None)
        best[w] = top if top and words[top] >= 5 * words[w] else None
        out.append([w, len(others)])
    rows = set()
    for w, n_near in out:
        root = w
        while best[root]:
            root = best[root]
        rows.add((w, best[w], root, words[w], n_near, words.get(best[w])))
    return rows


def found(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = S.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return set(map(tuple, rows))


def made(rng, n, letters="abcdeéÿ"):
    words = {"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(n)}
    for w in list(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
        if len(w) > 6:
            words.add(w[:i] + w[i + 1 :])
    return {w: rng.choice([5, 6, 30, 160, 900, 5000]) for w in words}


@pytest.mark.parametrize("seed", range(3))
def test_forms_equal_brute_force(spark, seed, monkeypatch):
    words = made(random.Random(seed), 150)
    want = brute(words)
    assert found(spark, words) == want
    monkeypatch.setattr(S, "TILE_WORDS", 3)  # many tiles to a block
    monkeypatch.setattr(S, "STEP_LETTERS", 40)
    assert found(spark, words) == want


def test_words_of_documents(spark):
    rng = random.Random(4)
    names = ["Straße", "KÖNIGE", "éclair", "garden", "gardens", "short", "über", "x" * 40, "Ärgernis", "naïveté"]
    docs = [(k, " ".join(rng.choice(names) + rng.choice([" ", "1", "-", "\n"]) for _ in range(60))) for k in range(80)]
    docs += [(None, "garden " * 9), (7, None), (8, ""), (9, "12 !?")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1))
    runs = df.select("doc_id", F.explode(S.runs_of(F.col("text"))).alias("run"))
    words = S.vocabulary(runs.select(S.damaged(F.col("doc_id"), F.col("run")).alias("word")))
    got = {r.word: r.n for r in words.collect()}
    assert got == brute_words(docs)
    assert found(spark, got) == brute(got)


def test_chain_of_forms_is_followed_to_its_end(spark):
    words = {"aaaaaa" + "b" * k: 5 * 6**k for k in range(8)}
    rows = found(spark, words)
    assert rows == brute(words) and {r[2] for r in rows} == {"aaaaaabbbbbbb"}


def test_no_word_and_one_word(spark):
    assert S.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert found(spark, {"single": 9}) == {("single", None, "single", 9, 0, None)}


def test_very_long_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choices(S.LETTERS, k=70_000))
    words = {long: 5, long + "a": 40, long[:500] + "é" + long[501:]: 7, "shorty": 5}
    assert found(spark, words) == brute(words)


def test_blocks_meet_all_near_words(spark):
    """No near pair lies in blocks that do not meet, and no pair of blocks meets twice."""
    words = made(random.Random(9), 200)
    _, blocks = S.tiles_of(spark.createDataFrame(list(words.items()), "word string, n long"))
    pairs = [(r.one.split("#")[0], r.other.split("#")[0]) for r in S.tile_pairs(blocks).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    groups = {c: g for g in range(S.GROUPS) for c in S.LETTERS[g :: S.GROUPS]}
    name = lambda w: ",".join(str(sum(groups[c] == g for c in w)) for g in range(S.GROUPS))
    met = {frozenset(p) for p in pairs}
    names = list(words)
    assert all(frozenset((name(a), name(b))) in met for a in names for b in names if near(a, b))


def test_gram_matrix_gives_squared_distances():
    words = ["banana", "banané", "cabana", "abanan"]
    v = S.vectors(S.letters_of(words))
    d = S.squared_distances(v, v)
    assert d.tolist() == [[int(((a - b) ** 2).sum()) for b in v] for a in v]
    assert d[0, 3] == 0 and d[0, 1] == 2
    i, j = S.near_pairs(words, words, True)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1)] and isinstance(i, np.ndarray)
