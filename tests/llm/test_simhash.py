"""SimHash groups against brute force over all pairs."""

import random
import re

import xxhash

from quillframe.llm import simhash


def brute_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest key reachable through links of four bits or fewer."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts():
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(300)]
    rows = {}
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows[len(rows)] = " ".join(copy)
    rows[len(rows)] = None
    rows[len(rows)] = ""
    rows[len(rows)] = " \t\n\x0b\x0c\r "
    rows[len(rows)] = "One TWO\x1cthree"
    rows[len(rows)] = "one two\x1cthree"
    rows[len(rows)] = "Æ Å ß one two three four five"
    return rows


def test_fingerprints_and_components(spark):
    rows = texts()
    df = spark.createDataFrame([(k, v, "x") for k, v in rows.items()], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {k: brute_print(v) for k, v in rows.items()}
    assert {k: r.fp % (1 << 64) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == brute_components(prints)


def test_random_prints_close_together(spark):
    """Chains, buckets larger than a block, and every table's bits."""
    rng = random.Random(5)
    prints, center = set(), rng.getrandbits(64)
    for _ in range(250):
        value = center
        for _ in range(rng.randrange(9)):
            value ^= 1 << rng.randrange(64)
        prints.add(value)
    chain = rng.getrandbits(64)
    for step in range(12):
        prints.add(chain)
        for b in range(4):
            chain ^= 1 << (step * 5 + b) % 64
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.fp: r.class_fp for r in simhash.near_classes(df, block=16).collect()}
    order = {signed(p): p for p in prints}
    label = brute_components({k: v for k, v in order.items()})
    assert got == label


def test_every_close_pair_shares_a_bucket():
    rng = random.Random(1)
    masks = simhash.covering_masks()
    assert len(masks) == 31
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randrange(5))
        change = sum(1 << b for b in bits)
        assert any(m & change == 0 for m in masks)


def broadcast_explodes(df):
    """Explodes below a broadcast in the plan of ``df``, whose size Spark has guessed."""
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search("[A-Za-z]", line)
        if not depth:
            continue
        if below is not None and depth.start() <= below:
            below = None
        if below is None and line[depth.start() :].startswith("BroadcastExchange"):
            below = depth.start()
        elif below is not None and line[depth.start() :].startswith("Generate"):
            found.append(line.strip())
    return found


def test_rows_of_all_tables_are_never_broadcast(spark, monkeypatch):
    plans, store = {}, simhash.materialise

    def stored(df, label):
        plans.setdefault(label, []).append(broadcast_explodes(df))
        return store(df, label)

    monkeypatch.setattr(simhash, "materialise", stored)
    df = spark.createDataFrame([(i, f"a b c d e f{i % 9}") for i in range(40)], "doc_id long, text string")
    plans["result"] = [broadcast_explodes(simhash.near_duplicates(df))]
    assert {"stars", "open-buckets"} <= set(plans) and not [p for ps in plans.values() for p in ps if p]


def test_one_of_each_keeps_other_columns_and_repeated_rows_once(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "a"), (2, text, "b"), (3, "other words here now", "c"), (3, "other words here now", "c"),
            (None, text, "d"), (None, "lonely", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.one_of_each(df).collect())
    assert got == [(0, "d"), (0, "e"), (1, "a"), (3, "c")]


def test_keys_with_several_texts_lose_no_component(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(80))
    a, b, c, d = words("alpha"), words("beta"), words("gamma"), words("delta")
    rows = [(5, a), (7, a), (5, b), (3, b), (8, c), (8, d), (8, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(df).collect())
    assert got == sorted([(5, a), (3, b), (8, c), (8, d)])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.one_of_each(df).count() == 0


def test_long_text(spark):
    text = "lorem ipsum dolor sit amet " * 20_000
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    row = simhash.near_duplicates(df).first()
    assert row.component_id == 7 and row.fp % (1 << 64) == brute_print(text)
