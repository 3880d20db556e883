"""Toxicity: held-out accuracy, folds, and tables without labels."""

import random
import zlib

from quillframe.llm import toxicity


def corpus(n=1500):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "elo", "iru", "osta", "unimi", "é", "ärk")]
    rude = ["vexor", "vexim", "grulk", "Zzark"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([8, 60, 300]))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randrange(2, 6)):
            text[rng.randrange(len(text))] = rng.choice(rude)
        docs.append((i, " ".join(text), "x", 0.5))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(9001, None, "x", 0.5), (9002, "", "x", 0.5), (9003, "vexor " * 50_000, "x", 0.5), (None, "vexor", "x", 0.5)]
    df = spark.createDataFrame(docs + extra + docs[:5], "doc_id long, text string, source string, score double")
    marks = spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, marks)
    assert 0 < len(model.places) < 4000
    rows = toxicity.toxicity(df, model).collect()
    assert len(rows) == len(docs) + len(extra) + 5
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert len(held) > 300 and right > 0.97
    empty = {r.doc_id: r.score for r in rows if r.doc_id in (9001, 9002)}
    assert empty[9001] == empty[9002] < 0.5


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    models = [
        toxicity.fit_toxicity(df, spark.createDataFrame(rows, "doc_id long, toxic int")) for rows in (labels, turned)
    ]
    assert (models[0].places == models[1].places).all() and (models[0].weights == models[1].weights).all()


def test_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, none)
    assert model is None
    assert [tuple(r) for r in toxicity.toxicity(df, model).select("score", "predicted").collect()] == [(0.0, 0)]
    assert toxicity.toxicity(df.limit(0), model).count() == 0
