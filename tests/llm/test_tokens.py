"""Token counts: spliced chunks against whole texts."""

import random

import pytest

from quillframe.llm import tokens


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return tokens.PieceCounter(str(public_tokenizers.path(tokens.MODEL)))


def texts():
    rng = random.Random(2)
    words = ["the", "Übung", "  ", "\n", "x" * 40, "日本語", "😀", "▁", "<s>", "a.b,c", "\t", "0x1F", "　", "é"]
    yield "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(3000))
    yield " " * 3000
    yield "a" * 3000
    yield "日" * 1500 + "▁" * 1500
    yield "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(4000))
    yield "no spaces at all".replace(" ", "") * 300
    yield "".join(rng.choice("ab \n") for _ in range(5000))


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 4), (200, 1), (333, 64), (1000, 2)])
def test_spliced_counts(model, chunk, overlap):
    for text in texts():
        assert model.count_long(text, chunk, overlap) == len(model.model.encode(text)), text[:40]


@pytest.mark.parametrize("run", ["a" * 400_000, "日本" * 60_000, " " * 200_000])
def test_a_long_unstable_run_is_encoded_a_few_times_only(model, run):
    text = run + " and then some plain prose follows." * 20_000
    encoded = []
    whole = model.boundaries
    counting = lambda t, a, b: encoded.append(b - a) or whole(t, a, b)
    model.boundaries = counting
    try:
        assert model.count_long(text) == len(model.model.encode(text))
    finally:
        del model.boundaries
    assert sum(encoded) < 4 * len(text)


def test_table(spark):
    import public_tokenizers

    rows = [(1, None, 5), (2, "", 5), (3, " ", 5), (4, "Hello  world </s>", 5), (4, "Hello  world </s>", 5),
            (None, "x", 5), (6, "lorem ipsum " * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = str(public_tokenizers.path(tokens.MODEL))
    model = tokens.PieceCounter(path).model
    got = sorted(tuple(r) for r in tokens.token_counts(df.na.fill({"doc_id": 0}), path).collect())
    want = sorted((k or 0, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for k, t, _ in rows)
    assert got == want
    assert tokens.token_counts(df.limit(0), path).count() == 0


def test_documents(spark):
    df = tokens.op1_token_counts(spark, "/root/testdata/sf0.001")
    import public_tokenizers

    model = tokens.PieceCounter(str(public_tokenizers.path(tokens.MODEL))).model
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in df.collect()} == {k: len(model.encode(t)) for k, t in texts.items()}
