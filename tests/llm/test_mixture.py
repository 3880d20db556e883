"""Poisson replication: the distribution, target shares, repeatable copies."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.llm import mixture


def test_distribution_function(spark):
    means = [0.0, 0.001, 0.5, 1.0, 7.5, 32.0]
    rows = spark.createDataFrame([(m,) for m in means], "m double").select("m", mixture.cumulative(F.col("m")).alias("c"))
    for row in rows.collect():
        for k in range(40):
            want = sum(math.exp(-row.m) * row.m**i / math.factorial(i) for i in range(k + 1))
            assert row.c[k] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("rate", [0.3, 1.0, 4.0, 100.0])
def test_counts_have_mean_and_variance(spark, rate):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a' AS source", "'t' AS text")
    rates = spark.createDataFrame([("a", rate)], "source string, rate double")
    n = Counter(r.doc_id for r in mixture.replicate(docs, rates).select("doc_id").collect())
    counts = [n[i] for i in range(3000)]
    mean = sum(counts) / 3000
    spread = sum((c - mean) ** 2 for c in counts) / 3000
    assert mean == pytest.approx(rate, rel=0.12) and spread == pytest.approx(rate, rel=0.2)


def test_shares_follow_the_weights(spark):
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "if(id % 6 < 4, 'big', if(id % 6 = 4, 'mid', null)) AS source", "repeat('x', 10) AS text", "id AS copy"
    )
    rates = mixture.source_rates(docs, weights={"big": 1.0, "mid": 1.0, None: 2.0})
    rows = mixture.replicate(docs, rates, copy="nth").collect()
    shares = Counter(r.source for r in rows)
    assert len(rows) == pytest.approx(6000, rel=0.06)
    assert shares[None] / len(rows) == pytest.approx(0.5, abs=0.03)
    assert shares["big"] / len(rows) == pytest.approx(0.25, abs=0.03)
    assert all(r.copy == r.doc_id and r.nth >= 1 for r in rows)  # columns of that name stay
    again = mixture.replicate(docs.repartition(7), rates, copy="nth").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    other = mixture.replicate(docs, rates, copy="nth", seed=5).collect()
    assert sorted(map(str, rows)) != sorted(map(str, other))


def test_order_is_mixed(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "if(id < 1000, 'a', 'b') AS source", "'t' AS text")
    sources = [r.source for r in mixture.replicate(docs, mixture.source_rates(docs)).collect()]
    changes = sum(a != b for a, b in zip(sources, sources[1:]))
    assert changes > len(sources) / 3


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (None, "text", None), (3, "x" * 1_000_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixture.source_rates(docs).collect()}
    assert rates["a"] == 1.0
    n = Counter(r.doc_id for r in mixture.replicate(docs, mixture.source_rates(docs)).collect())
    assert n[1] % 2 == 0
    empty = docs.limit(0)
    assert mixture.replicate(empty, mixture.source_rates(empty)).count() == 0
    with pytest.raises(ValueError, match="has a weight"):
        mixture.source_rates(docs, weights={"zzz": 1.0})
