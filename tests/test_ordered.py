"""Window results must not change when a key is split into runs."""

import random
from itertools import groupby

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import ordered, relational


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = 1 if rng.random() < 0.5 else (None if rng.random() < 0.1 else rng.randint(2, 40))
        value = None if rng.random() < 0.1 else rng.randint(0, 50)
        rows.append((i, key, rng.randint(0, 200), value))
    return spark.createDataFrame(rows, "id long, k int, t int, v int").cache()


LIMITS = [10_000, 100]  # whole keys; the large key and the null key split


def as_map(df, name):
    return {r.id: r[name] for r in df.select("id", name).collect()}


def by_time():
    return Window.partitionBy("k").orderBy("t", "id")


@pytest.mark.parametrize("limit", LIMITS)
def test_running_sum(skewed, limit):
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    want = as_map(skewed.withColumn("x", F.sum("v").over(upto)), "x")
    got = as_map(ordered.running_sum(skewed, ["k"], ["t", "id"], "v", "x", limit), "x")
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
def test_row_numbers(skewed, limit):
    want = as_map(skewed.withColumn("x", F.row_number().over(by_time())), "x")
    assert as_map(ordered.row_numbers(skewed, ["k"], ["t", "id"], "x", limit), "x") == want


@pytest.mark.parametrize("limit", LIMITS)
def test_previous_value(skewed, limit):
    want = as_map(skewed.withColumn("x", F.lag("v").over(by_time())), "x")
    assert as_map(ordered.previous_value(skewed, ["k"], ["t", "id"], "v", "x", limit), "x") == want


@pytest.mark.parametrize("limit", [*LIMITS, 10])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(skewed, limit, descending):
    texts = F.when(F.col("v").isNotNull(), F.concat(F.lit("name "), F.col("v").cast("string")))
    rows = skewed.withColumns({"s": texts, "day": F.expr("date_add(DATE '2024-01-01', cast(v as int))")})
    for column in ("v", "s", "day"):
        by = F.desc(column) if descending else F.asc(column)
        window = Window.partitionBy("k").orderBy(by)
        plain = rows.withColumn("r", F.rank().over(window)).withColumn("d", F.dense_rank().over(window))
        got = ordered.ranks(rows, ["k"], column, descending, limit)
        assert as_map(got, "rank") == as_map(plain, "r")
        assert as_map(got, "dense_rank") == as_map(plain, "d")


@pytest.mark.parametrize("limit", LIMITS)
def test_asof_join(skewed, limit):
    left = skewed.filter("id < 1500").select("id", "k", "t")
    right = skewed.filter("id >= 1500").select("k", "t", "id", F.col("id").alias("rid"), "v")
    got = ordered.asof_join(left, right, ["k"], ["t", "id"], ["rid", "v"], limit)
    rows = skewed.collect()
    for r in got.collect():
        before = [
            x for x in rows
            if x.id >= 1500 and x.k is not None and x.k == r.k and x.t <= r.t
        ]
        best = max(before, key=lambda x: (x.t, x.id)) if before else None
        assert (r.rid, r.v) == ((best.id, best.v) if best else (None, None))
    assert got.count() == 1500


def test_ordinals_are_dense(skewed):
    got = ordered.with_ordinals(skewed, ["t", "id"], "n")
    rows = sorted(got.collect(), key=lambda r: (r.t, r.id))
    assert [r.n for r in rows] == list(range(1, 3001))
    assert ordered.with_ordinals(skewed.limit(0), ["t"], "n").count() == 0


@pytest.mark.parametrize("limit", [10_000, 10])
def test_quantiles(skewed, limit):
    got = relational.quantiles(skewed, ["k"], "v", [0.5, 0.9, 0, 1], list("abcd"), limit)
    want = skewed.groupBy("k").agg(
        *[F.percentile("v", p).alias(n) for p, n in zip([0.5, 0.9, 0, 1], "abcd")]
    )
    for g, w in zip(got.orderBy("k").collect(), want.orderBy("k").collect()):
        assert g.k == w.k
        assert [float(x) for x in g[1:]] == pytest.approx(list(w[1:]))


def test_interval_join(spark):
    points = spark.sql(
        "SELECT id, timestamp '2024-01-01' + make_interval(0,0,0,CAST(id AS INT)) AS at FROM range(400)"
    )
    spans = spark.sql(
        "SELECT * FROM VALUES (1, timestamp '2024-01-10', timestamp '2024-03-05'),"
        "(2, timestamp '2024-03-01', timestamp '2024-04-01'),"
        "(3, timestamp '2024-02-01', timestamp '2024-02-02') AS s(sid, a, b)"
    )
    got = relational.interval_join(points, spans, "at", "a", "b")
    want = points.join(spans, (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b")))
    pairs = sorted((r.id, r.sid) for r in got.collect())
    assert pairs == sorted((r.id, r.sid) for r in want.collect()) and len(pairs) > 50
    assert all(len(list(g)) == 1 for _, g in groupby(pairs))
