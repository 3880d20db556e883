"""Overlaps of spans and moving frames, against brute force and plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import ordered, relational


def spans(rng, n, scale, kinds):
    out = []
    for i in range(n):
        start = rng.randint(-scale, scale)
        out.append((i, rng.choice(kinds), start, start + rng.choice([0, 1, 2, 30, scale])))
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [relational.MAX_CELL_ROWS, 3])
def test_overlaps_of_whole_numbers(spark, limit):
    rng = random.Random(2)
    a, b = spans(rng, 120, 1000, ["x", "y", None]), spans(rng, 120, 1000, ["x", "y", None])
    a += [(900, "x", None, 5), (901, "x", 7, 3)]
    left = spark.createDataFrame(a, "i long, k string, s long, e long")
    right = spark.createDataFrame(b, "j long, k string, t long, f long")
    found = relational.overlap_join(left, right, ("s", "e"), ("t", "f"), ["k"], max_cell_rows=limit)
    assert found.columns == ["k", "i", "s", "e", "j", "t", "f"]
    want = sorted((i, j) for i, k, s, e in a for j, m, t, f in b
                  if k is not None and k == m and None not in (s, t) and s < e and t < f and s < f and t < e)
    rows = found.select("i", "j").collect()
    assert sorted(map(tuple, rows)) == want and len(want) > 200
    every = relational.overlap_join(left.drop("k"), right.drop("k"), ("s", "e"), ("t", "f"), max_cell_rows=limit)
    n = sum(s is not None and s < e and t < f and s < f and t < e for _, _, s, e in a for _, _, t, f in b)
    assert every.count() == n
    assert "NestedLoop" not in plan_of(every) and "Cartesian" not in plan_of(every)


def test_overlaps_of_times_dates_and_fractions(spark):
    rng = random.Random(3)
    day = dt.datetime(2020, 1, 1)
    raw = [(i, rng.random() * 400 - 200, rng.choice([0.01, 3.5, 80.0])) for i in range(80)]
    rows = [(i, day + dt.timedelta(days=s), day + dt.timedelta(days=s + n), s, s + n) for i, s, n in raw]
    df = spark.createDataFrame(rows, "i long, ts timestamp, te timestamp, s double, e double")
    df = df.withColumns({"ds": F.to_date("ts"), "de": F.to_date("te")})
    other = df.select(*[F.col(c).alias(f"{c}2") for c in df.columns])
    for start, end, unit in (("ts", "te", None), ("s", "e", None), ("s", "e", 0.25), ("ds", "de", None)):
        found = relational.overlap_join(df, other, (start, end), (f"{start}2", f"{end}2"), unit=unit)
        values = df.select("i", start, end).collect()
        want = sorted((a[0], b[0]) for a in values for b in values if a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
        assert sorted(map(tuple, found.select("i", "i2").collect())) == want


def test_no_spans(spark):
    left = spark.createDataFrame([], "s long, e long")
    right = spark.createDataFrame([(1, 2)], "t long, f long")
    assert relational.overlap_join(left, right, ("s", "e"), ("t", "f")).collect() == []
    assert relational.overlap_join(right, left, ("t", "f"), ("s", "e")).collect() == []


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, *range(60)]), rng.randint(0, 50)) for i in range(600)]
    return spark.createDataFrame(rows, "k string, i long, v long, x long").cache()


def measures():
    return {"total": F.sum("x"), "n": F.count("*"), "low": F.min("x")}


@pytest.mark.parametrize("before,after", [(0, 0), (6, 0), (3, 2), (0, 9), (500, 1)])
@pytest.mark.parametrize("limit", [10_000, 37, 400])
def test_frames_by_rows(spark, table, before, after, limit):
    frame = Window.partitionBy("k").orderBy("i").rowsBetween(-before, after)
    want = table.withColumns({n: m.over(frame) for n, m in measures().items()})
    found = ordered.moving(table, ["k"], ["i"], measures(), before, after, max_group_rows=limit)
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("before,after", [(0, 0), (5, 0), (2, 3), (100, 100)])
@pytest.mark.parametrize("limit", [10_000, 37])
def test_frames_by_range(spark, table, before, after, limit):
    frame = Window.partitionBy("k").orderBy("v").rangeBetween(-before, after)
    want = table.withColumns({n: F.when(F.col("v").isNotNull(), m.over(frame)) for n, m in measures().items()})
    found = ordered.moving(table, ["k"], ["v"], measures(), before, after, "range", max_group_rows=limit)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_wrong_frames(spark, table):
    with pytest.raises(ValueError, match="rows or range"):
        ordered.moving(table, ["k"], ["i"], measures(), 1, by="groups")
    with pytest.raises(ValueError, match="one order column"):
        ordered.moving(table, ["k"], ["i", "v"], measures(), 1, by="range")
