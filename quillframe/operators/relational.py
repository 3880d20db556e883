"""Relational patterns that Spark SQL has no direct form for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.ordered import MAX_GROUP_ROWS, running_sum
from quillframe.session import materialise


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    start: str,
    end: str,
    bucket: str = "month",
    salts: int = 8,
) -> DataFrame:
    """Points with the intervals [start, end) that hold them, inner.

    Each interval is listed once per calendar bucket it touches and a point
    falls in exactly one bucket, so this is an equi-join with a filter rather
    than a comparison of all pairs. Choose a bucket about as long as the
    intervals. Points are dealt over ``salts`` parts of their bucket and each
    interval is listed in all parts, so a bucket that holds much of the points
    is that many tasks; raise ``salts`` for hotter ones.
    """
    step = F.expr(f"INTERVAL 1 {bucket}")
    listed = intervals.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.date_trunc(bucket, start),
                F.date_trunc(bucket, F.col(end) - F.expr("INTERVAL 1 microsecond")),
                step,
            )
        ),
    )
    part = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")
    placed = points.withColumns({"_bucket": F.date_trunc(bucket, point), "_part": part})
    copied = listed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        placed.join(copied, ["_bucket", "_part"])
        .filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
        .drop("_bucket", "_part")
    )


#: Rows of one cell that are joined by one task; a larger cell is dealt to several.
MAX_CELL_ROWS = 100_000
#: Cells of neighbouring levels differ in length by this power of two.
LEVEL_BITS = 2


def _ends(df: DataFrame, start: str, end: str, unit: float | None) -> tuple[Column, Column]:
    """First and last grid point of a half-open span, as whole numbers in order."""
    kind = df.schema[start].dataType.typeName()
    first, last = F.col(start), F.col(end)
    if unit is not None or kind in ("double", "float", "decimal"):
        step = F.lit(float(unit or 1.0))
        return F.floor(first / step).cast("long"), F.floor(last / step).cast("long")
    whole = {
        "timestamp": F.unix_micros,
        "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")),
        "date": lambda c: F.unix_date(c).cast("long"),
    }.get(kind, lambda c: c.cast("long"))
    return whole(first), whole(last) - 1


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    keys: Sequence[str] = (),
    unit: float | None = None,
    max_cell_rows: int = MAX_CELL_ROWS,
) -> DataFrame:
    """All pairs of rows with equal ``keys`` whose spans [start, end) overlap, inner.

    Spans are of numbers, dates or times, of any length. Cells of every level cut the
    line evenly, those of the next level being longer by LEVEL_BITS; a span belongs to the
    level whose cells are as long as it, where it touches two at most. The longer span
    of a pair waits in its own cells, and the shorter one is listed in its cells of each
    level that longer ones use: O(log) rows for a span, and an equi-join. A pair counts
    in the cell that holds the later start, so it comes once. Of cells with many rows the
    waiting side is dealt to several tasks by a hash of the row, and the other is listed
    in each; only their number is counted beforehand.

    Spans of numbers with fractions lie on a grid of ``unit`` (1 by default): choose it
    below the usual length. Column names other than ``keys`` must differ between the
    sides. Spans with a null end or without a length have no pairs.
    """
    keys = list(keys)

    def prepared(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        low, high = _ends(df, *span, unit)
        valid = df.where(F.col(span[0]) < F.col(span[1])).withColumns({"_low": low, "_high": high})
        length = F.col("_high") - F.col("_low")
        bits = F.when(length <= 0, 0).otherwise(F.length(F.bin(length)))
        return valid.withColumn("_level", (F.ceil(bits / LEVEL_BITS) * LEVEL_BITS).cast("int"))

    def cell_of(place: Column, level: Column) -> Column:
        return F.call_function("shiftright", place, level)

    def cells(level: Column) -> Column:
        return F.array_distinct(F.array(cell_of(F.col("_low"), level), cell_of(F.col("_high"), level)))

    def pairs(own: DataFrame, other: DataFrame, or_equal: bool) -> DataFrame:
        """``own`` has the longer spans, or equal ones too."""
        used = sorted(r[0] for r in own.select("_level").distinct().collect())  # at most 64 / LEVEL_BITS
        if not used:
            used = [0]
        fits = lambda j: (j >= F.col("_level")) if or_equal else (j > F.col("_level"))
        waiting = own.withColumn("_cell", F.explode(cells(F.col("_level"))))
        levels = F.filter(F.array(*map(F.lit, used)), fits)
        listed = other.withColumn("_at", F.explode(levels)).withColumn("_cell", F.explode(cells(F.col("_at"))))
        place = [*keys, "_level", "_cell"]
        # at most rows / max_cell_rows cells pass this filter
        hot = waiting.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_cell_rows)
        hot = materialise(
            hot.select(*place, F.ceil(F.col("_n") / max_cell_rows).cast("int").alias("_parts")), "hot-cells"
        )
        dealt = F.pmod(F.xxhash64(*own.columns), F.coalesce("_parts", F.lit(1))).cast("int")
        waiting = waiting.join(hot, place, "left").withColumn("_part", dealt).drop("_parts")
        listed = listed.drop("_level").withColumnRenamed("_at", "_level").join(hot, place, "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        listed = listed.withColumn("_part", copies).drop("_parts")
        listed = listed.withColumnsRenamed({"_low": "_low2", "_high": "_high2"})
        met = waiting.join(listed, [*place, "_part"])
        once = F.col("_cell") == cell_of(F.greatest("_low", "_low2"), F.col("_level"))
        overlap = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
        return met.where(once & overlap)

    columns = [*keys, *(c for c in [*left.columns, *right.columns] if c not in keys)]
    a, b = prepared(left, left_span), prepared(right, right_span)
    return pairs(a, b, True).select(*columns).unionByName(pairs(b, a, False).select(*columns))


def distinct_counts(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], exact: bool = True
) -> DataFrame:
    """Distinct values per column and key; sketches instead of ``exact``."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.groupBy(*keys).agg(*[count(F.col(c)).alias(f"distinct_{c}") for c in columns])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles per key; null values do not count.

    Equal values are counted first (combined before the shuffle). Their running
    count then tells which value sits at a position, so no task has to hold the
    values of a whole key.
    """
    keys = list(keys)
    # stored: the running counts and the totals both come from this one scan
    counted = materialise(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n")),
        "counted",
    )
    upto = running_sum(counted, keys, [value], "_n", "_upto", max_group_rows)
    totals = counted.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.sum("_n").alias("_total")
    )
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    placed = upto.join(totals, on)

    def at(position: Column) -> Column:
        here = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(here, F.col(value)))

    picks, results = [], []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        position = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(position)).alias(f"_lo{i}"),
            at(F.ceil(position)).alias(f"_hi{i}"),
            F.max(position - F.floor(position)).alias(f"_part{i}"),
        ]
        gap = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        results.append((F.col(f"_lo{i}") + gap * F.col(f"_part{i}")).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *results)
