"""Order-dependent work that does not pile a hot key into one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. The
functions here count rows per key first (map-side combined, one narrow pass).
Keys within ``max_group_rows`` take the plain window. The rows of larger keys
are range-partitioned by key *and* order into runs; each run is worked on by
itself and small per-run totals carry the state from one run to the next. The
result is exact in both cases.

The ordering columns must be unique within a key, as they have to be for any
repeatable window result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillframe.session import materialise

#: Rows of one key that a single task may sort by itself.
MAX_GROUP_ROWS = 5_000_000

RUN = "_run"


def with_ordinals(
    df: DataFrame,
    order: Sequence[str],
    name: str = "doc_index",
    size: Column | None = None,
    offset_name: str = "offset",
) -> DataFrame:
    """Dense 1-based position over the whole table.

    Sorted range partitions are numbered locally and shifted by the sizes of
    the partitions before them: no single-task window. The sorted rows are
    written to the shared folder once, which pins the numbering if a task has
    to run again. Finding the ranges reads ``df`` one more time, so store it
    first if it is costly to compute.

    With ``size``, ``offset_name`` is the sum of it over all rows before.
    """
    local_bits = 33  # layout of monotonically_increasing_id
    rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    rows = materialise(rows, "ordinals").withColumns(
        {
            RUN: F.shiftright("_mid", local_bits),
            "_local": F.col("_mid").bitwiseAND(F.lit((1 << local_bits) - 1)),
        }
    )
    weight = F.lit(0) if size is None else size
    # one row per partition of the sort: small whatever the table holds
    sizes = rows.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_size")
    )
    before = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        RUN,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    numbered = rows.join(F.broadcast(shifts), RUN).withColumn(
        name, F.col("_shift") + F.col("_local") + 1
    )
    if size is not None:
        # a run is one sorted partition, so this window is bounded like one
        earlier = (
            Window.partitionBy(RUN)
            .orderBy("_local")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        here = F.coalesce(F.sum(size).over(earlier), F.lit(0))
        numbered = numbered.withColumn(offset_name, F.col("_offset") + here)
    return numbered.drop(RUN, "_mid", "_local", "_shift", "_offset")


@dataclass
class OrderedRuns:
    """Rows of ordinary keys, and rows of oversized keys tagged with a run."""

    cold: DataFrame
    hot: DataFrame | None
    keys: list[str]
    order: list[str | Column]

    def window(self, split: bool) -> WindowSpec:
        parts = [*self.keys, RUN] if split else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    def earlier_runs(self) -> WindowSpec:
        """Over one row per (key, run): the runs before, at most one per task
        of the sort."""
        return (
            Window.partitionBy(*self.keys)
            .orderBy(RUN)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def attach(self, carried: DataFrame, column: str) -> DataFrame:
        """Hot rows with the state their run starts with; keys may be null."""
        names = [*self.keys, RUN]
        renamed = carried.select(*[F.col(n).alias(f"_c_{n}") for n in names], column)
        on = _same(self.hot, renamed, names, "_c_")
        return self.hot.join(renamed, on, "left").drop(*[f"_c_{n}" for n in names])


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    pairs = [left[n].eqNullSafe(right[f"{prefix}{n}"]) for n in names]
    return reduce(Column.__and__, pairs)


def ordered_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> OrderedRuns:
    """Separate oversized keys and cut their rows into ordered runs.

    ``order`` takes column names or sort expressions such as ``col.desc()``.
    """
    keys, order = list(keys), list(order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # at most rows/max_group_rows keys can pass this filter
    large = sizes.filter(F.col("_n") > max_group_rows).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys]
    )
    if large.isEmpty():
        return OrderedRuns(df, None, keys, order)
    large = materialise(large, "hot-keys")
    on = _same(df, large, keys, "_h_")
    runs = (
        df.join(large, on, "left_semi")
        .repartitionByRange(*keys, *order)
        .withColumn(RUN, F.spark_partition_id())
    )
    # stored, so that the tags stay what they are if a task runs again
    return OrderedRuns(
        df.join(large, on, "left_anti"), materialise(runs, "runs"), keys, order
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key to the current row."""
    runs = ordered_runs(df, keys, order, max_group_rows)

    def upto(split: bool) -> Column:
        frame = runs.window(split).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return F.sum(value).over(frame)

    whole = runs.cold.withColumn(name, upto(split=False))
    if runs.hot is None:
        return whole
    totals = runs.hot.groupBy(*runs.keys, RUN).agg(F.sum(value).alias("_total"))
    carried = totals.withColumn("_before", F.sum("_total").over(runs.earlier_runs()))
    rows = runs.attach(carried, "_before").withColumn("_here", upto(split=True))
    # a sum without any value so far stays null, as in one plain window
    both = F.when(F.col("_before").isNull(), F.col("_here")).otherwise(
        F.col("_before") + F.coalesce("_here", F.lit(0))
    )
    return whole.unionByName(rows.withColumn(name, both).drop(RUN, "_before", "_here"))


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """1-based position of the row within its key."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, keys, order, "_one", name, max_group_rows).drop("_one")


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``value`` of the row before, within the key (a lag by one)."""
    runs = ordered_runs(df, keys, order, max_group_rows)
    whole = runs.cold.withColumn(name, F.lag(value).over(runs.window(split=False)))
    if runs.hot is None:
        return whole
    lasts = runs.hot.groupBy(*runs.keys, RUN).agg(
        F.max_by(F.struct(value), F.struct(*runs.order)).alias("_last")
    )
    by_run = Window.partitionBy(*runs.keys).orderBy(RUN)
    carried = lasts.withColumn("_before", F.lag("_last").over(by_run))
    rows = runs.attach(carried, "_before")
    window = runs.window(split=True)
    stepped = F.when(
        F.row_number().over(window) == 1, F.col(f"_before.{value}")
    ).otherwise(F.lag(value).over(window))
    return whole.unionByName(rows.withColumn(name, stepped).drop(RUN, "_before"))


def moving(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Column],
    before: int | float,
    after: int | float = 0,
    by: str = "rows",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Aggregates over a frame that moves with the row, from ``before`` to ``after``.

    ``by="rows"`` counts rows in the given order, which must be unique in a key;
    ``by="range"`` takes the rows whose single numeric ``order`` value is at most that
    far away, and a row without one has no frame and is in none. ``measures`` are
    aggregates such as ``{"mean": F.avg("x")}``.

    Oversized keys are cut into pieces. Each piece gets the rows of others that its
    own rows can see (its halo), works like a key of its own, and gives only its own
    rows. By rows, a piece is a stretch of row numbers no shorter than the frame; by
    range, it is a run, and one small row per run says which others see into it.
    """
    keys, order = list(keys), list(order)
    if by not in ("rows", "range"):
        raise ValueError(f"a frame goes by rows or range, not {by}")
    if by == "range" and len(order) != 1:
        raise ValueError("a frame by range has one order column")

    def framed(rows: DataFrame, parts: Sequence[str], at: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(*at)
        frame = window.rowsBetween(-before, after) if by == "rows" else window.rangeBetween(-before, after)
        seen = {n: m.over(frame) for n, m in measures.items()}
        if by == "range":
            seen = {n: F.when(F.col(at[0]).isNotNull(), m) for n, m in seen.items()}
        return rows.withColumns(seen)

    if by == "range":
        runs = ordered_runs(df, keys, order, max_group_rows)
        whole = framed(runs.cold, keys, order)
        if runs.hot is None:
            return whole
        value = order[0]
        bounds = runs.hot.groupBy(*keys, RUN).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        target = bounds.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(RUN).alias("_to"),
                               F.col("_low").alias("_to_low"), F.col("_high").alias("_to_high"))
        # pairs of runs: one row per task of the sort and run that sees into it
        sees = bounds.join(target, _same(bounds, target, keys, "_t_") & (F.col(RUN) != F.col("_to"))
                           & (F.col("_high") >= F.col("_to_low") - before) & (F.col("_low") <= F.col("_to_high") + after))
        sees = sees.select(*[F.col(k).alias(f"_c_{k}") for k in [*keys, RUN]], "_to", "_to_low", "_to_high")
        halo = runs.hot.join(sees, _same(runs.hot, sees, [*keys, RUN], "_c_")).where(
            F.col(value).between(F.col("_to_low") - before, F.col("_to_high") + after))
        halo = halo.withColumn("_own", F.lit(False)).withColumn(RUN, F.col("_to"))
        own = runs.hot.withColumn("_own", F.lit(True))
        both = own.unionByName(halo.select(*own.columns))
        split = framed(both, [*keys, RUN], order).where("_own").drop("_own", RUN)
        return whole.unionByName(split)

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > max_group_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    if large.isEmpty():
        return framed(df, keys, order)
    large = materialise(large, "hot-keys")
    on = _same(df, large, keys, "_h_")
    whole = framed(df.join(large, on, "left_anti"), keys, order)
    hot = row_numbers(df.join(large, on, "left_semi"), keys, order, "_at", max_group_rows)
    width = max(max_group_rows, before, after)
    piece = F.floor((F.col("_at") - 1) / width)
    place = F.col("_at") - piece * width  # 1 to width within the piece
    none = F.lit(None).cast("long")
    targets = F.array(
        piece,
        F.when(place > width - before, piece + 1).otherwise(none),
        F.when(place <= after, piece - 1).otherwise(none),
    )
    copied = hot.withColumn("_own", piece).withColumn("_piece", F.explode(F.array_compact(targets)))
    split = framed(copied, [*keys, "_piece"], ["_at"]).where("_piece = _own")
    return whole.unionByName(split.drop("_piece", "_own", "_at"))


def ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    descending: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``rank`` and ``dense_rank`` of ``value`` within its key.

    With oversized keys, equal values are counted before anything is sorted:
    the rank of a value is one more than the rows with a better one, so only
    (key, value) groups have to be brought in order.
    """
    keys = list(keys)
    # nulls come first going up and last going down, as in a plain window
    by = F.col(value).desc() if descending else F.col(value).asc()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.filter(F.col("_n") > max_group_rows).isEmpty():
        window = Window.partitionBy(*keys).orderBy(by)
        return df.withColumns(
            {"rank": F.rank().over(window), "dense_rank": F.dense_rank().over(window)}
        )
    peers = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_peers"))
    peers = materialise(peers, "peers")
    peers = running_sum(peers, keys, [by], "_peers", "_end", max_group_rows)
    peers = row_numbers(peers, keys, [by], "dense_rank", max_group_rows)
    ranked = peers.select(
        *[F.col(c).alias(f"_p_{c}") for c in [*keys, value]],
        (F.col("_end") - F.col("_peers") + 1).alias("rank"),
        "dense_rank",
    )
    on = reduce(
        Column.__and__,
        [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in [*keys, value]],
    )
    return df.join(ranked, on).drop(*[f"_p_{c}" for c in [*keys, value]])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Each left row with the last right row of its key at or before it.

    ``order`` is the as-of column followed by tie-breakers; it must be unique
    per key on either side. ``payload`` names the right columns to carry.
    Null keys match nothing, as in any equi-join.
    """
    keys, order = list(keys), list(order)
    at = order[0]
    right = right.dropna(subset=keys)
    tagged = left.select(
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_right"),
        *keys,
        *order,
        F.lit(1).alias("_side"),
    ).unionByName(
        right.select(
            F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"),
            F.struct(*payload).alias("_right"),
            *keys,
            *order,
            F.lit(0).alias("_side"),
        )
    )
    sequence = [at, "_side", *order[1:]]
    runs = ordered_runs(tagged, keys, sequence, max_group_rows)

    def latest(split: bool) -> Column:
        frame = runs.window(split).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return F.last("_right", ignorenulls=True).over(frame)

    matched = runs.cold.withColumn("_match", latest(split=False))
    if runs.hot is not None:
        lasts = runs.hot.groupBy(*keys, RUN).agg(
            F.max_by(
                "_right", F.when(F.col("_right").isNotNull(), F.struct(*sequence))
            ).alias("_last")
        )
        carried = lasts.withColumn(
            "_before", F.last("_last", ignorenulls=True).over(runs.earlier_runs())
        )
        rows = runs.attach(carried, "_before").withColumn("_here", latest(split=True))
        split = rows.withColumn("_match", F.coalesce("_here", "_before"))
        matched = matched.unionByName(split.drop(RUN, "_before", "_here"))
    return matched.filter(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col(f"_match.{c}").alias(c) for c in payload]
    )
