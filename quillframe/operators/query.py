"""SQL over registered tables, with paging and a total row count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.model import ColumnInfo, QueryResult
from quillframe.session import RUNTIME_CONF, materialise
from quillframe.sources.tables import read_csv_table, read_parquet_table

PAGE_ROWS = 1000

#: Settings of a workspace only: quoted names are identifiers, and a query
#: cannot reach files that nobody registered.
SQL_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
}
_INHERITED = (
    "spark.sql.shuffle.partitions",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.autoBroadcastJoinThreshold",
)


class Workspace:
    """Named tables and the queries over them.

    It has its own SQL session, so table names and settings of two workspaces
    do not meet, while executors and cached data are shared.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark.newSession()
        for key in _INHERITED:
            value = spark.conf.get(key, None)
            if value is not None:
                self.spark.conf.set(key, value)
        for key, value in {**RUNTIME_CONF, **SQL_CONF}.items():
            self.spark.conf.set(key, value)
        self._cursors: dict[str, Cursor] = {}

    def register_table(self, name: str, path: str) -> DataFrame:
        """A Parquet table under a name, replacing an earlier one.

        It stays a scan: a query reads only the columns and row groups it needs.
        """
        try:
            table = read_parquet_table(self.spark, path)
        except PySparkException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"there is no table at {path}") from problem
            raise ValueError(f"cannot read the table at {path}: {problem}") from problem
        except Py4JJavaError as problem:
            raise ValueError(f"cannot read the table at {path}: {problem}") from problem
        self._replace(name, table)
        return table

    def _replace(self, name: str, table: DataFrame) -> None:
        table.createOrReplaceTempView(name)
        self._cursors.clear()  # results of what the name meant before

    def register_csv(
        self, name: str, path: str, multi_line: bool = True, split: bool = False
    ) -> DataFrame:
        table = read_csv_table(self.spark, path, multi_line=multi_line, split=split)
        self._replace(name, table)
        return table

    def query(self, sql: str) -> DataFrame:
        """The result of a query as a DataFrame, nothing run yet."""
        return self.spark.sql(sql.strip().rstrip(";"))

    def allow_recursion(self, levels: int) -> None:
        """Let recursive queries go on for at least ``levels`` steps, with any number of
        rows; Spark's own limits are 100 steps and a million rows."""
        key = "spark.sql.cteRecursionLevelLimit"
        self.spark.conf.set(key, str(max(levels + 1, int(self.spark.conf.get(key)))))
        self.spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    def cursor(self, sql: str) -> Cursor:
        """The stored result of a query: it runs once for all its pages, until a
        table is registered anew. Tables are taken as they are at that time."""
        key = sql.strip().rstrip(";")
        if key not in self._cursors:
            self._cursors[key] = Cursor(self.query(key))
        return self._cursors[key]

    def page(self, sql: str, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
        """One page. Pages only fit together if the query orders all rows.

        The first page is the first rows of the query; later ones come from its cursor.
        """
        return self.cursor(sql).page(limit, offset) if offset else self.query(sql).limit(limit)

    def total(self, sql: str) -> DataFrame:
        return self.query(sql).agg(F.count(F.lit(1)).alias("total_rows"))

    def execute_sql(
        self, sql: str, limit: int = PAGE_ROWS, offset: int = 0
    ) -> QueryResult:
        """A page of rows on the driver, and how many rows there are in all."""
        try:
            stored = self.cursor(sql) if offset else None
            total = stored.total if stored else self.total(sql).first()[0]
            page = self.query(sql) if offset >= total else self.page(sql, limit, offset)
            # at most `limit` rows; a page past the end needs none of them
            rows = [] if offset >= total else [list(row) for row in page.collect()]
        except (PySparkException, Py4JJavaError) as problem:
            raise ValueError(f"SQL error: {problem}") from problem
        return QueryResult(columns_of(page), rows, total, sql)

    def describe(self, name: str) -> list[ColumnInfo]:
        return columns_of(self.spark.table(name))


class Cursor:
    """A result kept as its tasks made it, sorted range by sorted range.

    The number of rows in each range says which ranges hold a page, and only their
    rows are read again. Nothing collects the rows before the page.
    """

    _LOCAL_BITS = 33  # layout of monotonically_increasing_id

    def __init__(self, result: DataFrame) -> None:
        self.columns = result.columns
        names = [f"c{i}" for i in range(len(self.columns))]  # SQL may repeat names
        numbered = result.toDF(*names).withColumn("_row", F.monotonically_increasing_id())
        self.stored = materialise(numbered, "page")
        ranges = self.stored.groupBy(F.shiftright("_row", self._LOCAL_BITS).alias("range")).agg(
            F.count(F.lit(1)).alias("n")
        )
        self.ranges = sorted((r.range, r.n) for r in ranges.collect())  # one per task of the result
        self.total = sum(n for _, n in self.ranges)

    def page(self, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in the order of the result."""
        at, wanted = 0, F.lit(False)
        for number, n in self.ranges:
            low, high = max(offset - at, 0), min(offset + limit - at, n)
            if low < high:
                first = number << self._LOCAL_BITS
                wanted = wanted | F.col("_row").between(first + low, first + high - 1)
            at += n
        return self.stored.filter(wanted).sort("_row").drop("_row").toDF(*self.columns)

    def pages(self, limit: int = PAGE_ROWS) -> Pages:
        return Pages(self, limit)


@dataclass
class Pages:
    """The pages of a stored result, one by one or all in one table."""

    cursor: Cursor
    limit: int

    def __iter__(self) -> Iterator[DataFrame]:
        return (self.cursor.page(self.limit, at) for at in range(0, self.cursor.total, self.limit))

    def numbered(self, name: str = "page") -> DataFrame:
        """All rows in one scan, next to the number of their page, from 0; unsorted.

        A row's place is that of its range plus its place there.
        """
        stored, bits = self.cursor.stored, self.cursor._LOCAL_BITS
        before = accumulate((n for _, n in self.cursor.ranges), initial=0)
        starts = stored.sparkSession.createDataFrame(
            [(number, at) for (number, _), at in zip(self.cursor.ranges, before)], "_range long, _before long"
        )
        local = F.col("_row").bitwiseAND(F.lit((1 << bits) - 1))
        placed = stored.withColumns({"_range": F.shiftright("_row", bits), "_local": local}).join(
            F.broadcast(starts), "_range"  # a row per task of the result
        )
        page = F.expr(f"(_before + _local) DIV {self.limit}").alias("_page")
        columns = [F.col(f"c{i}") for i in range(len(self.cursor.columns))]
        return placed.select(page, *columns).toDF(name, *self.cursor.columns)


def rows_between(result: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a result in its own order."""
    return Cursor(result).page(limit, offset)


def columns_of(df: DataFrame) -> list[ColumnInfo]:
    return [ColumnInfo(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: type, non-null and distinct count, min, max, mean.

    Nested and binary columns are counted too; they have no smallest or largest
    value.

    Each column is read and reduced by itself: to its distinct values with
    their counts (combined before the shuffle), then to one row. On a columnar
    table that reads every column once, and a value that fills much of a column
    is one row per task by the time it is shuffled.
    """
    return reduce(DataFrame.unionByName, [_profile_column(df, f) for f in df.schema.fields])


def _profile_column(df: DataFrame, field: T.StructField) -> DataFrame:
    column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    if "map<" in kind or "variant" in kind:  # equal maps may be written in several ways
        column = F.to_json(column if isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.struct(column))
    values = df.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(F.col("v").isNotNull(), F.col("n"))
    if isinstance(field.dataType, T.NumericType):
        mean = F.try_divide(F.sum(F.col("v").cast("double") * seen), F.sum(seen))
    else:
        mean = F.lit(None).cast("double")
    return values.agg(
        F.coalesce(F.sum(seen), F.lit(0)).alias("non_null"),
        F.count("v").alias("distinct_values"),
        (F.lit(None) if nested else F.min("v")).cast("string").alias("min_value"),
        (F.lit(None) if nested else F.max("v")).cast("string").alias("max_value"),
        mean.alias("mean_value"),
    ).select(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("column_type"),
        "non_null",
        "distinct_values",
        "min_value",
        "max_value",
        "mean_value",
    )


#: Relative standard error of the distinct counts is 1.04 / sqrt(2 ** LOG_BUCKETS).
LOG_BUCKETS = 14
#: Size of the quantile sketches: ranks are off by less than about 2.3 / RANK_K.
RANK_K = 400


def column_sketches(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column and group: counts and sketches that can be merged.

    One scan with partial sketches in every task. The table may be stored, for
    instance per day, and :func:`profile_of_sketches` merges any part of it. Columns:
    ``by``, column_name, column_type, rows, non_null, distinct_sketch, rank_sketch
    (of numbers), min_value and max_value (of values that can be ordered, as text).
    """
    by, rows = list(by), F.count(F.lit(1)).alias("rows")
    names = [f for f in df.schema.fields if f.name not in by]
    parts = []
    for i, f in enumerate(names):
        column, nested = F.col(f"`{f.name}`"), isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        ordered = not nested and not isinstance(f.dataType, T.BinaryType)
        # values of all types meet as text or, where that is long, as a hash of it
        value = F.to_json(F.struct(column)) if nested else column.cast("string")
        text = F.when(column.isNotNull(), value)
        number = column.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.count(column).alias("non_null"),
                F.hll_sketch_agg(text, LOG_BUCKETS).alias("distinct_sketch"),
                F.kll_sketch_agg_double(number, RANK_K).alias("rank_sketch"),
                (F.min(column).cast("string") if ordered else F.lit(None).cast("string")).alias("min_value"),
                (F.max(column).cast("string") if ordered else F.lit(None).cast("string")).alias("max_value"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
            ).alias(f"p{i}")
        )
    found = df.groupBy(*by).agg(rows, *parts)
    return found.select(*by, "rows", F.inline(F.array(*[f"p{i}" for i in range(len(names))])))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """A profile of all groups together: column_name, column_type, rows, non_null,
    distinct_values, median_value."""
    merged = sketches.groupBy("column_name", "column_type").agg(
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.kll_merge_agg_double("rank_sketch", RANK_K).alias("_ranks"),
    )
    empty = F.coalesce(F.kll_sketch_get_n_double("_ranks"), F.lit(0)) == 0
    median = F.when(~empty, F.kll_sketch_get_quantile_double("_ranks", F.lit(0.5)))
    return merged.withColumn("median_value", median).drop("_ranks")
