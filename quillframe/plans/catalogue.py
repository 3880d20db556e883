"""The list of registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.operators.query import Workspace
from quillframe.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its name."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many tasks the caller wants for rendering and parsing. A Parquet file with a
#: single row group is one task whatever its rows cost; whoever has such files may
#: set this. Unset, only orders are shuffled for it, see :func:`dealt`.
RENDER_TASKS = "quillframe.render.tasks"


def costly(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are about to be rendered, dealt out if the caller asks."""
    tasks = spark.conf.get(RENDER_TASKS, None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(tasks)) if tasks else rows


def dealt(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """Short rows that become long texts, dealt out to several tasks a core, to as many
    as ``scan``, the table they come from, has, or to as many as the caller asks for: a
    file may have few row groups, whatever its rows cost."""
    spark = rows.sparkSession
    tasks = spark.conf.get(RENDER_TASKS, None)
    if tasks is None:
        tasks = max(scan.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(int(tasks))


def workspace(spark: SparkSession, sf_dir: str, *names: str) -> Workspace:
    """A workspace with the named tables registered."""
    ws = Workspace(spark)
    for name in names:
        ws.register_table(name, f"{sf_dir}/{name}.parquet")
    return ws
