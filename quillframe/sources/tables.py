"""Tables on disk: Parquet as is, CSV with inferred or given types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillframe.sources.split_csv import read_split_csv


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A lazy scan: filters and column choices reach the files."""
    return spark.read.parquet(path)


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """A CSV file or folder with a header line.

    Without ``schema`` the types are inferred, which reads the data once more.
    Values may hold line breaks inside quotes, at the price of one task for each
    file. A caller who knows that there are none sets ``multi_line`` to False, and
    files are split over tasks. With ``split``, files with line breaks in quotes are
    split too, by :mod:`quillframe.sources.split_csv`.
    """
    if split:
        return read_split_csv(spark, path, schema)
    reader = spark.read.option("header", True).option("escape", '"').option(
        "multiLine", multi_line
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)
