"""Regex search over source lines and extracted records."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.session import materialise
from quillframe.sources.listing import lines

#: Defaults of the feature: hits returned, and characters of a line shown.
MAX_RESULTS = 20
SHOWN_CHARS = 120


def _matches(spark: SparkSession, pattern: str, text: Column) -> Column:
    """Case-insensitive match; a bad pattern is refused before any task runs.

    Classes such as ``\\w`` and ``\\b`` are the Unicode ones; as these match
    more slowly, they are only asked for where a pattern has one.
    """
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (PySparkException, Py4JJavaError) as problem:
        raise ValueError(f"Invalid regex pattern: {problem}") from problem
    flags = "iU" if re.search(r"\\[wdsbWDSB]", pattern) else "iu"
    return text.rlike(f"(?{flags}){pattern}")


def _found(hits: DataFrame, origin: str, rank: int, path: Column, name: Column) -> DataFrame:
    """Hits with their whole line; it is cut where it is shown."""
    return hits.select(
        F.lit(rank).alias("origin_rank"),
        F.lit(origin).alias("origin"),
        path.alias("path"),
        name.alias("name"),
        F.col("line_no").cast("long").alias("line_no"),
        tx.strip(F.col("line")).alias("line"),
    )


def matching_file_lines(files: DataFrame, pattern: str) -> DataFrame:
    """Every matching line of files given as (path, content bytes), whatever their
    type; bytes that are not UTF-8 become U+FFFD."""
    texts = files.select(
        "path",
        tx.base_name(F.col("path")).alias("filename"),
        tx.decode_lossy(F.col("content")).alias("content"),
    )
    return matching_lines(texts, pattern)


def matching_lines(documents: DataFrame, pattern: str) -> DataFrame:
    """Every matching line of documents with path, filename and content."""
    return matching_source_lines(lines(documents, "path", "filename"), pattern)


def matching_source_lines(source_lines: DataFrame, pattern: str) -> DataFrame:
    """The same over lines given as (path, filename, line_no, line)."""
    hits = source_lines.filter(_matches(source_lines.sparkSession, pattern, F.col("line")))
    return _found(hits, "source", 0, F.col("path"), F.col("filename"))


def matching_dump_lines(dump: DataFrame, pattern: str, name: str = "data.txt") -> DataFrame:
    """Every matching line of a dump given as (line_no, line)."""
    hits = dump.filter(_matches(dump.sparkSession, pattern, F.col("line")))
    return _found(hits, "extracted", 1, F.lit(name), F.lit(name))


def first_matches(
    found: DataFrame, max_results: int = MAX_RESULTS, shown_chars: int | None = SHOWN_CHARS
) -> DataFrame:
    """Sources before extracted records, then path and line order, lines cut to
    ``shown_chars`` (None: whole).

    Each task keeps its own first results, so the driver merges only those.
    """
    line = F.col("line") if shown_chars is None else F.substring("line", 1, shown_chars)
    return (
        found.orderBy("origin_rank", "path", "line_no")
        .limit(max_results)
        .select("origin", "name", "line_no", line.alias("line"))
    )


def search_all(
    sources: DataFrame,
    dump: DataFrame | None,
    pattern: str,
    max_results: int = MAX_RESULTS,
    shown_chars: int | None = SHOWN_CHARS,
) -> DataFrame:
    """First matches of source lines given as (path, filename, line_no, line), and
    of the dump for the places they leave open; else the dump is not read."""
    first = first_matches(matching_source_lines(sources, pattern), max_results, shown_chars)
    if dump is None:
        return first
    first = materialise(first.withColumn("_n", F.monotonically_increasing_id()), "hits")
    left = max_results - first.count()
    if left > 0:
        more = first_matches(matching_dump_lines(dump, pattern), left, shown_chars)
        first = first.unionByName(more.withColumn("_n", F.monotonically_increasing_id()))
    return first.orderBy(F.desc("origin"), "_n").drop("_n")


def search(
    documents: DataFrame,
    pattern: str,
    dump: DataFrame | None = None,
    max_results: int = MAX_RESULTS,
    shown_chars: int | None = SHOWN_CHARS,
) -> DataFrame:
    """:func:`search_all` over the lines of documents."""
    return search_all(lines(documents, "path", "filename"), dump, pattern, max_results, shown_chars)
