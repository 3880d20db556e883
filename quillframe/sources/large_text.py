"""Numbered lines of text files of any size.

A document is one row, which ends at the size of a cell and is read by one
task. Here a file is split like any other large input: each split counts its
own lines, and the counts of the splits before it give the line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import text as tx

# Fixed value: line boundaries of str.splitlines() besides the line feed.
_INNER_BREAK = r"[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
_BOM_BYTES = 3


def numbered_lines(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, filename, line_no, line) of all text files below a folder.

    Bytes that are not UTF-8 become U+FFFD. The columns are those of
    :func:`quillframe.sources.listing.lines`, so searching works on them.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if pattern and pattern != "*":
        reader = reader.option("pathGlobFilter", pattern)
    # the carriage return of a line break goes, any other one is a break itself
    pieces = F.split(F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""), _INNER_BREAK)
    rows = reader.text(folder).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length("value") + 1).cast("long").alias("_bytes"),
        pieces.alias("_pieces"),
    )
    blocks = rows.groupBy("path", "_size", "_block").agg(
        F.sum(F.size("_pieces")).alias("_lines"),
        F.sum("_bytes").alias("_bytes"),
        F.max("_row").alias("_last_row"),
    )
    # one row per split from here: what lies before it, and the whole file
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # values come without line feeds: one byte too many says the last one is missing
    spare = F.sum("_bytes").over(whole) - F.col("_size")
    starts = blocks.select(
        F.col("path").alias("_path"),
        F.col("_block").alias("_at"),
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_start"),
        F.when(
            spare.isin(1, 1 - _BOM_BYTES) & (F.col("_block") == F.max("_block").over(whole)),
            F.col("_last_row"),
        ).alias("_open_row"),
    )
    placed = rows.join(
        starts, (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_at"))
    )
    # a break at the very end of a file starts no other line
    cut = (F.col("_row") == F.col("_open_row")) & (F.size("_pieces") > 1)
    cut = F.coalesce(cut, F.lit(False)) & (F.element_at("_pieces", -1) == "")
    lines = F.when(cut, F.slice("_pieces", F.lit(1), F.size("_pieces") - 1)).otherwise(F.col("_pieces"))
    # a split is at most spark.sql.files.maxPartitionBytes, and so its window
    before = Window.partitionBy("path", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.select(
        "path",
        lines.alias("_lines"),
        (F.col("_start") + F.coalesce(F.sum(F.size("_pieces")).over(before), F.lit(0))).alias("_start"),
    )
    return counted.select(
        "path",
        tx.base_name(F.col("path")).alias("filename"),
        "_start",
        F.posexplode("_lines").alias("_pos", "line"),
    ).select("path", "filename", (F.col("_start") + F.col("_pos") + 1).alias("line_no"), "line")


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path", "filename").agg(F.count(F.lit(1)).alias("line_count"))
