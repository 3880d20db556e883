"""What lies in a source folder: names, sizes, samples, line counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import FILES


def read_files(
    spark: SparkSession, folder: str, pattern: str | None = None, empty: bool = True
) -> DataFrame:
    """All files below ``folder`` as (path, modificationTime, length, content).

    The file source leaves out empty files. They are documents too, so with
    ``empty`` they are added from its list of names. Names starting with ``_``
    or ``.`` are left out, as everywhere in Spark. Content is only read when
    something downstream asks for that column.
    """
    files = _scan(spark, folder, pattern)
    if not empty:
        return files
    nothing_in_them = empty_files(spark, folder, pattern)
    return files if nothing_in_them.isEmpty() else files.unionByName(nothing_in_them)


def _scan(spark: SparkSession, folder: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern and pattern != "*":
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(*FILES.fieldNames())


def empty_files(
    spark: SparkSession, folder: str, pattern: str | None = None
) -> DataFrame:
    """Files of length zero: names the source listed but gives no row for.

    The names go from Spark's own file index to a table inside the JVM; the
    comparison is a join of names. The time of change is not part of it.
    """
    files = _scan(spark, folder, pattern)
    jvm = spark.sparkContext._jvm
    names = spark._jsparkSession.createDataset(
        jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles()),
        jvm.org.apache.spark.sql.Encoders.STRING(),
    )
    # names come as URIs: a plus sign stands for itself, and an empty host is
    # written out, which the paths of the scan leave away
    path = F.url_decode(F.replace(F.col("value"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
    listed = DataFrame(names.toDF(), spark).select(path.alias("path"))
    return listed.join(files.select("path"), "path", "left_anti").select(
        "path",
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.lit(0).cast("long").alias("length"),
        F.lit(b"").alias("content"),
    )


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def modified_at(spark: SparkSession, path: str) -> datetime:
    """Time of change of one file, for the files the scan does not deliver."""
    fs, jpath = _file_system(spark, path)
    return datetime.fromtimestamp(fs.getFileStatus(jpath).getModificationTime() / 1000)


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    """Only the files directly inside ``folder``, not in its subfolders."""
    fs, jpath = _file_system(files.sparkSession, folder)
    here = fs.makeQualified(jpath).toString().rstrip("/")
    return files.filter(F.regexp_replace("path", r"/[^/]*\z", "") == here)


def list_source_files(
    spark: SparkSession, folder: str, pattern: str = "*"
) -> DataFrame:
    """Files matching the pattern: in the folder, or if none there, below it."""
    files = read_files(spark, folder, pattern)
    direct = in_folder(files, folder)
    return describe_files(files if direct.isEmpty() else direct)


def describe_files(files: DataFrame) -> DataFrame:
    """Name, extension and a readable size per file; the content is not read."""
    name = tx.base_name(F.col("path"))
    suffix = _suffix(name)
    return files.select(
        "path",
        name.alias("name"),
        F.when(suffix == "", F.lit("(none)")).otherwise(suffix).alias("extension"),
        tx.size_label(F.col("length")).alias("size"),
    )


def _suffix(name: Column) -> Column:
    """Extension as written; a lone trailing dot counts as none."""
    return F.regexp_extract(name, r"(?s)[^.].*(\.[^.]+)\z", 1)


def file_info(files: DataFrame) -> DataFrame:
    """One row of facts per file, line count included."""
    name = tx.base_name(F.col("path"))
    return files.select(
        "path",
        name.alias("name"),
        _suffix(name).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        tx.line_count(tx.decode_lossy(F.col("content"))).cast("long").alias("line_count"),
    )


def lines(documents: DataFrame, *keep: str, text: str = "content") -> DataFrame:
    """One row per line with its 1-based number, next to the columns to keep.

    Lines come out of the row that holds the text, so nothing is shuffled.
    """
    return documents.select(
        *keep, F.posexplode(tx.split_lines(F.col(text))).alias("_pos", "line")
    ).select(*keep, (F.col("_pos") + 1).alias("line_no"), "line")


def file_sample(documents: DataFrame, *keep: str, max_lines: int = 50) -> DataFrame:
    """The first lines of each document and how many it has in all."""
    # counted before the lines are taken apart, not again for every line
    counted = documents.select(
        *keep, tx.split_lines(F.col("content")).alias("_lines")
    ).withColumn("total_lines", F.size("_lines"))
    return counted.select(
        *keep,
        "total_lines",
        F.posexplode(F.slice("_lines", 1, max_lines)).alias("_pos", "line"),
    ).select(*keep, "total_lines", (F.col("_pos") + 1).alias("line_no"), "line")


def hex_preview(files: DataFrame, n_bytes: int = 64) -> DataFrame:
    """First bytes in hexadecimal, for files that are not text."""
    return files.select(
        "path",
        "length",
        F.lower(F.hex(F.substring("content", 1, n_bytes))).alias("preview"),
    )


def file_path() -> Column:
    """The path of the file a row was read from, spelled as listings spell it: file
    sources give it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
