"""CSV with line breaks inside quotes, read in splits.

A task that starts in the middle of a file cannot see whether its first line
lies inside quotes. But every line is a function of that: entered outside or
inside quotes, it is left outside or inside. Such functions compose, so each
split is one of four functions too. A prefix over one row per split tells how
each split starts, and from there every line knows which record it belongs to.

Records are those of :mod:`quillframe.sources.csv_documents`: a field that starts
with a quote runs to its closing quote, in other fields quotes are ordinary
characters, and a quote that is never closed takes the rest of the file. Lines
end with a line feed, or a carriage return and a line feed. Bytes that are not
UTF-8 become U+FFFD. Blank lines outside quotes are not rows of a table, but they
are numbered as records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.model import METADATA
from quillframe.session import materialise
from quillframe.sources import csv_documents
from quillframe.sources.listing import file_path

LINES = {"recursiveFileLookup": "true", "lineSep": "\n"}
BOM_BYTES = 3
#: What a line does to the state "inside quotes": it leaves the state as it is,
#: turns it over, or ends outside or inside whatever it was before.
KEEP, TURN, OUTSIDE, INSIDE = 0, 1, 2, 3

#: Types in the order in which an unknown column is tried; text takes the rest.
TRIED_TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")


def effect(line: Column) -> Column:
    """Which of the four functions a line is."""
    # entered inside quotes, a line goes on as if it began with the quote
    out, inside = line.rlike(csv_documents._UNCLOSED), F.concat(F.lit('"'), line).rlike(csv_documents._UNCLOSED)
    return (
        F.when(~out & inside, KEEP).when(out & ~inside, TURN).when(out, INSIDE).otherwise(OUTSIDE)
    )


def _state(fixed: Column, turns: Column, start: Column | int = 0) -> Column:
    """0 or 1, from the last line that fixes it (state and turns until then) and
    all turns so far."""
    state = F.coalesce(fixed["state"], start if isinstance(start, Column) else F.lit(start))
    return F.pmod(state + turns - F.coalesce(fixed["turns"], F.lit(0)), F.lit(2))


def numbered_records(spark: SparkSession, path: str, paths: DataFrame | None = None) -> DataFrame:
    """``path, record_no, record`` of all CSV files at a path, records from 1.

    ``paths`` names the files, if not all are meant. The lines of a split are dealt to one task, which they came from; only the
    lines of records that span several are gathered.
    """
    rows = spark.read.options(**LINES).text(path).select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.make_valid_utf8("value").alias("line"),
    )
    if paths is not None:
        rows = rows.join(paths.select("path"), "path", "left_semi")
    rows = rows.withColumn("effect", effect(F.regexp_replace("line", r"\r\z", "")))
    here = Window.partitionBy("path", "block").orderBy("row")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("turns", F.sum((F.col("effect") == TURN).cast("int")).over(upto))
    fixed = F.when(F.col("effect") >= OUTSIDE, F.struct((F.col("effect") - OUTSIDE).alias("state"), "turns"))
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(upto))
    # the state before a line is that behind the line before it
    last = {n: F.lag(n).over(here) for n in ("turns", "fixed")}
    rows = rows.withColumns({"turns_before": F.coalesce(last["turns"], F.lit(0)), "fixed_before": last["fixed"]})
    for s in (0, 1):  # for a split that starts outside, and inside quotes
        rows = rows.withColumn(f"opens{s}", _state(F.col("fixed_before"), F.col("turns_before"), s) == 0)
        rows = rows.withColumn(f"opened{s}", F.sum(F.col(f"opens{s}").cast("long")).over(upto))
    # the split's own window is done once; from here its lines stay where they are
    rows = materialise(rows.drop("effect", "turns_before", "fixed_before"), "csv-lines")
    # one row per split from here
    splits = rows.groupBy("path", "block").agg(
        F.max("turns").alias("turns"),
        F.max_by("fixed", "row").alias("fixed"),
        F.max("opened0").alias("opened0"),
        F.max("opened1").alias("opened1"),
        F.sum("bytes").alias("bytes"),
        F.max("size").alias("size"),
    )
    by_place = Window.partitionBy("path").orderBy("block")
    done = by_place.rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("turns").over(done), F.lit(0))
    # turns of a split are counted from its start, so the fixed one is moved along
    ends = F.when(
        F.col("fixed").isNotNull(),
        F.struct(F.col("fixed.state").alias("state"), (F.col("fixed.turns") + total).alias("turns")),
    )
    splits = splits.withColumns({"total": total, "ends": ends})
    splits = splits.withColumn("start", _state(F.last("ends", ignorenulls=True).over(done), F.col("total")))
    opened = F.when(F.col("start") == 0, F.col("opened0")).otherwise(F.col("opened1"))
    starts = splits.select(
        F.col("path").alias("_path"),
        F.col("block").alias("_block"),
        "start",
        F.coalesce(F.sum(opened).over(done), F.lit(0)).alias("earlier"),
        # values come without line feeds: one byte too many says the last one is missing
        (F.sum("bytes").over(Window.partitionBy("path")) - F.col("size")).isin(0, -BOM_BYTES).alias("ended"),
    )
    placed = rows.join(starts, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    by_start = lambda name: F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    after = _state(F.col("fixed"), F.col("turns"), F.col("start"))
    placed = placed.select(
        "path",
        "row",
        "line",
        (F.col("earlier") + by_start("opened")).alias("record_no"),
        (after == 1).alias("open"),
        (by_start("opens") & (after == 0)).alias("whole"),
        "ended",
    )
    closed = lambda text: F.regexp_replace(text, r"\r\z", "")
    single = placed.where("whole").select("path", "record_no", closed("line").alias("record"))
    several = placed.where("NOT whole").groupBy("path", "record_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("line"),
        F.max_by("open", "row").alias("open"),
        F.first("ended").alias("ended"),
    )
    # a record that is still open at the end of its file has the last line feed too
    rest = F.concat("line", F.when(F.col("ended"), "\n").otherwise(""))
    return single.unionByName(
        several.select("path", "record_no", F.when(F.col("open"), rest).otherwise(closed("line")).alias("record"))
    )


def _header(records: DataFrame) -> list[str]:
    row = records.where("record_no = 1").select(csv_documents.fields(F.col("record")).alias("f")).limit(1).collect()
    return row[0].f if row else []


def infer_types(texts: DataFrame) -> T.StructType:
    """The narrowest type of each text column that all its values fit, in one scan."""
    fits = [
        F.bool_and(F.col(f"`{c}`").try_cast(t).isNotNull() | F.col(f"`{c}`").isNull()).alias(f"{i}:{t}")
        for i, c in enumerate(texts.columns)
        for t in TRIED_TYPES
    ]
    some = [F.count(F.col(f"`{c}`")).alias(f"{i}:n") for i, c in enumerate(texts.columns)]
    row = texts.agg(*fits, *some).first()
    names = []
    for i, column in enumerate(texts.columns):
        good = [t for t in TRIED_TYPES if row[f"{i}:n"] and row[f"{i}:{t}"]]
        names.append(T.StructField(column, T._parse_datatype_string(good[0] if good else "string")))
    return T.StructType(names)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file or folder with a header line in every file, as a table.

    Any file is as many tasks as it has splits, line breaks in quotes or not.
    Empty values are null. Without ``schema`` the types are found in one more pass
    over the values. Rows with too few values have nulls, further values are left out.
    """
    records = materialise(numbered_records(spark, path), "csv-records")
    names = _header(records) if schema is None else schema.fieldNames()
    body = records.where((F.col("record_no") > 1) & (F.col("record") != ""))
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    parsed = lambda kind: body.select(
        F.from_csv("record", kind.toDDL(), options).alias("r")
    ).select("r.*")
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    return parsed(schema or infer_types(parsed(texts)))


def blocks(spark: SparkSession, path: str, paths: DataFrame | None = None) -> DataFrame:
    """The blocks of CSV documents of any size: the header and a block per row,
    as :func:`quillframe.sources.csv_documents.blocks` gives them."""
    records = numbered_records(spark, path, paths).withColumn("fields", csv_documents.fields(F.col("record")))
    index = (F.col("record_no") - 1).cast("int")
    meta = F.when(index == 0, F.create_map(F.lit("columns"), csv_documents._json_list(F.col("fields")))).otherwise(
        F.create_map(F.lit("row_index"), (index - 1).cast("string"))
    )
    return records.select(
        F.sha2("path", 256).alias("document_id"),
        index.alias("block_index"),
        F.when(index == 0, "header").otherwise("row").alias("block_type"),
        F.array_join("fields", ",").alias("content"),
        meta.cast(METADATA).alias("metadata"),
    )

