"""Writing records: CSV, Parquet, a text dump for search, and snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quillframe.model import FAILED, SUCCESS, RecordSchema
from quillframe.operators.ordered import with_ordinals
from quillframe.session import materialise

#: Records from which on a Parquet copy is advised, see storage_plan.
PARQUET_ADVISED = 500
FORMATS = ("csv", "parquet")


def kept_records(records: DataFrame) -> DataFrame:
    """Everything that did not fail; partial records are kept."""
    return records.filter(F.col("status") != FAILED)


def flat_columns(records: DataFrame, schema: RecordSchema, json_text: bool = True) -> DataFrame:
    """Record data as columns in schema order; nested values as JSON text."""
    held = {f.name: f.dataType for f in records.schema["data"].dataType.fields}

    def column(name: str) -> Column:
        if name not in held:
            return F.lit(None).cast("string")
        value = F.col("data")[name]
        nested = isinstance(held[name], (T.ArrayType, T.StructType, T.MapType))
        return F.to_json(value, {"ignoreNullFields": "false"}) if nested and json_text else value

    return records.select(*[column(f.name).alias(f.name) for f in schema.fields])


def _in_document_order(records: DataFrame) -> DataFrame:
    """Sorted part files; the sort is distributed over ranges of doc_index."""
    if "doc_index" not in records.columns:
        return records
    return records.repartitionByRange("doc_index").sortWithinPartitions("doc_index")


def _with_suffix(path: str, suffix: str) -> str:
    return path if "." in path.rsplit("/", 1)[-1] else f"{path}.{suffix}"


def write_csv(records: DataFrame, schema: RecordSchema, path: str) -> str:
    target = _with_suffix(path, "csv")
    rows = flat_columns(_in_document_order(kept_records(records)), schema)
    (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(target)
    )
    return target


def write_parquet(
    records: DataFrame, schema: RecordSchema, path: str, json_text: bool = True
) -> str:
    """``json_text=False`` keeps arrays and objects as nested columns."""
    target = _with_suffix(path, "parquet")
    flat_columns(
        _in_document_order(kept_records(records)), schema, json_text
    ).write.mode("overwrite").parquet(target)
    return target


def write_records(
    records: DataFrame, schema: RecordSchema, format_name: str, path: str
) -> str:
    writers = {"csv": write_csv, "parquet": write_parquet}
    if format_name not in writers:
        raise ValueError(
            f"Unknown format '{format_name}'. Known formats: {', '.join(FORMATS)}"
        )
    return writers[format_name](records, schema, path)


# -- text dump ----------------------------------------------------------------


# How the dump writes a heading, a missing value and truth values.
HEADING = ("=== Record ", ": ", " ===")
NO_VALUE = "None"


def _plain_number(value: Column) -> Column:
    """A double with a decimal point and no exponent for everyday sizes."""
    digits = F.regexp_replace(
        value.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1"
    )
    size = F.abs(value)
    return F.when((size >= 1e7) & (size < 1e16), digits).otherwise(value.cast("string"))


def _dump_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(kind, T.DoubleType):
        text = _plain_number(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NO_VALUE))


def dump_lines(records: DataFrame, schema: RecordSchema) -> DataFrame:
    """(record_no, field_no, line_no, line): a heading, a line per field, a blank.

    ``record_no`` counts all records in document order, so failed ones, which
    are not written, leave gaps. ``line_no`` counts the lines of the whole
    dump; a line break inside a value starts a new line there. ``records``
    should be stored already, as all sinks read them.
    """
    held = {f.name: f.dataType for f in records.schema["data"].dataType.fields}
    body = [
        F.concat(
            F.lit(f"{f.name}: "),
            _dump_text(F.col("data")[f.name], held[f.name])
            if f.name in held
            else F.lit(""),
        )
        for f in schema.fields
    ]
    texts = F.flatten(F.transform(F.array(*body, F.lit("")), lambda t: F.split(t, "\n")))
    # texts are made once; numbers come from their counts, and texts move once to meet them
    made = materialise(
        records.select("doc_index", "filename", F.when(F.col("status") != FAILED, texts).alias("texts")).withColumn(
            "_size", F.coalesce(F.size("texts") + 1, F.lit(0)).cast("long")
        ),
        "dump-texts",
    )
    counted = made.select(F.col("doc_index").alias("_index"), F.greatest("_size", F.lit(0)).alias("_size"))
    numbers = with_ordinals(counted, ["_index"], "record_no", F.col("_size"), "_before")
    numbered = made.where(F.col("texts").isNotNull()).drop("_size").join(
        numbers.filter("_size > 0").select("_index", "record_no", "_before"),
        F.col("doc_index") == F.col("_index"),
    )
    heading = F.concat(
        F.lit(HEADING[0]),
        F.col("record_no").cast("string"),
        F.lit(HEADING[1]),
        F.col("filename"),
        F.lit(HEADING[2]),
    )
    return (
        numbered.select(
            "record_no",
            "_before",
            F.posexplode(F.concat(F.array(heading), "texts")).alias("_pos", "line"),
        )
        .select(
            "record_no",
            (F.col("_pos") + 1).alias("field_no"),
            (F.col("_before") + F.col("_pos") + 1).alias("line_no"),
            "line",
        )
    )


def write_dump(lines: DataFrame, path: str) -> str:
    """The dump as text files; part files in name order make up the whole."""
    (
        lines.repartitionByRange("line_no")
        .sortWithinPartitions("line_no")
        .select("line")
        .write.mode("overwrite")
        .text(path)
    )
    return path


def storage_plan(records: DataFrame, threshold: int = PARQUET_ADVISED) -> DataFrame:
    """How many records there are and whether a Parquet copy is advised.

    This is a value for the caller; the writers here always write all files.
    """
    succeeded = F.count_if(F.col("status") == SUCCESS)
    return records.agg(
        succeeded.alias("record_count"),
        F.lit(True).alias("write_csv"),
        (succeeded >= threshold).alias("write_parquet"),
        F.lit(True).alias("write_text"),
    )


# -- snapshots ----------------------------------------------------------------


def export_all(tables: Mapping[str, DataFrame], path: str) -> str:
    """Every dataset at once: one folder for each dataset below each table."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("dataset_id").parquet(f"{path}/{name}")
    return path


def import_all(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables that :func:`export_all` wrote; ids stay texts."""
    found = {}
    for name in names:
        table = spark.read.parquet(f"{path}/{name}")
        found[name] = table.withColumn("dataset_id", F.col("dataset_id").cast("string"))
    return found


def export_snapshot(tables: Mapping[str, DataFrame], dataset_id: str, path: str) -> str:
    """One dataset's rows of each table, as a folder of Parquet tables."""
    for name, table in tables.items():
        table.filter(F.col("dataset_id") == dataset_id).write.mode("overwrite").parquet(
            f"{path}/{name}"
        )
    return path


def import_snapshot(
    spark: SparkSession, path: str, names: tuple[str, ...]
) -> tuple[str, dict[str, DataFrame]]:
    """(dataset id, tables) of a snapshot; it must hold exactly one dataset."""
    try:
        heads = spark.read.parquet(f"{path}/datasets")
    except AnalysisException as problem:
        raise ValueError("Invalid snapshot: missing datasets table") from problem
    ids = [r.dataset_id for r in heads.select("dataset_id").distinct().limit(2).collect()]
    if len(ids) != 1 or not ids[0]:
        raise ValueError("Invalid snapshot: needs exactly one dataset id")
    return ids[0], {name: spark.read.parquet(f"{path}/{name}") for name in names}


def union_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
