"""Sink queries: each writes whole results and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.model import FieldDef, RecordSchema
from quillframe.operators import sinks
from quillframe.plans import render
from quillframe.plans.catalogue import query, table
from quillframe.plans.extraction import order_records
from quillframe.session import materialise, scratch_path
from quillframe.sources.tables import read_csv_table

_KEPT = "NOT (no_total OR bad_total)"

PART_SCHEMA = RecordSchema(
    "part",
    (
        FieldDef("name", "string", required=True),
        FieldDef("price", "number", required=True),
        FieldDef("large", "boolean"),
        FieldDef("comment", "string"),
        FieldDef("tags", "array", items=FieldDef("tag", "string")),
        FieldDef(
            "about",
            "object",
            properties=(FieldDef("brand", "string"), FieldDef("size", "number")),
        ),
        FieldDef("missing", "string"),
    ),
)


def _part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with nulls, quotes, commas, line breaks and blanks at
    the ends; promotional ones failed, economy ones are partial."""
    comment = F.when(
        F.col("p_type") != "SMALL",
        F.concat(F.lit(' "'), F.col("p_brand"), F.lit('", \\ a\nb ')),
    )
    status = (
        F.when(F.col("p_type") == "PROMO", "failed")
        .when(F.col("p_type") == "ECONOMY", "partial")
        .otherwise("success")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("document_id"),
        (F.col("p_partkey") + 1).alias("doc_index"),
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias(
            "filename"
        ),
        F.struct(
            F.concat_ws("#", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"),
            (F.col("p_retailprice") * 20000).alias("price"),
            F.when(F.col("p_size") > 10, F.col("p_size") > 25).alias("large"),
            comment.alias("comment"),
            F.split("p_name", " ").alias("tags"),
            F.struct(
                F.col("p_brand").alias("brand"),
                F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("size"),
            ).alias("about"),
        ).alias("data"),
        status.alias("status"),
        F.array().cast("array<string>").alias("errors"),
    )


_PART_TRUTH = """
SELECT p_name || '#' || p_partkey AS name, p_retailprice * 20000 AS price,
       CASE WHEN p_size > 10 THEN p_size > 25 END AS large,
       CASE WHEN p_type <> 'SMALL' THEN ' "' || p_brand || '", \\ a' || chr(10) || 'b ' END AS comment,
       string_split(p_name, ' ')[1] AS first_tag, p_brand AS brand,
       CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) END AS size,
       CAST(NULL AS VARCHAR) AS missing
FROM part WHERE p_type <> 'PROMO'
"""


def _opened(rows: DataFrame) -> DataFrame:
    """JSON text columns parsed again, so that values and not bytes compare."""
    return rows.select(
        "name",
        "price",
        "large",
        "comment",
        F.from_json("tags", "array<string>")[0].alias("first_tag"),
        F.from_json("about", "brand string, size double")["brand"].alias("brand"),
        F.from_json("about", "brand string, size double")["size"].alias("size"),
        F.col("missing").cast("string").alias("missing"),
    )


@query(_PART_TRUTH)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_csv(
        _part_records(spark, sf_dir), PART_SCHEMA, scratch_path(spark, "parts")
    )
    return _opened(read_csv_table(spark, path))  # comments have line breaks


@query(_PART_TRUTH)
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_parquet(
        _part_records(spark, sf_dir), PART_SCHEMA, scratch_path(spark, "parts")
    )
    return _opened(spark.read.parquet(path))


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT f AS format, CAST(count(*) AS BIGINT) AS written,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(count(priority) AS BIGINT) AS with_priority,
       CAST(count(*) FILTER (urgent) AS BIGINT) AS urgent
FROM truth, (VALUES ('csv'), ('parquet')) AS formats(f) WHERE {_KEPT} GROUP BY f
"""
)
def write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results in both formats, read back."""
    records = materialise(order_records(spark, sf_dir), "records")
    found = []
    for name in sinks.FORMATS:
        path = sinks.write_records(
            records, render.ORDER_SCHEMA, name, scratch_path(spark, "orders")
        )
        rows = read_csv_table(spark, path) if name == "csv" else spark.read.parquet(path)
        found.append(
            rows.agg(
                F.lit(name).alias("format"),
                F.count(F.lit(1)).alias("written"),
                F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("total"),
                F.count("priority").alias("with_priority"),
                F.count_if("urgent").alias("urgent"),
            )
        )
    return sinks.union_tables(found)


@query(
    f"""
WITH {render.ORDER_TRUTH}, numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY doc_index) AS BIGINT) AS record_no FROM truth
), kept AS (
  SELECT *, (row_number() OVER (ORDER BY record_no) - 1) * 10 AS before_it
  FROM numbered WHERE {_KEPT}
), dump AS (
  SELECT *, 1 AS field_no, '=== Record ' || record_no || ': ' || filename || ' ===' AS line FROM kept
  UNION ALL SELECT *, 2, 'order_number: ' || CAST(CAST(o_orderkey AS DOUBLE) AS VARCHAR) FROM kept
  UNION ALL SELECT *, 3, 'customer: ' || c_name FROM kept
  UNION ALL SELECT *, 4, 'segment: ' || c_mktsegment FROM kept
  UNION ALL SELECT *, 5, 'total: ' || CAST(o_totalprice AS VARCHAR) FROM kept
  UNION ALL SELECT *, 6, 'order_date: ' || order_date FROM kept
  UNION ALL SELECT *, 7, 'priority: ' || coalesce(priority, 'None') FROM kept
  UNION ALL SELECT *, 8, 'urgent: ' || CASE WHEN urgent THEN 'True' ELSE 'False' END FROM kept
  UNION ALL SELECT *, 9, 'codes: ["' || o_orderstatus || '","' || o_orderpriority || '"]' FROM kept
  UNION ALL SELECT *, 10, '' FROM kept
)
SELECT record_no, CAST(field_no AS BIGINT) AS field_no,
       CAST(before_it + field_no AS BIGINT) AS line_no, line
FROM dump
"""
)
def text_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialise(order_records(spark, sf_dir), "records")
    lines = sinks.dump_lines(records, render.ORDER_SCHEMA)
    return lines.select(
        F.col("record_no").cast("long").alias("record_no"),
        F.col("field_no").cast("long").alias("field_no"),
        F.col("line_no").cast("long").alias("line_no"),
        "line",
    )


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT CAST(count(*) FILTER ({_KEPT}) AS BIGINT) AS record_count, true AS write_csv,
       count(*) FILTER ({_KEPT}) >= 500 AS write_parquet, true AS write_text
FROM truth
"""
)
def storage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.storage_plan(order_records(spark, sf_dir))


@query(
    """
SELECT source AS dataset_id, CAST(count(*) AS BIGINT) AS documents,
       CAST(sum(n_chars) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS missing,
       CAST(0 AS BIGINT) AS added
FROM documents GROUP BY source
"""
)
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as a dataset, all exported at once and imported again."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "dataset_id")
    path = sinks.export_all({"documents": docs}, scratch_path(spark, "snapshot"))
    back = sinks.import_all(spark, path, ("documents",))["documents"]

    def marked(rows: DataFrame, before: int, after: int) -> DataFrame:
        """Rows by a digest of all that is in them."""
        return rows.select(
            "dataset_id",
            "doc_id",
            "n_chars",
            F.sha2(F.to_json(F.struct("doc_id", "text", "lang", "n_chars")), 256).alias("digest"),
            F.lit(before).alias("before"),
            F.lit(after).alias("after"),
        )

    # both directions in one grouping: how often each row is there, and there
    copies = (
        marked(docs, 1, 0)
        .unionByName(marked(back, 0, 1))
        .groupBy("dataset_id", "doc_id", "n_chars", "digest")
        .agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    )
    return copies.groupBy("dataset_id").agg(
        F.sum("after").alias("documents"),
        F.sum(F.col("after") * F.col("n_chars")).alias("chars"),
        F.count_if(F.col("after") < F.col("before")).alias("missing"),
        F.count_if(F.col("after") > F.col("before")).alias("added"),
    )
