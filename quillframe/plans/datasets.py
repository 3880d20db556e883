"""Catalog queries over the history of dataset states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import catalog
from quillframe.plans import render
from quillframe.plans.catalogue import query, table

_LATEST = f"""
{render.STATUS_TRUTH}, latest AS (
  SELECT dataset_id, arg_max(status, ts) AS status, arg_max(event_id, ts) AS event_id,
         min(ts) AS created_at, max(ts) AS updated_at
  FROM history GROUP BY dataset_id
)
"""
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(
    f"""
WITH {_LATEST}
SELECT dataset_id, 'user ' || dataset_id AS name, status, event_id,
       strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM latest
"""
)
def catalog_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = catalog.current_rows(
        render.status_history(spark, sf_dir), order=("updated_at", "event_id")
    )
    return current.withColumn("updated_at", F.date_format("updated_at", _TIME))


def _customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, each customer's in the dataset of that number."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset_id"),
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "P", "partial")
        .otherwise("failed")
        .alias("status"),
    )


@query(
    f"""
WITH {_LATEST}
SELECT dataset_id, 'user ' || dataset_id AS name, status,
       strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
       CAST((SELECT count(*) FROM orders WHERE CAST(o_custkey AS VARCHAR) = dataset_id) AS BIGINT)
         AS document_count
FROM latest
"""
)
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = render.status_history(spark, sf_dir)
    created = history.groupBy("dataset_id").agg(F.min("updated_at").alias("created_at"))
    current = catalog.current_rows(history, order=("updated_at", "event_id"))
    found = catalog.summary(
        current.join(created, "dataset_id"), _customer_documents(spark, sf_dir)
    )
    return found.withColumn("created_at", F.date_format("created_at", _TIME))


@query(
    f"""
WITH {_LATEST}
SELECT status, CAST(count(*) AS BIGINT) AS datasets FROM latest
LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS dataset_id,
                  TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * c_nationkey AS gone_at
           FROM customer WHERE c_acctbal < 0) gone USING (dataset_id)
WHERE gone_at IS NULL OR updated_at > gone_at
GROUP BY status
"""
)
def catalog_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of overdrawn customers were deleted, some before their last row."""
    current = catalog.current_rows(
        render.status_history(spark, sf_dir), order=("updated_at", "event_id")
    )
    tombstones = (
        table(spark, sf_dir, "customer")
        .filter("c_acctbal < 0")
        .select(
            F.col("c_custkey").cast("string").alias("dataset_id"),
            F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(c_nationkey)").alias("deleted_at"),
        )
    )
    return (
        catalog.live_rows(current, tombstones)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("datasets"))
    )


@query(
    f"""
WITH {render.STATUS_TRUTH}, stepped AS (
  SELECT *, lag(status) OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS previous
  FROM history
), allowed(a, b) AS (VALUES
  ('draft', 'schema_ready'), ('draft', 'failed'),
  ('schema_ready', 'previewed'), ('schema_ready', 'extracted'), ('schema_ready', 'failed'),
  ('previewed', 'schema_ready'), ('previewed', 'extracted'), ('previewed', 'failed'),
  ('extracted', 'schema_ready'), ('extracted', 'failed'), ('failed', 'draft'))
SELECT dataset_id, event_id, previous, status FROM stepped
WHERE previous IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = previous AND b = status)
"""
)
def status_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.status_violations(
        render.status_history(spark, sf_dir), "dataset_id", ["updated_at", "event_id"]
    )
    return found.select("dataset_id", "event_id", "previous", "status")


@query(
    f"""
WITH {_LATEST}, docs AS (
  SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, count(*) AS documents,
         count(*) FILTER (o_orderstatus = 'F') AS succeeded,
         count(*) FILTER (o_orderstatus = 'O') AS failed
  FROM orders GROUP BY o_custkey
), fields AS (
  SELECT CAST(p_size AS VARCHAR) AS dataset_id, count(*) AS fields FROM part GROUP BY p_size
)
SELECT dataset_id, 'user ' || dataset_id AS name, status,
       CAST(coalesce(documents, 0) AS BIGINT) AS documents,
       CAST(coalesce(fields, 0) AS BIGINT) AS fields,
       CAST(coalesce(documents, 0) AS BIGINT) AS total,
       CAST(coalesce(succeeded, 0) AS BIGINT) AS succeeded,
       CAST(coalesce(failed, 0) AS BIGINT) AS failed
FROM latest LEFT JOIN docs USING (dataset_id) LEFT JOIN fields USING (dataset_id)
"""
)
def dataset_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customer_documents(spark, sf_dir)
    fields = table(spark, sf_dir, "part").select(
        F.col("p_size").cast("string").alias("dataset_id")
    )
    current = catalog.current_rows(
        render.status_history(spark, sf_dir), order=("updated_at", "event_id")
    )
    return catalog.dataset_state(current, docs, fields, docs)
