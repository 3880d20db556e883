"""The dataset catalog: an append-only table of dataset states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.operators.ordered import MAX_GROUP_ROWS, previous_value

# Allowed status changes.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "draft": ("schema_ready", "failed"),
    "schema_ready": ("previewed", "extracted", "failed"),
    "previewed": ("schema_ready", "extracted", "failed"),
    "extracted": ("schema_ready", "failed"),
    "failed": ("draft",),
}

DATASETS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("source_folder", T.StringType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)


def check_transition(current: str, new: str, has_schema: bool = True) -> None:
    allowed = TRANSITIONS.get(current, ())
    if new not in allowed:
        raise ValueError(
            f"a dataset cannot go from '{current}' to '{new}', "
            f"only to: {', '.join(allowed) or 'nothing'}"
        )
    if new == "schema_ready" and not has_schema:
        raise ValueError("'schema_ready' needs a schema")


def current_rows(
    history: DataFrame, key: str = "dataset_id", order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """The last row per dataset.

    ``max_by`` is combined per partition before the shuffle, so a dataset with
    a very long history costs one row per partition.
    """
    row = F.struct(*history.columns)
    latest = history.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return latest.select("_row.*")


def live_rows(
    history: DataFrame,
    tombstones: DataFrame,
    key: str = "dataset_id",
    at: str = "updated_at",
    gone_at: str = "deleted_at",
) -> DataFrame:
    """Rows written after the last tombstone of their dataset, or without one.

    A dataset that is created again after its deletion is therefore there.
    """
    last = tombstones.groupBy(key).agg(F.max(gone_at).alias("_gone_at"))
    return (
        history.join(last, key, "left")
        .filter(F.col("_gone_at").isNull() | (F.col(at) > F.col("_gone_at")))
        .drop("_gone_at")
    )


def summary(current: DataFrame, documents: DataFrame) -> DataFrame:
    """Datasets with their number of documents."""
    counts = documents.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("document_count")
    )
    return current.join(counts, "dataset_id", "left").select(
        "dataset_id",
        "name",
        "status",
        "created_at",
        F.coalesce("document_count", F.lit(0).cast("long")).alias("document_count"),
    )


def status_violations(
    history: DataFrame,
    key: str,
    order: Sequence[str],
    status: str = "status",
    transitions: Mapping[str, Sequence[str]] = TRANSITIONS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows whose status may not follow the one before it."""
    stepped = previous_value(history, [key], order, status, "previous", max_group_rows)
    allowed = [f"{a}>{b}" for a, after in transitions.items() for b in after]
    step = F.concat(F.col("previous"), F.lit(">"), F.col(status))
    return stepped.filter(F.col("previous").isNotNull() & ~step.isin(allowed))


def dataset_state(
    current: DataFrame, documents: DataFrame, fields: DataFrame, records: DataFrame
) -> DataFrame:
    """Documents, schema fields and extraction counts next to each dataset.

    Each child table is reduced to one row per dataset before it is joined.
    """
    docs = documents.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("documents"))
    names = fields.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("fields"))
    results = records.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    counted = ("documents", "fields", "total", "succeeded", "failed")
    zero = F.lit(0).cast("long")
    return (
        current.select("dataset_id", "name", "status")
        .join(docs, "dataset_id", "left")
        .join(names, "dataset_id", "left")
        .join(results, "dataset_id", "left")
        .select(
            "dataset_id",
            "name",
            "status",
            *[F.coalesce(c, zero).alias(c) for c in counted],
        )
    )
