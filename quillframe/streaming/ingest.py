"""Ingest only what is new in a folder, as a file stream.

The stream's checkpoint remembers which files were read, so a run over an
unchanged folder adds nothing and never opens an old file again. Each batch
is its own partition of the output and is replaced as a whole when a batch is
repeated after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from quillframe.model import FILES
from quillframe.operators.ordered import with_ordinals
from quillframe.session import materialise
from quillframe.sources.ingest import (
    default_registry,
    documents_of,
    errors_of,
    fitting,
    parse,
    route,
    too_large,
)
from quillframe.sources.registry import ParserRegistry


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 100_000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def _last_index(spark: SparkSession, target: str, batch_id: int) -> int:
    """Highest document number of the batches before this one."""
    try:
        known = spark.read.parquet(target)
    except AnalysisException:
        return 0  # nothing written yet
    earlier = known.filter(F.col("batch") < batch_id)
    return earlier.agg(F.max("doc_index")).first()[0] or 0


def ingest_stream(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    registry: ParserRegistry | None = None,
    files_per_batch: int = 100_000,
) -> StreamingQuery:
    """Append new documents to ``target/documents`` and errors to
    ``target/errors``, then stop when the folder is read through."""
    chosen = registry or default_registry()
    docs_path, errors_path = f"{target}/documents", f"{target}/errors"

    def write(files: DataFrame, batch_id: int) -> None:
        batch_spark = files.sparkSession
        shift = _last_index(batch_spark, docs_path, batch_id)
        # kept apart by parser, so that each one reads its own files only
        routed = route(fitting(files), chosen)
        supported = F.col("parser").isNotNull()
        raw = materialise(
            routed.withColumn("content", F.when(supported, F.col("content"))),
            "batch",
            partition_by="parser",
        )
        parsed = materialise(
            parse(raw, chosen).unionByName(too_large(files, chosen.extensions())), "parsed"
        )
        numbered = with_ordinals(documents_of(parsed), ["path"])
        numbered.withColumn("doc_index", F.col("doc_index") + F.lit(shift)).write.mode(
            "overwrite"
        ).parquet(f"{docs_path}/batch={batch_id}")
        errors_of(parsed).write.mode("overwrite").parquet(
            f"{errors_path}/batch={batch_id}"
        )

    return (
        file_stream(spark, folder, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
