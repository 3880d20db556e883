"""One structured record per document.

A strategy maps documents to raw field texts; :func:`contracts.conform` then
types and checks them. :class:`RuleStrategy` is made of column expressions.
:class:`FunctionStrategy` runs user code (a model client, for instance) in
Arrow batches and isolates its failures per document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import text as tx
from quillframe.model import FAILED, SUCCESS, ExtractionSummary, FieldDef, RecordSchema
from quillframe.operators.contracts import conform, holds_texts, parse_json_records
from quillframe.session import materialise

# Document types that hold summaries, not single records.
NON_RECORD_TYPES = ("csv", "md", "markdown")
KEYS = ("document_id", "doc_index", "filename")


def record_type(data: T.StructType) -> T.StructType:
    """The columns of a record table whose data has the given type."""
    return T.StructType(
        [
            T.StructField("document_id", T.StringType()),
            T.StructField("doc_index", T.LongType()),
            T.StructField("filename", T.StringType()),
            T.StructField("data", data),
            T.StructField("status", T.StringType()),
            T.StructField("errors", T.ArrayType(T.StringType())),
        ]
    )


class Strategy(Protocol):
    def __call__(self, documents: DataFrame, schema: RecordSchema) -> DataFrame:
        """Documents to (KEYS, raw struct, extract_error)."""


class RuleStrategy:
    """One regular expression per field; its first group is the field's text.

    An array field takes every match instead of the first.
    """

    def __init__(self, patterns: Mapping[str, str]) -> None:
        self.patterns = dict(patterns)

    def _text(self, definition: FieldDef) -> Column:
        pattern = self.patterns.get(definition.name)
        if pattern is None:
            return F.lit(None).cast("string")
        if definition.type == "array":
            found = F.nullif(
                F.regexp_extract_all("content", F.lit(pattern), 1),
                F.array().cast("array<string>"),
            )
            # texts can stay as they are, other items are coerced from JSON
            return found if holds_texts(definition) else F.to_json(found)
        return F.nullif(
            tx.strip(F.regexp_extract("content", pattern, 1)), F.lit("")
        )

    def __call__(self, documents: DataFrame, schema: RecordSchema) -> DataFrame:
        raw = F.struct(*[self._text(f).alias(f.name) for f in schema.fields])
        return documents.select(
            *KEYS, raw.alias("raw"), F.lit(None).cast("string").alias("extract_error")
        )


def labelled(label: str) -> str:
    """Rule for a ``Label: value`` line."""
    return rf"(?m)^{label}:[ \t]*(.*)$"


class FunctionStrategy:
    """``fn(content) -> dict`` per document; an exception fails that document.

    ``partitions`` limits how many calls run at once, for rate-limited
    services. Results are written to the shared folder, so that each document
    is sent to ``fn`` once however often its record is read.
    """

    def __init__(
        self, fn: Callable[[str], Mapping[str, Any]], partitions: int | None = None
    ) -> None:
        self.fn = fn
        self.partitions = partitions

    def __call__(self, documents: DataFrame, schema: RecordSchema) -> DataFrame:
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers, errors = [], []
                for content in batch["content"]:
                    try:
                        answers.append(json.dumps(dict(fn(content))))
                        errors.append(None)
                    except Exception as problem:  # one document's failure
                        answers.append(None)
                        errors.append(str(problem) or type(problem).__name__)
                out = batch[list(KEYS)].copy()
                out["json"], out["extract_error"] = answers, errors
                yield out

        source = documents.select(*KEYS, "content")
        if self.partitions:
            source = source.repartition(self.partitions)
        answered = materialise(
            source.mapInPandas(
                run,
                "document_id string, doc_index long, filename string, "
                "json string, extract_error string",
            ),
            "extracted",
        )
        parsed = parse_json_records(answered, schema)
        return parsed.withColumn(
            "extract_error", F.coalesce("extract_error", "parse_error")
        ).drop("parse_error")


def skip_non_records(
    documents: DataFrame, skip_types: tuple[str, ...] = NON_RECORD_TYPES
) -> DataFrame:
    """Leave out documents that do not hold one record each."""
    return documents.filter(~tx.type_name(F.col("file_type")).isin(list(skip_types)))


def skipped_count(
    documents: DataFrame, skip_types: tuple[str, ...] = NON_RECORD_TYPES
) -> DataFrame:
    skipped = tx.type_name(F.col("file_type")).isin(list(skip_types))
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(skipped).alias("skipped")
    )


def extract_batch(
    documents: DataFrame, schema: RecordSchema, strategy: Strategy, left_out: str | None = None
) -> DataFrame:
    """A record per document: KEYS, data, status, errors, and what the data cannot
    hold if ``left_out`` names a column for it.

    Rows carry ``doc_index``; sort by it where document order matters.
    """
    if not schema.fields:
        raise ValueError("the schema has no fields")
    raw = strategy(documents, schema)
    return conform(raw, schema, error="extract_error", left_out=left_out)


def extract_sample(
    documents: DataFrame, schema: RecordSchema, strategy: Strategy, sample_size: int = 5
) -> DataFrame:
    """Records of the first documents; only those are read and extracted at all.

    Their numbers are found on the numbers alone and become a plain filter, which
    reaches the files.
    """
    first = documents.select("doc_index").orderBy("doc_index").limit(sample_size)
    numbers = [r.doc_index for r in first.collect()]  # sample_size numbers
    return extract_batch(documents.filter(F.col("doc_index").isin(numbers)), schema, strategy)


def summarise(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == SUCCESS).alias("succeeded"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )


def summary(records: DataFrame) -> ExtractionSummary:
    row = summarise(records).first()
    return ExtractionSummary(row.total, row.succeeded, row.failed)


def record_errors(records: DataFrame) -> DataFrame:
    return records.select(
        "document_id", "doc_index", "filename", F.explode("errors").alias("message")
    )


def as_text(value: Column, type_name: str) -> Column:
    """A field value as shown to a reader; nested values as JSON."""
    if type_name.startswith(("array", "struct", "map")):
        return F.to_json(value)
    return value.cast("string")


def preview_fields(records: DataFrame, limit: int = 100) -> DataFrame:
    """One row per shown field: values cut to ``limit``; errors of failed ones."""
    fields = records.schema["data"].dataType.fields
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("field"),
                F.coalesce(
                    tx.shorten(
                        as_text(F.col("data")[f.name], f.dataType.simpleString()), limit
                    ),
                    F.lit("None"),
                ).alias("value"),
            )
            for i, f in enumerate(fields, 1)
        ]
    )
    failures = F.transform(
        "errors",
        lambda e, i: F.struct(
            (i + 1).alias("position"), F.lit("ERROR").alias("field"), e.alias("value")
        ),
    )
    shown = F.when(F.col("status") == SUCCESS, entries).otherwise(failures)
    return records.select(
        "document_id", "doc_index", "filename", "status", F.inline(shown)
    )


class ResumableStrategy:
    """``fn(content) -> dict`` as in :class:`FunctionStrategy`, with answers kept.

    Answers live in a table below ``path``, keyed by a hash of the content and the
    ``version`` of the question (the schema by default). A run first takes what is there;
    only texts without an answer are sent, each distinct text once, in ``batches`` that
    are appended one after the other. A run that is stopped has lost one batch at
    most, and equal documents share an answer. Failures are kept too, unless
    ``retry_failures`` asks them again.

    ``path`` must be shared by driver and executors. One run at a time writes to it.
    """

    _ANSWERS = "key string, version string, json string, extract_error string"

    def __init__(
        self,
        fn: Callable[[str], Mapping[str, Any]],
        path: str,
        batches: int = 10,
        version: str | None = None,
        retry_failures: bool = False,
    ) -> None:
        self.fn, self.path, self.batches = fn, path, batches
        self.version, self.retry_failures = version, retry_failures

    def answers(self, spark: SparkSession) -> DataFrame:
        """The table of answers so far."""
        try:
            return spark.read.schema(self._ANSWERS).parquet(self.path)
        except PySparkException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self._ANSWERS)

    def __call__(self, documents: DataFrame, schema: RecordSchema) -> DataFrame:
        spark, fn = documents.sparkSession, self.fn
        version = self.version or hashlib.sha256(schema.to_json().encode()).hexdigest()
        source = documents.select(*KEYS, "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("key"))

        def usable() -> DataFrame:
            known = self.answers(spark).where(F.col("version") == version)
            return known.where("extract_error IS NULL") if self.retry_failures else known

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers, errors = [], []
                for content in batch["content"]:
                    try:
                        answers.append(json.dumps(dict(fn(content))))
                        errors.append(None)
                    except Exception as problem:  # one text's failure
                        answers.append(None)
                        errors.append(str(problem) or type(problem).__name__)
                yield pd.DataFrame(
                    {"key": batch["key"], "version": version, "json": answers, "extract_error": errors}
                )

        texts = source.join(usable().select("key"), "key", "left_anti").select("key", "content").dropDuplicates(["key"])
        # stored, so that what is missing does not change while batches are added
        missing = materialise(texts, "unanswered")
        part = F.pmod(F.xxhash64("key"), F.lit(self.batches))
        for i in range(self.batches):
            due = missing.where(part == i)
            if not due.isEmpty():
                due.mapInPandas(run, self._ANSWERS).write.mode("append").parquet(self.path)
        # with failures asked again, the answer counts, else the first failure
        kept = self.answers(spark).where(F.col("version") == version).groupBy("key").agg(
            F.max("json").alias("json"), F.min("extract_error").alias("extract_error")
        )
        kept = kept.withColumn("extract_error", F.when(F.col("json").isNull(), F.col("extract_error")))
        parsed = parse_json_records(source.join(kept, "key").select(*KEYS, "json", "extract_error"), schema)
        return parsed.withColumn("extract_error", F.coalesce("extract_error", "parse_error")).drop("parse_error")
