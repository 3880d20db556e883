"""Extraction queries, from documents to records and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.model import FieldDef, RecordSchema
from quillframe.operators import extraction, prompts
from quillframe.operators.sinks import flat_columns, kept_records
from quillframe.plans import render
from quillframe.session import scratch_path
from quillframe.plans.catalogue import query


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_batch(
        render.order_documents(spark, sf_dir), render.ORDER_SCHEMA, render.ORDER_RULES
    )


_FAILED = "(no_total OR bad_total)"


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average_total
FROM truth WHERE NOT {_FAILED}
GROUP BY c_mktsegment
"""
)
def flagship_extract_then_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order texts -> records -> a view -> SQL: average total per segment."""
    rows = flat_columns(kept_records(order_records(spark, sf_dir)), render.ORDER_SCHEMA)
    return spark.sql(
        """
        SELECT segment, count(*) AS orders,
               CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average_total
        FROM {order_record} GROUP BY segment
        """,
        order_record=rows,
    )


_RECORD_COLUMNS = f"""
  CAST(CASE WHEN NOT {_FAILED} THEN o_orderkey END AS DOUBLE) AS order_number,
  CASE WHEN NOT {_FAILED} THEN c_name END AS customer,
  CASE WHEN NOT {_FAILED} THEN c_mktsegment END AS segment,
  CASE WHEN NOT {_FAILED} THEN o_totalprice END AS total,
  CASE WHEN NOT {_FAILED} THEN order_date END AS order_date,
  CASE WHEN NOT {_FAILED} THEN priority END AS priority,
  CASE WHEN NOT {_FAILED} THEN urgent END AS urgent,
  CASE WHEN NOT {_FAILED} THEN o_orderstatus || '|' || o_orderpriority END AS codes
"""


def _record_columns(records: DataFrame, *front: str) -> DataFrame:
    names = [n for n in render.ORDER_SCHEMA.field_names if n != "codes"]
    return records.select(
        *front,
        *[F.col("data")[n].alias(n) for n in names],
        F.array_join("data.codes", "|").alias("codes"),
    )


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT o_orderkey, CASE WHEN {_FAILED} THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN no_total THEN 'total: required field is missing'
            WHEN bad_total THEN 'total: not a valid number: to be agreed'
            ELSE '' END AS error, {_RECORD_COLUMNS}
FROM truth
"""
)
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir).withColumns(
        {
            "o_orderkey": F.col("document_id").cast("long"),
            "error": F.array_join("errors", ""),
        }
    )
    return _record_columns(records, "o_orderkey", "status", "error")


@query(
    r"""
SELECT doc_id, CAST(i AS BIGINT) AS position, found[i] AS email
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+') AS found
      FROM documents), unnest(range(1, len(found) + 1)) AS t(i)
"""
)
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address in every text."""
    schema = RecordSchema(
        "contacts", (FieldDef("emails", "array", items=FieldDef("email", "string")),)
    )
    rules = extraction.RuleStrategy(
        {"emails": r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+)"}
    )
    records = extraction.extract_batch(render.text_documents(spark, sf_dir), schema, rules)
    return records.select(
        F.col("document_id").cast("long").alias("doc_id"),
        F.posexplode("data.emails").alias("_i", "email"),
    ).select("doc_id", (F.col("_i") + 1).cast("long").alias("position"), "email")


_ORDER_REQUEST = """## Record
order_record: One customer order.

## Columns of the answer (path | type | need | meaning)
order_number | number | needed | Number of the order
customer | string | needed | Name of the buyer
segment | string | optional
total | number | needed | Total price in dollars
order_date | date | optional
priority | string | optional
urgent | boolean | optional
codes | array | optional | Codes in brackets
codes.items.code | string | optional

## Values
array: a JSON array
boolean: true or false
date: year, month and day as in 2024-12-31
number: digits without units or grouping
string: text as it stands in the document
An answer without order_number, customer, total is of no use.
An optional value that the text does not give is null.

## Notes
Amounts are in dollars.

## Answer
One JSON object with the keys order_number, customer, segment, total, order_date, priority, urgent, codes."""


@query(
    f"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, '{_ORDER_REQUEST}' AS system,
       md5('## Text' || chr(10) || text) AS user_md5
FROM documents
"""
)
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every request."""
    docs = render.text_documents(spark, sf_dir)
    asked = prompts.render_prompts(docs, render.ORDER_SCHEMA, "Amounts are in dollars.")
    return asked.select("document_id", "system", F.md5("user").alias("user_md5"))


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT doc_index, {_RECORD_COLUMNS} FROM truth ORDER BY doc_index LIMIT 5
"""
)
def extract_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five documents, the feature's own default."""
    records = extraction.extract_sample(
        render.order_documents(spark, sf_dir), render.ORDER_SCHEMA, render.ORDER_RULES
    )
    return _record_columns(records, "doc_index")


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT doc_index, filename, CASE WHEN {_FAILED} THEN 'failed' ELSE 'success' END AS status,
       CAST(CASE WHEN {_FAILED} THEN NULL ELSE o_totalprice END AS DOUBLE) AS total
FROM truth
"""
)
def extract_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document order is carried along; sinks sort by it when they write."""
    return order_records(spark, sf_dir).select(
        "doc_index", "filename", "status", "data.total"
    )


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (NOT {_FAILED}) AS BIGINT) AS succeeded,
       CAST(count(*) FILTER ({_FAILED}) AS BIGINT) AS failed
FROM truth
"""
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.summarise(order_records(spark, sf_dir))


@query(
    """
SELECT CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.CSV' WHEN 'fr' THEN '.md'
                 ELSE 'markdown' END AS file_type,
       CAST(count(*) AS BIGINT) AS documents,
       CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS kept
FROM documents GROUP BY 1
"""
)
def skip_non_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File types by language; only plain texts are left for extraction."""
    kind = (
        F.when(F.col("lang") == "en", ".txt")
        .when(F.col("lang") == "de", ".CSV")
        .when(F.col("lang") == "fr", ".md")
        .otherwise("markdown")
    )
    docs = render.text_documents(spark, sf_dir).withColumn("file_type", kind)
    kept = (
        extraction.skip_non_records(docs)
        .groupBy("file_type")
        .agg(F.count(F.lit(1)).alias("kept"))
    )
    all_docs = docs.groupBy("file_type").agg(F.count(F.lit(1)).alias("documents"))
    return all_docs.join(kept, "file_type", "left").select(
        "file_type", "documents", F.coalesce("kept", F.lit(0).cast("long")).alias("kept")
    )


@query(
    """
WITH cut AS (
  SELECT doc_id, source, lang, text,
         CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown
  FROM documents
)
SELECT doc_id, CAST(1 AS BIGINT) AS position, 'body' AS field, shown AS value FROM cut WHERE lang <> 'es'
UNION ALL
SELECT doc_id, 2, 'origin', source FROM cut WHERE lang <> 'es'
UNION ALL
SELECT doc_id, 3, 'note', 'None' FROM cut WHERE lang <> 'es'
UNION ALL
SELECT doc_id, 1, 'ERROR', 'origin: required field is missing' FROM cut WHERE lang = 'es'
"""
)
def preview_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as field values; Spanish ones lack a required field."""
    schema = RecordSchema(
        "preview",
        (
            FieldDef("body", "string"),
            FieldDef("origin", "string", required=True),
            FieldDef("note", "string"),
        ),
    )

    def strategy(docs: DataFrame, _: RecordSchema) -> DataFrame:
        origin = F.when(F.col("lang") != "es", F.col("source"))
        return docs.select(
            *extraction.KEYS,
            F.struct(F.col("content").alias("body"), origin.alias("origin")).alias("raw"),
            F.lit(None).cast("string").alias("extract_error"),
        )

    records = extraction.extract_batch(render.text_documents(spark, sf_dir), schema, strategy)
    return extraction.preview_fields(records).select(
        F.col("document_id").cast("long").alias("doc_id"),
        F.col("position").cast("long").alias("position"),
        "field",
        "value",
    )


def _read_order(content: str) -> dict:
    """User code of the kind a strategy may run: plain Python on one text."""
    pairs = dict(
        line.split(": ", 1) for line in content.splitlines() if ": " in line
    )
    if "Total" not in pairs:
        raise ValueError("no total in this text")
    return {
        "order_number": int(pairs["Order Number"]),
        "customer": pairs["Customer"],
        "total": pairs["Total"],
    }


@query(
    f"""
WITH {render.ORDER_TRUTH}
SELECT doc_index, CASE WHEN {_FAILED} THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN NOT {_FAILED} THEN o_totalprice END AS total,
       CASE WHEN no_total THEN 'no total in this text'
            WHEN bad_total THEN 'total: not a valid number: to be agreed'
            ELSE '' END AS error
FROM truth
"""
)
def extract_with_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders through a user function in Arrow batches."""
    schema = RecordSchema(
        "order_head",
        tuple(
            f
            for f in render.ORDER_SCHEMA.fields
            if f.name in ("order_number", "customer", "total")
        ),
    )
    records = extraction.extract_batch(
        render.order_documents(spark, sf_dir),
        schema,
        extraction.FunctionStrategy(_read_order),
    )
    return records.select(
        "doc_index", "status", "data.total", F.array_join("errors", "").alias("error")
    )


@query(
    """
SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces, split_part(text, ' ', 1) AS first_piece FROM documents
"""
)
def extract_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts first, as by a run that was stopped; then all, without asking again."""
    schema = RecordSchema("pieces", (FieldDef("pieces", "number", required=True), FieldDef("first_piece", "string")))

    def read(content: str) -> dict:
        parts = content.split(" ")
        return {"pieces": len(parts), "first_piece": parts[0]}

    strategy = extraction.ResumableStrategy(read, scratch_path(spark, "answers"), batches=2)
    docs = render.text_documents(spark, sf_dir)
    extraction.extract_batch(docs.where("lang = 'en'"), schema, strategy)
    records = extraction.extract_batch(docs, schema, strategy)
    return records.select(
        F.col("document_id").cast("long").alias("doc_id"),
        F.col("data.pieces").cast("long").alias("pieces"),
        F.col("data.first_piece").alias("first_piece"),
    )
