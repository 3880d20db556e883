"""Document collections rendered from the given tables.

Each document is written from the columns of one row (after joins to its
dimension tables), so rendering needs no grouping and grows with the tables.
The queries parse these texts back; their oracles read the tables directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.model import FieldDef, RecordSchema
from quillframe.operators.extraction import RuleStrategy, labelled
from quillframe.plans.catalogue import costly, dealt, table

# -- the documents table as files -----------------------------------------------

#: Extension by language, so that all routes are taken.
EXTENSION_BY_LANG = {"en": ".txt", "fr": ".md", "de": ".TXT", "es": ".log"}


def _extension() -> Column:
    choice = F.lit(".txt")
    for lang, ext in EXTENSION_BY_LANG.items():
        choice = F.when(F.col("lang") == lang, ext).otherwise(choice)
    return choice


def _number_name(prefix: str, key: Column, suffix: Column | str) -> Column:
    end = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 12, "0"), end)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (path, length, content bytes), extension by language."""
    content = F.encode("text", "utf-8")
    return costly(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("corpus/"),
            F.col("source"),
            F.lit("/"),
            _number_name("doc_", F.col("doc_id"), _extension()),
        ).alias("path"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
    )


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as parsed documents; ``doc_id`` is their dense position."""
    name = _number_name("doc_", F.col("doc_id"), ".txt")
    return costly(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        (F.col("doc_id") + 1).alias("doc_index"),
        F.concat(F.lit("corpus/"), name).alias("path"),
        name.alias("filename"),
        F.lit(".txt").alias("file_type"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


# -- orders as label: value records -----------------------------------------------

ORDER_SCHEMA = RecordSchema(
    name="order_record",
    description="One customer order.",
    fields=(
        FieldDef("order_number", "number", "Number of the order", True),
        FieldDef("customer", "string", "Name of the buyer", True),
        FieldDef("segment", "string"),
        FieldDef("total", "number", "Total price in dollars", True),
        FieldDef("order_date", "date"),
        FieldDef("priority", "string"),
        FieldDef("urgent", "boolean"),
        FieldDef("codes", "array", "Codes in brackets", items=FieldDef("code", "string")),
    ),
)

ORDER_RULES = RuleStrategy(
    {
        "order_number": labelled("Order Number"),
        "customer": labelled("Customer"),
        "segment": labelled("Segment"),
        "total": labelled("Total"),
        "order_date": labelled("Date"),
        "priority": labelled("Priority"),
        "urgent": labelled("Urgent"),
        "codes": r"\[([^\]]*)\]",
    }
)


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per order. Low-priority pending orders have no total, urgent
    finished ones have one in words, and unspecified priorities are left out.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment"
    )
    joined = dealt(
        orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_name", "c_mktsegment"
        ),
        orders,
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    amount = F.concat(F.lit("Total: $"), F.format_number("o_totalprice", 2))
    total = (
        F.when((status == "P") & (priority == "5-LOW"), F.lit(None))
        .when((status == "F") & (priority == "1-URGENT"), F.lit("Total: to be agreed"))
        .otherwise(amount)
    )
    text = F.concat_ws(
        "\n",
        F.lit("ORDER RECORD\n"),
        F.concat(F.lit("Order Number: "), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("Customer: "), F.col("c_name")),
        F.concat(F.lit("Segment: "), F.col("c_mktsegment")),
        total,
        F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(
            priority != "4-NOT SPECIFIED", F.concat(F.lit("Priority: "), priority)
        ),
        F.concat(
            F.lit("Urgent: "),
            F.when(priority == "1-URGENT", "yes").otherwise("no"),
        ),
        F.concat(F.lit("\nCodes: ["), status, F.lit("] ["), priority, F.lit("]\n")),
    )
    name = _number_name("order_", F.col("o_orderkey"), ".txt")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        (F.col("o_orderkey") + 1).alias("doc_index"),
        F.concat(F.lit("orders/"), name).alias("path"),
        name.alias("filename"),
        F.lit(".txt").alias("file_type"),
        text.alias("content"),
    )


#: What the order texts must give back, written over the tables only.
ORDER_TRUTH = """
truth AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, c_name, c_mktsegment,
         o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
         o_orderkey + 1 AS doc_index,
         'order_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.txt' AS filename,
         o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS no_total,
         o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS bad_total,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS priority,
         o_orderpriority = '1-URGENT' AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""


# -- customers as Markdown ----------------------------------------------------------


def customer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown page per customer: headers, paragraphs and a code block."""
    joined = (
        costly(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    language = F.when(F.col("c_mktsegment") == "MACHINERY", "sql").otherwise("")
    # unlike the others, building customers leave their fence open
    closing = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(
        "\n```\nend of page"
    )
    text = F.concat(
        F.lit("# "),
        F.col("r_name"),
        F.lit("\n\n##  "),
        F.col("n_name"),
        F.lit("\n"),
        F.col("c_name"),
        F.lit("\n#segment "),
        F.col("c_mktsegment"),
        F.lit("\n   \n```"),
        language,
        F.lit("\n# balance\n\n"),
        F.col("c_acctbal").cast("string"),
        closing,
    )
    return joined.select(
        F.col("c_custkey").cast("string").alias("document_id"),
        (F.col("c_custkey") + 1).alias("doc_index"),
        F.lit(".md").alias("file_type"),
        text.alias("content"),
    )


# -- parts as CSV ------------------------------------------------------------------


def part_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV text per part with one line per unit of its size.

    Names hold a quoted comma and quote, brands a quoted line break.
    """
    line = F.concat(
        F.lit(',"'),
        F.regexp_replace("p_name", " ", ', ""'),
        F.lit('""",'),
        F.concat(F.lit('"'), F.regexp_replace("p_brand", "#", "\n"), F.lit('"')),
    )
    rows = F.transform(
        F.sequence(F.lit(1), F.col("p_size")),
        lambda i: F.concat(i.cast("string"), line, F.lit("\n")),
    )
    return costly(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("document_id"),
        (F.col("p_partkey") + 1).alias("doc_index"),
        F.lit(".csv").alias("file_type"),
        F.concat(F.lit("unit,name,brand\n"), F.array_join(rows, "")).alias("content"),
    )


# -- line items as JSON ---------------------------------------------------------------

LINE_SCHEMA = RecordSchema(
    name="line_item",
    fields=(
        FieldDef("order_key", "number", required=True),
        FieldDef("returned", "boolean"),
        FieldDef("ship_date", "date"),
        FieldDef(
            "amounts",
            "array",
            items=FieldDef(
                "amount",
                "object",
                properties=(FieldDef("kind", "string"), FieldDef("value", "number")),
            ),
        ),
        FieldDef(
            "source",
            "object",
            properties=(FieldDef("part", "number"), FieldDef("supplier", "number")),
        ),
    ),
)


def line_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON record per line item with nested amounts."""

    def amount(kind: str, column: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))

    record = F.struct(
        F.col("l_orderkey").alias("order_key"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"),
        F.array(
            amount("quantity", "l_quantity"),
            amount("price", "l_extendedprice"),
            amount("discount", "l_discount"),
            amount("tax", "l_tax"),
        ).alias("amounts"),
        F.struct(
            F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")
        ).alias("source"),
    )
    return costly(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_json(record).alias("json")
    )


# -- parts as schema declarations -------------------------------------------------------

_TYPE_BY_KIND = {
    "ECONOMY": "string",
    "STANDARD": "number",
    "SMALL": "array",
    "MEDIUM": "object",
    "LARGE": "date",
    "PROMO": "decimal",
}


def part_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand as a schema, each of its parts as a field of it."""
    kind = F.lit("boolean")
    for p_type, name in _TYPE_BY_KIND.items():
        kind = F.when(F.col("p_type") == p_type, name).otherwise(kind)
    small = F.col("p_size") <= 25
    name = F.when(small, F.regexp_replace("p_name", " ", "_")).otherwise(F.col("p_name"))
    parent = F.when(F.col("p_size") > 45, F.lit("extra.items.")).otherwise(
        F.when(F.col("p_size") > 40, F.lit("extra.")).otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("schema_name"),
        F.lit(1).alias("version"),
        # the same path below two parents, and below an array's items
        F.when(F.col("p_size") > 40, 1 + F.col("p_size") % 3).otherwise(0).alias("parent_ordinal"),
        parent.alias("parent_path"),
        F.concat(parent, name).alias("path"),
        F.when(F.col("p_size") > 40, 1).otherwise(0).alias("depth"),
        F.col("p_partkey").alias("ordinal"),
        name.alias("name"),
        kind.alias("type"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("size "), F.col("p_size").cast("string")))
        .otherwise(F.lit(""))
        .alias("description"),
        (F.col("p_retailprice") > 950).alias("required"),
        small.alias("has_items"),
        F.when(small, 0).otherwise(2).alias("n_properties"),
    )


PART_FIELD_TRUTH = """
declared AS (
  SELECT p_brand AS schema_name, p_partkey AS ordinal, p_size,
         CASE WHEN p_size <= 25 THEN replace(p_name, ' ', '_') ELSE p_name END AS name,
         CASE WHEN p_size > 45 THEN 'extra.items.' WHEN p_size > 40 THEN 'extra.' ELSE '' END AS parent_path,
         CASE WHEN p_size > 40 THEN 1 + p_size % 3 ELSE 0 END AS parent_ordinal,
         CASE p_type WHEN 'ECONOMY' THEN 'string' WHEN 'STANDARD' THEN 'number'
                     WHEN 'SMALL' THEN 'array' WHEN 'MEDIUM' THEN 'object'
                     WHEN 'LARGE' THEN 'date' WHEN 'PROMO' THEN 'decimal'
                     ELSE 'boolean' END AS kind,
         p_retailprice > 950 AS required
  FROM part
)
"""


# -- conversations as paged documents ------------------------------------------------------


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a document, each turn a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        (F.col("turn") + 1).alias("page_no"),
        "text",
    )


# -- events as catalog history ---------------------------------------------------------------

STATUS_BY_EVENT = {
    "view": "draft",
    "click": "schema_ready",
    "signup": "previewed",
    "purchase": "extracted",
    "error": "failed",
}


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a dataset, each event as a change of its status."""
    status = F.lit(None).cast("string")
    for event, name in STATUS_BY_EVENT.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("dataset_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        status.alias("status"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )


STATUS_TRUTH = """
history AS (
  SELECT CAST(user_id AS VARCHAR) AS dataset_id, event_id, ts,
         CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'schema_ready'
              WHEN 'signup' THEN 'previewed' WHEN 'purchase' THEN 'extracted'
              WHEN 'error' THEN 'failed' END AS status
  FROM events
)
"""
