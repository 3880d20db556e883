"""Schema and record contract queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.model import FieldDef, RecordSchema, typed_struct
from quillframe.operators import contracts
from quillframe.operators.open_members import with_open_members
from quillframe.plans import render
from quillframe.plans.catalogue import costly, query, table
from quillframe.session import materialise


@query(
    """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_orderkey AS DOUBLE) AS order_key, l_returnflag = 'R' AS returned,
       strftime(l_shipdate, '%Y-%m-%d') AS ship_date, l_quantity AS quantity, l_tax AS tax,
       CAST(4 AS BIGINT) AS n_amounts, CAST(l_partkey AS DOUBLE) AS part,
       CAST(l_suppkey AS DOUBLE) AS supplier
FROM lineitem
"""
)
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read straight into the compiled nested type."""
    shape = typed_struct(render.LINE_SCHEMA)
    lines = render.line_json(spark, sf_dir)
    typed = contracts.compute_once(lines, F.from_json("json", shape).alias("d"))
    return typed.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "d.order_key",
        "d.returned",
        "d.ship_date",
        F.col("d.amounts")[0]["value"].alias("quantity"),
        F.col("d.amounts")[3]["value"].alias("tax"),
        F.size("d.amounts").cast("long").alias("n_amounts"),
        F.col("d.source.part").alias("part"),
        F.col("d.source.supplier").alias("supplier"),
    )


@query(
    f"""
WITH {render.PART_FIELD_TRUTH}, ranked AS (
  SELECT *, 'Field ''' || parent_path || name || ''': ' AS label,
         row_number() OVER (PARTITION BY schema_name, parent_ordinal, parent_path, name ORDER BY ordinal) AS nth
  FROM declared
)
SELECT schema_name, ordinal, label || 'name must be a valid identifier (letters, digits, '
       || 'underscores, not starting with digit)' AS message
FROM ranked WHERE contains(name, ' ')
UNION ALL
SELECT schema_name, ordinal, label || 'duplicate field name' FROM ranked WHERE nth > 1
UNION ALL
SELECT schema_name, ordinal, label || 'invalid type ''decimal''. Must be one of: array, '
       || 'boolean, date, number, object, string'
FROM ranked WHERE kind = 'decimal'
UNION ALL
SELECT schema_name, ordinal, label || 'array type requires ''items'' definition'
FROM ranked WHERE kind = 'array' AND p_size > 25
UNION ALL
SELECT schema_name, ordinal, label || 'object type requires ''properties'' definition'
FROM ranked WHERE kind = 'object' AND p_size <= 25
"""
)
def validate_schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = contracts.field_errors(render.part_fields(spark, sf_dir))
    return errors.select("schema_name", "ordinal", "message")


@query(
    f"""
WITH {render.PART_FIELD_TRUTH}
SELECT schema_name, ordinal,
       CASE WHEN p_size > 40 THEN '  ' ELSE '' END || '- ' || name || ': ' || kind ||
       CASE WHEN required THEN ' (required)' ELSE '' END ||
       CASE WHEN p_size > 10 THEN ' -- size ' || p_size ELSE '' END AS line
FROM declared
"""
)
def describe_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = contracts.describe_schemas(render.part_fields(spark, sf_dir))
    return lines.select("schema_name", "ordinal", "line")


def _order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON: totals as text with a currency sign or in words, missing
    totals, an optional flag in several spellings, and some broken JSON."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    record = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("order_number"),
            F.when(status != "P", F.format_number("o_totalprice", 2)).alias("total"),
            F.when(priority == "1-URGENT", "Yes")
            .when(priority == "2-HIGH", "maybe")
            .when(priority == "3-MEDIUM", "no")
            .alias("urgent"),
            F.array(status, priority).alias("codes"),
        )
    )
    broken = F.when(
        (priority == "5-LOW") & (status == "F"), F.substring(record, 1, 20)
    ).otherwise(record)
    return costly(spark, sf_dir, "orders").select(
        "o_orderkey", broken.alias("json")
    )


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = RecordSchema(
        "order",
        (
            FieldDef("order_number", "number", required=True),
            FieldDef("total", "number", required=True),
            FieldDef("urgent", "boolean"),
            FieldDef("codes", "array", items=FieldDef("code", "string")),
            FieldDef("note", "string"),
        ),
    )
    raw = contracts.parse_json_records(_order_json(spark, sf_dir), schema)
    return contracts.conform(raw, schema, error="parse_error")


_CONFORM_TRUTH = """
problems AS (
  SELECT *, CASE
    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'not a JSON object'
    ELSE concat_ws('; ',
      CASE WHEN o_orderstatus = 'P' THEN 'total: required field is missing' END,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 'urgent: not a valid boolean: maybe' END)
    END AS message
  FROM orders
)
"""


@query(
    f"""
WITH {_CONFORM_TRUTH}
SELECT o_orderkey, CASE WHEN message = '' THEN 'success' ELSE 'failed' END AS status,
       CASE WHEN message = '' THEN o_totalprice END AS total,
       CASE WHEN message = '' AND o_orderpriority = '1-URGENT' THEN true
            WHEN message = '' AND o_orderpriority = '3-MEDIUM' THEN false END AS urgent,
       CASE WHEN message = '' THEN o_orderpriority END AS second_code,
       CAST(NULL AS VARCHAR) AS note
FROM problems
"""
)
def conform_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir).select(
        "o_orderkey",
        "status",
        "data.total",
        "data.urgent",
        F.col("data.codes")[1].alias("second_code"),
        "data.note",
    )


@query(
    f"""
WITH {_CONFORM_TRUTH}
SELECT o_orderkey, message FROM problems WHERE message <> ''
"""
)
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir).select(
        "o_orderkey", F.explode("errors").alias("message")
    )


@query(
    """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN bad_part OR no_supplier OR bad_amount THEN 'failed' ELSE 'success' END AS status,
  concat_ws('; ',
    CASE WHEN bad_amount THEN 'amounts[1].value: not a valid number: much' END,
    CASE WHEN bad_part THEN 'source.part: not a valid number: none' END,
    CASE WHEN no_supplier THEN 'source.supplier: required field is missing' END) AS message,
  CASE WHEN NOT (bad_part OR no_supplier OR bad_amount) THEN CAST(l_suppkey AS DOUBLE) END AS supplier,
  CASE WHEN NOT (bad_part OR no_supplier OR bad_amount) THEN l_extendedprice END AS price,
  CASE WHEN l_linestatus = 'F' THEN 'source.depot=north' ELSE '' END AS left_out
FROM (SELECT *, l_returnflag = 'A' AND l_linenumber = 1 AS bad_part,
             l_returnflag = 'N' AND l_linenumber = 2 AS no_supplier,
             l_tax = 0.05 AS bad_amount FROM lineitem)
"""
)
def conform_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults inside items and properties, texts as numbers, undeclared members."""
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    amounts = F.array(
        F.struct(F.lit("quantity").alias("kind"), F.col("l_quantity").cast("string").alias("value")),
        F.struct(
            F.lit("price").alias("kind"),
            F.when(F.col("l_tax") == 0.05, "much")
            .otherwise(F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
            .alias("value"),
        ),
    )
    part = F.when((flag == "A") & (number == 1), "none").otherwise(F.col("l_partkey").cast("string"))
    source = F.struct(
        part.alias("part"),
        F.when(~((flag == "N") & (number == 2)), F.col("l_suppkey")).alias("supplier"),
        F.when(F.col("l_linestatus") == "F", "north").alias("depot"),
    )
    schema = RecordSchema(
        "line",
        (
            FieldDef(
                "amounts",
                "array",
                items=FieldDef(
                    "amount",
                    "object",
                    properties=(FieldDef("kind", "string"), FieldDef("value", "number", required=True)),
                ),
            ),
            FieldDef(
                "source",
                "object",
                properties=(FieldDef("part", "number"), FieldDef("supplier", "number", required=True)),
            ),
        ),
    )
    json = costly(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        number.cast("long").alias("l_linenumber"),
        F.to_json(F.struct(amounts.alias("amounts"), source.alias("source")), {"ignoreNullFields": "true"}).alias("json"),
    )
    raw = contracts.parse_json_records(json, schema)
    records = contracts.conform(raw, schema, error="parse_error", left_out="left_out")
    return records.select(
        "l_orderkey",
        "l_linenumber",
        "status",
        F.array_join("errors", "; ").alias("message"),
        "data.source.supplier",
        F.col("data.amounts")[1]["value"].alias("price"),
        F.array_join(F.transform("left_out", lambda x: F.concat(x["path"], F.lit("="), x["text"])), ",").alias("left_out"),
    )


@query(
    """
SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS rank, CAST(count(*) AS BIGINT) AS orders,
       CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS cents,
       CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'P' AND o_orderstatus = 'O' THEN 1 ELSE 0 END), 0) AS BIGINT) AS still_open,
       CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 7 END) AS BIGINT) AS weight,
       CAST(0 AS BIGINT) AS misread
FROM orders GROUP BY 1
"""
)
def open_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that the schema does not declare, in objects and array items, stored
    as a VARIANT and read with their types; the JSON of some orders is cut off."""
    status = F.col("o_orderstatus")
    weighed = F.struct(status.alias("code"), (F.col("o_custkey") % 7).alias("weight"))
    record = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("order_number"),
            F.struct(F.col("o_custkey").alias("number"), F.col("o_orderpriority").alias("rank")).alias("buyer"),
            F.col("o_totalprice").alias("price"),
            (status == "O").alias("open"),
            F.array(F.struct(status.alias("code"), F.lit(None).cast("long").alias("weight")), weighed).alias("marks"),
        ),
        {"ignoreNullFields": "true"},
    )
    schema = RecordSchema(
        "order",
        (
            FieldDef("order_number", "number"),
            FieldDef("buyer", "object", properties=(FieldDef("number", "number"),)),
            FieldDef("marks", "array", items=FieldDef("mark", "object", properties=(FieldDef("code", "string"),))),
        ),
    )
    json = costly(spark, sf_dir, "orders").select(F.when(status == "P", F.left(record, F.lit(30))).otherwise(record).alias("json"))
    stored = materialise(with_open_members(json, schema).drop("json"), "open-members")

    def member(path: str, kind: str) -> Column:
        return F.try_variant_get("open_members", f"$.{path}", kind)

    return stored.groupBy(member("buyer.rank", "string").alias("rank")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.round(member("price", "double") * 100).cast("long")).alias("cents"),
        F.count_if(member("open", "boolean")).alias("still_open"),
        F.sum(member("marks[1].weight", "long")).alias("weight"),
        F.count(F.coalesce(member("order_number", "long"), member("buyer.rank", "double"))).alias("misread"),
    )


@query(
    """
SELECT schema_name, CAST(max(n) AS BIGINT) AS version,
       arg_max(label, n) AS description
FROM (SELECT p_type AS schema_name, p_size AS n, p_type || ' size ' || p_size AS label FROM part
      UNION ALL
      SELECT p_type, max(p_size) + 1, 'newly set' FROM part GROUP BY p_type
      UNION ALL SELECT DISTINCT n_name, 1, 'newly set' FROM nation)
GROUP BY schema_name
"""
)
def schema_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as stored versions; then every type and nation is set once more."""
    stored = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("schema_name"),
        F.col("p_size").alias("version"),
        F.concat("p_type", F.lit(" size "), F.col("p_size").cast("string")).alias(
            "description"
        ),
    )
    incoming = (
        stored.select("schema_name")
        .unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("schema_name")))
        .distinct()
        .withColumn("description", F.lit("newly set"))
    )
    heads = stored.unionByName(contracts.next_versions(stored, incoming))
    return contracts.latest_versions(heads).select(
        "schema_name", F.col("version").cast("long").alias("version"), "description"
    )
