"""Record schemas as tables: validate, describe, version; conform records.

Validation runs over a table of flattened fields (``SCHEMA_FIELDS``), so any
number of schemas is checked in one job and all problems are reported at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import text as tx
from quillframe.model import (
    FAILED,
    FIELD_TYPES,
    KNOWN_TYPES,
    SCHEMA_FIELDS,
    SUCCESS,
    FieldDef,
    RecordSchema,
    field_rows,
    spark_type,
    typed_struct,
)
from quillframe.operators.ordered import MAX_GROUP_ROWS, row_numbers

# Fixed value: names usable as identifiers.
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
#: Characters of a record's error message that are shown by default.
ERROR_CHARS = 200
# What validation says.
NO_NAME = "Schema name is required"
NO_FIELDS = "Schema must have at least one field"
BAD_NAME = (
    "name must be a valid identifier "
    "(letters, digits, underscores, not starting with digit)"
)
DUPLICATE = "duplicate field name"
NO_ITEMS = "array type requires 'items' definition"
NO_PROPERTIES = "object type requires 'properties' definition"


def schema_fields(spark: SparkSession, schemas: Sequence[RecordSchema]) -> DataFrame:
    """Declared schemas as rows, one per field at any depth."""
    rows = [row for schema in schemas for row in field_rows(schema)]
    return spark.createDataFrame(rows, SCHEMA_FIELDS)


def schema_heads(spark: SparkSession, schemas: Sequence[RecordSchema]) -> DataFrame:
    return spark.createDataFrame(
        [(s.name, s.version, s.description) for s in schemas],
        "schema_name string, version int, description string",
    )


def field_errors(fields: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """(schema_name, version, ordinal, path, message): every broken field rule."""
    # siblings share the field around them; two parents may have the same path
    siblings = ["schema_name", "version", "parent_ordinal", "parent_path", "name"]
    numbered = row_numbers(fields, siblings, ["ordinal"], "_nth", max_group_rows)
    label = F.concat(F.lit("Field '"), F.col("path"), F.lit("': "))
    rules = F.array_compact(
        F.array(
            F.when(
                ~F.col("name").rlike(IDENTIFIER),
                F.concat(label, F.lit(BAD_NAME)),
            ),
            F.when(F.col("_nth") > 1, F.concat(label, F.lit(DUPLICATE))),
            F.when(
                ~F.col("type").isin(list(FIELD_TYPES)),
                F.concat(label, F.lit("invalid type '"), F.col("type"), F.lit(KNOWN_TYPES)),
            ),
            F.when(
                (F.col("type") == "array") & ~F.col("has_items"),
                F.concat(label, F.lit(NO_ITEMS)),
            ),
            F.when(
                (F.col("type") == "object") & (F.col("n_properties") == 0),
                F.concat(label, F.lit(NO_PROPERTIES)),
            ),
        )
    )
    return numbered.select(
        "schema_name", "version", "ordinal", "path", F.explode(rules).alias("message")
    )


def validate_schemas(heads: DataFrame, fields: DataFrame) -> DataFrame:
    """(schema_name, version, message) for all schemas; no rows means valid."""
    key = ["schema_name", "version"]
    unnamed = heads.filter(
        F.col("schema_name").isNull() | tx.is_blank(F.col("schema_name"))
    ).select(*key, F.lit(NO_NAME).alias("message"))
    bare = heads.join(fields, key, "left_anti").select(
        *key, F.lit(NO_FIELDS).alias("message")
    )
    return unnamed.unionByName(bare).unionByName(
        field_errors(fields).select(*key, "message")
    )


def validate_schema(spark: SparkSession, schema: RecordSchema) -> list[str]:
    """Problems of one schema, in reading order."""
    fields = schema_fields(spark, [schema])
    problems = [] if schema.name.strip() else [NO_NAME]
    if not schema.fields:
        return [*problems, NO_FIELDS]
    rows = field_errors(fields).orderBy("ordinal").select("message").collect()
    return problems + [r.message for r in rows]


def field_line(indent: str, required_mark: str) -> Column:
    """``- name: type`` with mark and description, indented by depth."""
    return F.concat(
        F.expr(f"repeat('{indent}', depth)"),
        F.lit("- "),
        F.col("name"),
        F.lit(": "),
        F.col("type"),
        F.when(F.col("required"), F.lit(required_mark)).otherwise(F.lit("")),
        F.when(
            F.coalesce(F.col("description"), F.lit("")) != "",
            F.concat(F.lit(" -- "), F.col("description")),
        ).otherwise(F.lit("")),
    )


def describe_schemas(fields: DataFrame) -> DataFrame:
    """One readable line per field; sort by ordinal to get the tree."""
    return fields.select(
        "schema_name",
        "version",
        "ordinal",
        "path",
        field_line("  ", " (required)").alias("line"),
    )


def next_versions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Give incoming schema heads the version after the last one stored."""
    last = current.groupBy("schema_name").agg(F.max("version").alias("_last"))
    return incoming.join(last, "schema_name", "left").select(
        "schema_name",
        (F.coalesce(F.col("_last"), F.lit(0)) + 1).cast("int").alias("version"),
        "description",
    )


def latest_versions(heads: DataFrame) -> DataFrame:
    """The current head of every schema."""
    return heads.groupBy("schema_name").agg(
        F.max("version").alias("version"),
        F.max_by("description", "version").alias("description"),
    )


# -- records ------------------------------------------------------------------


# Accepted spellings of booleans.
_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")

_CURRENCY = r"^(?:[A-Z]{3}\s*)?[$\u20ac\u00a3\u00a5]?\s*|\s*(?:[$\u20ac\u00a3\u00a5]|[A-Z]{3})$"
# the comma comes first, so that the look-behind runs at commas only
_GROUPING = r",(?=\d{3}(?:,\d{3})*(?:\.\d+)?$)(?<=^[+-]?\d{1,3}(?:,\d{3}){0,12},)"
_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"


def _number(raw: Column) -> Column:
    """Text to double; currency signs, codes and digit grouping may surround it."""
    bare = F.regexp_replace(tx.strip(raw), _CURRENCY, "")
    plain = F.regexp_extract(F.regexp_replace(bare, _GROUPING, ""), _NUMBER, 1)
    return plain.try_cast("double")


def _boolean(raw: Column) -> Column:
    pairs = [(w, True) for w in _TRUE] + [(w, False) for w in _FALSE]
    words = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(words, F.lower(tx.strip(raw)))


def coerce(definition: FieldDef, raw: Column) -> Column:
    """Raw text to a declared scalar type; null where that is not possible.

    Each rule mentions the raw text once, so it is computed once.
    """
    if definition.type == "number":
        return _number(raw)
    if definition.type == "boolean":
        return _boolean(raw)
    return raw


LEFT_OUT = "array<struct<path:string,text:string>>"


def coerce_nested(definition: FieldDef, raw: Column, path: Column, checked: bool = True) -> Column:
    """Raw text to ``struct<value, problems, left_out>``, by one rule set at all
    depths.

    Items and properties are coerced like top-level fields. ``problems`` names
    the path of each one that does not fit or is missing. ``left_out`` has path
    and text of what the typed value cannot hold: members that were not
    declared and, unless ``checked``, values that do not fit, which then are no
    problem.
    """
    none, nothing = F.array().cast("array<string>"), F.array().cast(LEFT_OUT)

    def outcome(value: Column, problems: Column = none, left_out: Column = nothing) -> Column:
        return F.struct(
            value.cast(spark_type(definition)).alias("value"),
            problems.alias("problems"),
            left_out.alias("left_out"),
        )

    def misfit(bad: Column) -> tuple[Column, Column]:
        message = F.concat(path, F.lit(f": not a valid {definition.type}: "), raw)
        said = F.when(bad, F.array(message)).otherwise(none) if checked else none
        kept = F.array(F.struct(path.alias("path"), raw.alias("text"))).cast(LEFT_OUT)
        return said, nothing if checked else F.when(bad, kept).otherwise(nothing)

    if not definition.is_nested:
        return tx.let(
            coerce(definition, raw), lambda v: outcome(v, *misfit(raw.isNotNull() & v.isNull()))
        )
    missing = F.lit(None).cast(spark_type(definition))
    refused = outcome(missing, *misfit(raw.isNotNull()))
    if definition.type == "array":
        items = F.from_json(F.regexp_extract(raw, r"(?s)^\s*(\[.*)$", 1), "array<string>")
        if holds_texts(definition):  # items that are text fit as they are
            return tx.let(items, lambda x: F.when(x.isNull(), refused).otherwise(outcome(x)))

        def item(text: Column, i: Column) -> Column:
            own = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            return coerce_nested(definition.items, text, own, checked)

        def array(results: Column) -> Column:
            return outcome(
                F.transform(results, lambda r: r["value"]),
                F.flatten(F.transform(results, lambda r: r["problems"])),
                F.flatten(F.transform(results, lambda r: r["left_out"])),
            )

        return tx.let(
            items,
            lambda x: F.when(x.isNull(), refused).otherwise(tx.let(F.transform(x, item), array)),
        )
    members = F.from_json(F.regexp_extract(raw, r"(?s)^\s*(\{.*)$", 1), "map<string,string>")
    if not definition.properties:
        return tx.let(members, lambda m: F.when(m.isNull(), refused).otherwise(outcome(m)))
    names = [p.name for p in definition.properties]

    def below(name: str) -> Column:
        return F.concat(path, F.lit(f".{name}"))

    def opened(m: Column) -> Column:
        parts = F.struct(
            *[
                coerce_nested(p, F.try_element_at(m, F.lit(p.name)), below(p.name), checked).alias(
                    f"p{i}"
                )
                for i, p in enumerate(definition.properties)
            ]
        )
        absent = [
            F.when(
                F.try_element_at(m, F.lit(p.name)).isNull(),
                F.concat(below(p.name), F.lit(": required field is missing")),
            )
            for p in definition.properties
            if p.required and checked
        ]
        others = F.transform(
            F.filter(F.map_entries(m), lambda e: ~e["key"].isin(names)),
            lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("text")),
        )

        def whole(found: Column) -> Column:
            own = [found[f"p{i}"] for i in range(len(names))]
            problems = [o["problems"] for o in own]
            if absent:
                problems.append(F.array_compact(F.array(*absent)))
            return outcome(
                F.struct(*[o["value"].alias(n) for o, n in zip(own, names)]),
                F.concat(*problems),
                F.concat(*[o["left_out"] for o in own], others.cast(LEFT_OUT)),
            )

        return tx.let(parts, whole)

    return tx.let(members, lambda m: F.when(m.isNull(), refused).otherwise(opened(m)))


def holds_texts(definition: FieldDef) -> bool:
    """An array whose items are text, which needs no further coercion."""
    return definition.type == "array" and (
        definition.items is None or definition.items.type in ("string", "date")
    )


def compute_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that later filters cannot pull apart.

    Spark moves a filter on a computed column below the projection and then
    computes the column twice. It leaves the output of a generator alone, so
    the columns come out of one that yields exactly one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def conform(
    records: DataFrame,
    schema: RecordSchema,
    raw: str = "raw",
    error: str | None = None,
    nested_check: bool = True,
    left_out: str | None = None,
    error_chars: int | None = ERROR_CHARS,
) -> DataFrame:
    """Raw field texts to typed records with a status and errors.

    ``raw`` is a struct with one string per schema field, or an array of strings
    for an array of texts (missing members count as null). A missing required
    field, or any value that cannot be read as its type, fails the record, at
    any depth: its data is null and its message says why, cut to ``error_chars``
    (None: whole). ``error`` may name a column with an earlier failure.

    With ``nested_check=False`` only the fields themselves are checked; items
    and properties that do not fit are null. ``left_out`` names a column to add,
    a list of paths and texts of what the typed data does not hold: members that
    were not declared, and those unfit items and properties.
    """
    present = {f.name: f.dataType for f in records.schema[raw].dataType.fields}
    ready = {
        f.name
        for f in schema.fields
        if holds_texts(f) and isinstance(present.get(f.name), T.ArrayType)
    }
    kept = [c for c in records.columns if c not in (raw, error)]
    names = [(f, f"_t{i}", f"_v{i}") for i, f in enumerate(schema.fields)]
    nested = {f.name for f in schema.fields if f.is_nested and f.name not in ready}
    texts = [
        (F.col(raw)[f.name] if f.name in present else F.lit(None).cast("string")).alias(t)
        for f, t, _ in names
    ]
    earlier = (F.col(error) if error else F.lit(None).cast("string")).alias("_earlier")

    def read(f: FieldDef, text: Column) -> Column:
        if f.name in ready:
            return text
        return _field(f, text, nested_check) if f.name in nested else coerce(f, text)

    typed = compute_once(
        compute_once(records, *texts, earlier).select(
            *kept, "_earlier", *[t for _, t, _ in names]
        ),
        *[read(f, F.col(t)).alias(v) for f, t, v in names],
    )
    value = {f.name: F.col(v)["value"] if f.name in nested else F.col(v) for f, _, v in names}
    problems, broken = [], F.col("_earlier").isNotNull()
    for f, t, v in names:
        if f.required:
            absent = F.col(t).isNull()
            said = F.when(absent, F.array(F.lit(f"{f.name}: required field is missing")))
            problems.append(said)
            broken = broken | absent
        if f.name in nested:
            problems.append(F.col(v)["problems"])
            broken = broken | (F.size(F.col(v)["problems"]) > 0)
        elif f.name not in ready:
            unfit = F.col(t).isNotNull() & F.col(v).isNull()
            said = F.concat(F.lit(f"{f.name}: not a valid {f.type}: "), t)
            problems.append(F.when(unfit, F.array(said)))
            broken = broken | unfit
    found = F.flatten(F.array_compact(F.array(F.array().cast("array<string>"), *problems)))
    message = F.coalesce(F.col("_earlier"), F.array_join(found, "; "))
    if error_chars is not None:
        message = tx.shorten(message, error_chars)
    data = F.struct(*[value[f.name].alias(f.name) for f in schema.fields])
    extra = []
    if left_out:
        parts = [F.col(v)["left_out"] for f, _, v in names if f.name in nested]
        extra = [F.concat(F.array().cast(LEFT_OUT), *parts).alias(left_out)]
    return typed.select(
        *kept,
        F.when(~broken, data).cast(typed_struct(schema)).alias("data"),
        F.when(broken, F.lit(FAILED)).otherwise(F.lit(SUCCESS)).alias("status"),
        F.when(broken, F.array(message))
        .otherwise(F.array().cast("array<string>"))
        .alias("errors"),
        *extra,
    )


def _field(definition: FieldDef, text: Column, nested_check: bool) -> Column:
    """A nested top-level field: itself always checked, what is in it if asked."""
    found = coerce_nested(definition, text, F.lit(definition.name), nested_check)
    if nested_check:
        return found
    unfit = F.concat(F.lit(f"{definition.name}: not a valid {definition.type}: "), text)
    return tx.let(
        found,
        lambda r: F.struct(
            r["value"].alias("value"),
            F.when(text.isNotNull() & r["value"].isNull(), F.array(unfit))
            .otherwise(F.array().cast("array<string>"))
            .alias("problems"),
            r["left_out"].alias("left_out"),
        ),
    )


def parse_json_records(
    records: DataFrame, schema: RecordSchema, column: str = "json"
) -> DataFrame:
    """JSON objects as text to the ``raw`` struct that :func:`conform` takes.

    Members that are arrays or objects stay JSON text until they are coerced.
    Text that is not a JSON object sets ``parse_error``.
    """
    corrupt = "_corrupt"
    shape = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schema.fields]
        + [T.StructField(corrupt, T.StringType())]
    )
    parsed = F.from_json(
        F.col(column), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    )
    opened = compute_once(
        records, parsed.alias("_parsed")
    )
    return opened.select(
        *[c for c in records.columns if c != column],
        F.when(
            F.col("_parsed").isNull() | F.col(f"_parsed.{corrupt}").isNotNull(),
            F.lit("not a JSON object"),
        ).alias("parse_error"),
        F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields]).alias(
            "raw"
        ),
    )
