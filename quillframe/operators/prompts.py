"""Request texts for services that extract records from documents.

Everything in a request follows from the schema: the field table is the one that
:func:`quillframe.model.field_rows` gives for validation, and a hint is only
given where the schema has something it applies to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.model import SCHEMA_FIELDS, RecordSchema, field_rows

# How a value of each type looks in the answer.
FORMS = {
    "array": "a JSON array",
    "boolean": "true or false",
    "date": "year, month and day as in 2024-12-31",
    "number": "digits without units or grouping",
    "object": "a JSON object",
    "string": "text as it stands in the document",
}


def field_table(schema: RecordSchema) -> list[str]:
    """A line ``path | type | need | description`` for each field at any depth."""
    names = SCHEMA_FIELDS.fieldNames()
    rows = (dict(zip(names, row)) for row in field_rows(schema))
    return [
        " | ".join(
            (r["path"], r["type"], "needed" if r["required"] else "optional", r["description"])
        ).rstrip(" |")
        for r in rows
    ]


def hints(schema: RecordSchema) -> list[str]:
    """The form of every type in use, and which fields must be there."""
    at = SCHEMA_FIELDS.fieldNames().index("type")
    used = sorted({row[at] for row in field_rows(schema)})
    found = [f"{kind}: {FORMS[kind]}" for kind in used]
    needed = [f.name for f in schema.fields if f.required]
    if needed:
        found.append(f"An answer without {', '.join(needed)} is of no use.")
    if len(needed) < len(schema.fields):
        found.append("An optional value that the text does not give is null.")
    return found


def system_text(schema: RecordSchema, instructions: str = "") -> str:
    """The part of the request that is the same for all documents."""
    about = f"{schema.name}: {schema.description}" if schema.description else schema.name
    parts = {
        "Record": [about],
        "Columns of the answer (path | type | need | meaning)": field_table(schema),
        "Values": hints(schema),
        "Notes": [instructions] if instructions else [],
        "Answer": [f"One JSON object with the keys {', '.join(schema.field_names)}."],
    }
    return "\n\n".join("\n".join([f"## {k}", *v]) for k, v in parts.items() if v)


def render_prompts(
    documents: DataFrame, schema: RecordSchema, instructions: str = ""
) -> DataFrame:
    """(document_id, system, user): one request per document.

    The system text is one literal in the plan, whatever the number of rows.
    """
    return documents.select(
        "document_id",
        F.lit(system_text(schema, instructions)).alias("system"),
        F.concat(F.lit("## Text\n"), F.col("content")).alias("user"),
    )
