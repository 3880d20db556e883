"""CSV documents: a header block and one block per data row.

Records and fields are cut out of the text by quote-aware patterns, as array
expressions: no Python worker, no shuffle, no window. A field that starts with
a quote runs to its closing quote, doubled quotes inside stand for one, and
what follows up to the next comma is added as it is; in other fields quotes are
ordinary characters. A quote that is never closed takes the rest of the text.

Records of 30,000 fields, and fields of 30,000 doubled quotes, were tested. A file
that is larger than a row, or is a *table*, is read in splits by
:mod:`quillframe.sources.split_csv`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import METADATA
from quillframe.sources.registry import Parser

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_PLAIN = r"[^,\r\n]*+"
_CLOSED = rf'(?:{_QUOTED}"{_PLAIN}|(?!"){_PLAIN})'
_FIELD = rf'(?:{_QUOTED}(?:"{_PLAIN}|\z)|{_PLAIN})'
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(\r\n|\n|\r|\z)"
_UNCLOSED = rf"(?s)^(?:{_CLOSED},)*+{_QUOTED}\z"


# Fixed value: why a text is not CSV.
LONE_RETURN = (
    "new-line character seen in unquoted field - do you need to open the file with newline=''?"
)


def failure(content: Column) -> Column:
    """A carriage return that ends a record but not a line is refused."""
    cut = lambda group: F.regexp_extract_all(content, F.lit(_RECORD), F.lit(group))
    lone = tx.let(
        cut(2),
        lambda ends: F.exists(
            F.zip_with(ends, F.slice(cut(1), F.lit(2), F.size(ends)), lambda e, r: (e == "\r") & (r != "")),
            lambda found: F.coalesce(found, F.lit(False)),
        ),
    )
    return F.when(content.rlike(r"\r(?!\n)") & lone, F.lit(LONE_RETURN))


def records(content: Column) -> Column:
    """The texts of all records; a line break at the end adds none."""
    found = F.regexp_extract_all(content, F.lit(_RECORD), F.lit(1))
    # behind the last record, the end of the text matches once more
    return tx.let(found, lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))))


def fields(record: Column) -> Column:
    """The values of a record's fields; a blank line has none."""
    closed = F.when(record.rlike(_UNCLOSED), F.concat(record, F.lit('"'))).otherwise(record)
    found = F.regexp_extract_all(F.concat(closed, F.lit(",")), F.lit(rf"({_FIELD}),"), F.lit(1))

    def value(field: Column) -> Column:
        inner = F.regexp_extract(field, rf'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)\z', 1)
        rest = F.regexp_extract(field, rf"(?s)^{_QUOTED}\"(.*)\z", 1)
        return F.when(
            field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)
        ).otherwise(field)

    none = F.array().cast("array<string>")
    return F.when(record == "", none).otherwise(F.transform(found, value))


def _json_list(texts: Column) -> Column:
    """A JSON list with a blank behind each comma."""
    quoted = F.transform(texts, lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def blocks(documents: DataFrame) -> DataFrame:
    rows = F.transform(records(F.col("content")), fields)
    meta = F.when(
        F.col("block_index") == 0, F.create_map(F.lit("columns"), _json_list(F.col("fields")))
    ).otherwise(
        F.create_map(F.lit("row_index"), (F.col("block_index") - 1).cast("string"))
    )
    whole = documents.filter(failure(F.col("content")).isNull())
    return whole.select("document_id", F.posexplode(rows).alias("block_index", "fields")).select(
        "document_id",
        "block_index",
        F.when(F.col("block_index") == 0, "header").otherwise("row").alias("block_type"),
        F.array_join("fields", ",").alias("content"),
        meta.cast(METADATA).alias("metadata"),
    )


def metadata(content: Column) -> Column:
    """Row count, column count and the header's columns."""
    return tx.let(
        records(content),
        lambda r: tx.let(
            F.coalesce(fields(F.get(r, F.lit(0))), F.array().cast("array<string>")),
            lambda header: F.create_map(
                F.lit("row_count"),
                F.greatest(F.size(r) - 1, F.lit(0)).cast("string"),
                F.lit("column_count"),
                F.size(header).cast("string"),
                F.lit("columns"),
                F.to_json(header),
            ),
        ),
    )


PARSER = Parser(name="csv", blocks=blocks, metadata=metadata, failure=failure)
