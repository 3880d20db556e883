"""What JSON records hold beyond their schema, as one VARIANT for each record.

Typed data has the declared members only. The others keep their own types in a
VARIANT of the same shape as the record: members that were not declared, below
the declared objects and array items that hold them. It is stored like any other
column and read with ``try_variant_get(open_members, '$.path', 'type')``.

An array stands in it with an entry for each item, null for items that have
nothing beyond. A record with nothing beyond, a null text, and a text that is
not a JSON object, or has a member twice, give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import FieldDef, RecordSchema


def _inside(definition: FieldDef) -> bool:
    """Whether a value of this field can hold members that were not declared."""
    if definition.type == "array":
        return definition.items is not None and _inside(definition.items)
    return definition.type == "object" and bool(definition.properties)


def _members_beyond(declared: list[FieldDef], value: Column) -> Column:
    """The undeclared members of a VARIANT object, at all depths."""
    names = [f.name for f in declared]

    def rest(members: Column) -> Column:
        found = F.map_filter(members, lambda name, _: ~name.isin(names))
        below = [
            F.struct(F.lit(f.name).alias("key"), _beyond(f, F.try_element_at(members, F.lit(f.name))).alias("value"))
            for f in declared
            if _inside(f)
        ]
        if below:
            kept = F.filter(F.array(*below), lambda e: e["value"].isNotNull())
            found = F.map_concat(found, F.map_from_entries(kept))
        return tx.let(found, lambda m: F.when(F.size(m) > 0, F.to_variant_object(m)))

    return tx.let(F.try_variant_get(value, "$", "map<string,variant>"), rest)


def _beyond(definition: FieldDef, value: Column) -> Column:
    if definition.type == "object":
        return _members_beyond(definition.properties, value)
    items = F.try_variant_get(value, "$", "array<variant>")
    return tx.let(
        F.transform(items, lambda item: _beyond(definition.items, item)),
        lambda found: F.when(F.exists(found, lambda x: x.isNotNull()), F.to_variant_object(found)),
    )


def with_open_members(
    records: DataFrame, schema: RecordSchema, column: str = "json", into: str = "open_members"
) -> DataFrame:
    """Add what the JSON texts of ``column`` hold beyond the schema."""
    return records.withColumn(into, _members_beyond(list(schema.fields), F.try_parse_json(column)))
