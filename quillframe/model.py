"""Data contracts: record schemas and the shapes of the tables.

A record schema is small, declared at run time, and lives on the driver.
Tables hold everything that grows with the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

# The six declarable field types.
FIELD_TYPES = ("array", "boolean", "date", "number", "object", "string")
# Fixed value: what an unknown type is told.
KNOWN_TYPES = f"'. Must be one of: {', '.join(FIELD_TYPES)}"

# Record states.
SUCCESS, FAILED, PARTIAL = "success", "failed", "partial"

_SCALAR_TYPES = {
    "string": T.StringType(),
    "date": T.StringType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}

METADATA = T.MapType(T.StringType(), T.StringType())

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("block_index", T.IntegerType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)

SCHEMA_FIELDS = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("parent_ordinal", T.IntegerType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("has_items", T.BooleanType()),
        T.StructField("n_properties", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    description: str = ""
    required: bool = False
    items: FieldDef | None = None
    properties: tuple[FieldDef, ...] = ()

    def __post_init__(self) -> None:
        if self.type not in FIELD_TYPES:
            raise ValueError(f"Invalid field type '{self.type}{KNOWN_TYPES}")

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> FieldDef:
        items = raw.get("items")
        return cls(
            name=raw["name"],
            type=raw["type"],
            description=raw.get("description") or "",
            required=bool(raw.get("required", False)),
            items=cls.from_dict(items) if items else None,
            properties=tuple(cls.from_dict(p) for p in raw.get("properties") or ()),
        )

    def to_dict(self) -> dict[str, Any]:
        raw: dict[str, Any] = {
            "name": self.name,
            "type": self.type,
            "description": self.description,
            "required": self.required,
        }
        if self.items:
            raw["items"] = self.items.to_dict()
        if self.properties:
            raw["properties"] = [p.to_dict() for p in self.properties]
        return raw

    @property
    def is_nested(self) -> bool:
        return self.type in ("array", "object")


@dataclass(frozen=True)
class RecordSchema:
    name: str
    fields: tuple[FieldDef, ...] = ()
    description: str = ""
    version: int = 1

    @classmethod
    def from_json(cls, text: str) -> RecordSchema:
        raw = json.loads(text)
        return cls(
            name=raw["name"],
            fields=tuple(FieldDef.from_dict(f) for f in raw.get("fields") or ()),
            description=raw.get("description") or "",
            version=int(raw.get("version", 1)),
        )

    def to_json(self) -> str:
        return json.dumps(
            {
                "name": self.name,
                "description": self.description,
                "version": self.version,
                "fields": [f.to_dict() for f in self.fields],
            }
        )

    def with_version(self, version: int) -> RecordSchema:
        return replace(self, version=version)

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass
class ExtractionSummary:
    total: int = 0
    succeeded: int = 0
    failed: int = 0


@dataclass
class ColumnInfo:
    name: str
    type: str


@dataclass
class QueryResult:
    columns: list[ColumnInfo] = field(default_factory=list)
    rows: list[list[Any]] = field(default_factory=list)
    total_rows: int = 0
    sql: str = ""


def spark_type(definition: FieldDef) -> T.DataType:
    """The typed form: arrays and objects become nested columns."""
    if definition.type == "array":
        item = spark_type(definition.items) if definition.items else T.StringType()
        return T.ArrayType(item)
    if definition.type == "object":
        if not definition.properties:
            return T.MapType(T.StringType(), T.StringType())
        return T.StructType(
            [T.StructField(p.name, spark_type(p)) for p in definition.properties]
        )
    return _SCALAR_TYPES[definition.type]


def storage_type(definition: FieldDef) -> T.DataType:
    """The flat form: arrays and objects are JSON text."""
    return T.StringType() if definition.is_nested else _SCALAR_TYPES[definition.type]


def typed_struct(schema: RecordSchema) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f)) for f in schema.fields])


def storage_struct(schema: RecordSchema) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, storage_type(f), not f.required) for f in schema.fields]
    )


def field_rows(schema: RecordSchema) -> Iterator[tuple]:
    """The field tree as rows of ``SCHEMA_FIELDS``, parents before children.

    Array items sit below ``<path>.items.``, properties below ``<path>.``.
    ``ordinal`` counts in reading order, so sorting by it restores the tree, and
    ``parent_ordinal`` is that of the field around it, 0 at the top: paths need
    not be unique, ordinals are.
    """
    counter = 0

    def walk(definition: FieldDef, parent: str, depth: int, above: int) -> Iterator[tuple]:
        nonlocal counter
        counter += 1
        own = counter
        path = f"{parent}{definition.name}"
        yield (
            schema.name,
            schema.version,
            above,
            parent,
            path,
            depth,
            own,
            definition.name,
            definition.type,
            definition.description,
            definition.required,
            definition.items is not None,
            len(definition.properties),
        )
        if definition.items is not None:
            yield from walk(definition.items, f"{path}.items.", depth + 1, own)
        for child in definition.properties:
            yield from walk(child, f"{path}.", depth + 1, own)

    for top in schema.fields:
        yield from walk(top, "", 0, 0)
