"""Plain text: one paragraph block per stretch between blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import METADATA
from quillframe.sources.registry import Parser


def paragraphs(content: Column) -> Column:
    """Array of stripped, non-empty paragraphs. Only two newlines in a row
    separate; a file with CRLF line ends is a single paragraph."""
    return F.filter(
        F.transform(F.split(content, r"\n\n"), tx.strip), lambda p: p != ""
    )


def blocks(documents: DataFrame) -> DataFrame:
    return documents.select(
        "document_id",
        F.posexplode(paragraphs(F.col("content"))).alias("block_index", "content"),
    ).select(
        "document_id",
        "block_index",
        F.lit("paragraph").alias("block_type"),
        "content",
        F.create_map().cast(METADATA).alias("metadata"),
    )


def metadata(content: Column) -> Column:
    return F.create_map(
        F.lit("char_count"),
        F.length(content).cast("string"),
        F.lit("paragraph_count"),
        F.size(paragraphs(content)).cast("string"),
    )


PARSER = Parser(name="text", blocks=blocks, metadata=metadata)
