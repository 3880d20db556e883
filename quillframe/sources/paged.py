"""Paged documents: (document_id, page_no, text) rows to page blocks.

How page texts are obtained is up to the caller: any table with these columns
will do, and :func:`pages_from_bytes` runs a page reader over file bytes.
Pages stay rows. Whole contents are only put together in parts of bounded
size, so one huge document does not end up in one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import text as tx
from quillframe.model import METADATA
from quillframe.operators.ordered import MAX_GROUP_ROWS, running_sum
from quillframe.sources.registry import Parser

PAGE_BREAK = "\n\n"
PART_CHARS = 32 * 1024 * 1024

PAGES = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("page_no", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def pages_from_bytes(
    files: DataFrame, read_pages: Callable[[bytes], list[str]]
) -> DataFrame:
    """Run a page reader on (document_id, content bytes) rows.

    A file the reader cannot handle gives one row with ``error`` set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, content in zip(batch["document_id"], batch["content"]):
                try:
                    texts, error = read_pages(bytes(content)), None
                except Exception as problem:  # any reader failure concerns one file
                    texts, error = [None], str(problem) or type(problem).__name__
                yield pd.DataFrame(
                    {
                        "document_id": document_id,
                        "page_no": range(1, len(texts) + 1),
                        "text": texts,
                        "error": error,
                    }
                )

    return files.select("document_id", "content").mapInPandas(run, PAGES)


def page_arrays(
    files: DataFrame, read_pages: Callable[[bytes], list[str]]
) -> DataFrame:
    """(path, filename, file_type, pages, reason): all pages of a file in one row,
    for files that fit into one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, reasons = [], []
            for content in batch["content"]:
                try:
                    pages.append([p or "" for p in read_pages(bytes(content))])
                    reasons.append(None)
                except Exception as problem:  # any reader failure concerns one file
                    pages.append(None)
                    reasons.append(str(problem) or type(problem).__name__)
            yield batch.drop(columns="content").assign(pages=pages, reason=reasons)

    return files.select("path", "filename", "file_type", "content").mapInPandas(
        run,
        "path string, filename string, file_type string, pages array<string>, reason string",
    )


def _stored_blocks(documents: DataFrame) -> DataFrame:
    """Page blocks of stored documents, cut out of the content by page length."""
    lengths = F.from_json(F.col("metadata")["page_lengths"], "array<int>")
    starts = F.aggregate(
        "_lengths",
        F.array(F.lit(1)),
        lambda found, n: F.concat(
            found, F.array(F.element_at(found, -1) + n + len(PAGE_BREAK))
        ),
    )
    pages = F.transform(
        "_lengths",
        lambda n, i: F.struct(
            (i + 1).cast("long").alias("page_no"),
            F.substr("content", F.get("_starts", i), n).alias("text"),
        ),
    )
    opened = documents.withColumn("_lengths", lengths).withColumn("_starts", starts)
    rows = opened.select("document_id", F.inline(pages))
    return page_blocks(rows).withColumn("block_index", F.col("block_index").cast("int"))


def _pages_metadata(pages: Column) -> Column:
    joined = F.length(F.array_join(pages, PAGE_BREAK))
    return F.create_map(
        F.lit("page_count"),
        F.size(pages).cast("string"),
        F.lit("char_count"),
        joined.cast("string"),
        F.lit("page_lengths"),
        F.to_json(F.transform(pages, F.length)),
    )


def page_parser(name: str, read_pages: Callable[[bytes], list[str]]) -> Parser:
    """A parser for paged files, given a function that reads their pages."""
    return Parser(name, _stored_blocks, _pages_metadata, read_pages=read_pages)


def page_blocks(pages: DataFrame) -> DataFrame:
    """One block per page that is not blank."""
    body = tx.strip(F.col("text"))
    return pages.filter(body != "").select(
        "document_id",
        F.col("page_no").cast("long").alias("block_index"),
        F.lit("paragraph").alias("block_type"),
        body.alias("content"),
        F.create_map(F.lit("page"), F.col("page_no").cast("string"))
        .cast(METADATA)
        .alias("metadata"),
    )


def paged_documents(pages: DataFrame) -> DataFrame:
    """Page and character counts per document, without building its content."""
    return pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        (
            F.sum(F.length("text")) + len(PAGE_BREAK) * (F.count(F.lit(1)) - 1)
        ).alias("char_count"),
    )


def page_contents(
    pages: DataFrame,
    part_chars: int = PART_CHARS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Document contents in numbered parts: pages joined by a blank line.

    A document of up to ``part_chars`` characters is one part. Joining the
    parts of a document in order with a blank line gives its whole content.
    """
    sized = pages.select("document_id", "page_no", "text").withColumn(
        "_chars", (F.length("text") + len(PAGE_BREAK)).cast("long")
    )
    offset = running_sum(
        sized, ["document_id"], ["page_no"], "_chars", "_end", max_group_rows
    )
    part = F.floor((F.col("_end") - F.col("_chars")) / F.lit(part_chars))
    parts = (
        offset.withColumn("part_no", part.cast("long"))
        .groupBy("document_id", "part_no")
        .agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
    )
    return parts.select(
        "document_id",
        "part_no",
        F.array_join(F.col("_p.text"), PAGE_BREAK).alias("content"),
    )
