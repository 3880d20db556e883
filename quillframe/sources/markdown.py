"""Markdown: header, code and paragraph blocks.

A document is one row, and its blocks are built inside that row with array
functions. Each step cuts the line array at known positions, so the work is
linear in the text, and there is no shuffle, no window and no Python worker.

Fence lines cut a document into stretches that alternate between prose and
code. Inside prose, header and blank lines cut off the paragraphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import METADATA
from quillframe.sources.registry import Parser

FENCE = "```"
HEADER = rf"^#{{1,6}}{tx.WHITESPACE_CLASS}"
_HEADER_PARTS = rf"(?s)^(#{{1,6}}){tx.WHITESPACE_CLASS}+(.*)\z"


def _cut_positions(lines: Column, cuts: Callable[[Column], Column]) -> Column:
    """0-based positions of the cutting lines, between two sentinels."""
    numbered = F.transform(
        lines, lambda line, i: F.struct(i.alias("at"), cuts(line).alias("cut"))
    )
    hits = F.transform(F.filter(numbered, lambda x: x["cut"]), lambda x: x["at"])
    return F.concat(F.array(F.lit(-1)), hits, F.array(F.size(lines)))


def _stretches(positions: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """``build(k, previous cut, next cut)`` for every stretch between cuts."""
    return F.transform(
        F.slice(positions, F.lit(1), F.size(positions) - 1),
        lambda at, k: build(k, at, F.get(positions, k + 1)),
    )


def _between(lines: Column, before: Column, after: Column) -> Column:
    return F.slice(lines, before + 2, F.greatest(after - before - 1, F.lit(0)))


def _block(kind: str, content: Column, level: Column, language: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("block_type"),
        content.alias("content"),
        level.cast("string").alias("level"),
        language.alias("language"),
    )


def _none() -> Column:
    return F.lit(None).cast("string")


def _header_block(line: Column) -> Column:
    return _block(
        "header",
        tx.strip(F.regexp_extract(line, _HEADER_PARTS, 2)),
        F.length(F.regexp_extract(line, _HEADER_PARTS, 1)),
        _none(),
    )


def _prose_blocks(lines: Column) -> Column:
    """Headers and paragraphs of a stretch without fences."""

    def build(positions: Column) -> Column:
        def stretch(k: Column, before: Column, after: Column) -> Column:
            body = F.array_join(_between(lines, before, after), "\n")
            paragraph = F.filter(
                F.array(_block("paragraph", body, _none(), _none())),
                lambda b: b["content"] != "",
            )
            # the line that opened this stretch is a header or blank
            opener = F.get(lines, before)
            header = F.when(
                (before >= 0) & opener.rlike(HEADER), F.array(_header_block(opener))
            ).otherwise(F.array().cast(_BLOCK_ARRAY))
            return F.concat(header, paragraph)

        return F.flatten(_stretches(positions, stretch))

    return tx.let(
        _cut_positions(lines, lambda line: line.rlike(HEADER) | tx.is_blank(line)),
        build,
    )


_BLOCK_ARRAY = "array<struct<block_type:string,content:string,level:string,language:string>>"


def block_array(content: Column) -> Column:
    """All blocks of a document, in reading order."""

    def from_lines(lines: Column) -> Column:
        def from_fences(fences: Column) -> Column:
            def stretch(k: Column, before: Column, after: Column) -> Column:
                opener = tx.strip(F.get(lines, before))
                language = tx.strip(F.substr(opener, F.lit(len(FENCE) + 1)))
                code = F.array(
                    _block(
                        "code",
                        F.array_join(_between(lines, before, after), "\n"),
                        _none(),
                        F.nullif(language, F.lit("")),
                    )
                )
                return F.when(k % 2 == 1, code).otherwise(
                    tx.let(_between(lines, before, after), _prose_blocks)
                )

            return F.flatten(_stretches(fences, stretch))

        return tx.let(
            _cut_positions(lines, lambda line: F.startswith(tx.strip(line), F.lit(FENCE))),
            from_fences,
        )

    return tx.let(F.split(content, "\n"), from_lines)


def blocks(documents: DataFrame) -> DataFrame:
    exploded = documents.select(
        "document_id", F.posexplode(block_array(F.col("content"))).alias("block_index", "b")
    )
    return exploded.select(
        "document_id",
        "block_index",
        "b.block_type",
        "b.content",
        F.map_filter(
            F.create_map(
                F.lit("level"), F.col("b.level"), F.lit("language"), F.col("b.language")
            ),
            lambda _, v: v.isNotNull(),
        )
        .cast(METADATA)
        .alias("metadata"),
    )


def metadata(content: Column) -> Column:
    return F.create_map(
        F.lit("char_count"),
        F.length(content).cast("string"),
        F.lit("block_count"),
        F.size(block_array(content)).cast("string"),
    )


PARSER = Parser(name="markdown", blocks=blocks, metadata=metadata)
