"""Queries over files that are larger than a task: split CSV and parts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.plans.catalogue import query, table
from quillframe.session import scratch_path
from quillframe.sources import large_documents, split_csv


def _parts_csv(spark: SparkSession, sf_dir: str) -> str:
    """Parts as one CSV file per task of the scan, with line breaks and quotes in a value."""
    path = scratch_path(spark, "parts-csv")
    note = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('",\r\n'), "p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", note.alias("note"), "p_size", "p_retailprice")
    rows.write.options(header=True, escape='"').csv(path)
    return path


_NOTE = """p_name || chr(10) || '"' || p_type || '",' || chr(13) || chr(10) || p_brand"""


@query(
    f"""
SELECT p_partkey, {_NOTE} AS note, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part
"""
)
def csv_multiline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold line breaks, read back in splits with the types found."""
    found = split_csv.read_split_csv(spark, _parts_csv(spark, sf_dir))
    return found.select(
        F.col("p_partkey").cast("long").alias("p_partkey"), "note", F.col("p_size").cast("long").alias("p_size"), "p_retailprice"
    )


@query(
    f"""
SELECT 'row' AS block_type, count(*) AS blocks, CAST(sum(length(content)) AS BIGINT) AS chars,
       max(content) AS last_content
FROM (SELECT p_partkey || ',' || {_NOTE} || ',' || p_size || ',' || p_retailprice AS content, p_brand FROM part)
GROUP BY p_brand
"""
)
def csv_blocks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row blocks of CSV documents of any size, by the brand at the end of the note."""
    found = split_csv.blocks(spark, _parts_csv(spark, sf_dir)).where("block_type = 'row'")
    brand = F.regexp_extract("content", r"\r\n([^,]*),", 1)
    return found.groupBy("block_type", brand.alias("brand")).agg(
        F.count("*").alias("blocks"),
        F.sum(F.length("content")).alias("chars"),
        F.max("content").alias("last_content"),
    ).drop("brand")


def _written(spark: SparkSession, sf_dir: str, text: str, label: str) -> str:
    """The documents as lines of a few large files, as many as the scan has tasks."""
    path = scratch_path(spark, label)
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(text).alias("value")).write.text(path)
    return path


@query(
    """
SELECT 'header' AS block_type, 'D' || doc_id AS content, '1' AS level, CAST(NULL AS VARCHAR) AS language
FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT 'code', text, NULL, lang FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT 'paragraph', 'from ' || source, NULL, NULL FROM documents WHERE text IS NOT NULL
"""
)
def large_document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of Markdown files that are never rows: header, fenced text, source."""
    text = r"concat('# D', doc_id, '\n```', lang, '\n', text, '\n```\n\nfrom ', source, '\n')"
    found = large_documents.markdown_blocks(spark, _written(spark, sf_dir, text, "large-markdown"))
    return found.select(
        "block_type",
        "content",
        F.element_at("metadata", "level").alias("level"),
        F.element_at("metadata", "language").alias("language"),
    )


@query(
    """
SELECT CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum(length(p)) AS BIGINT) AS chars, min(p) AS first_one, max(p) AS last_one
FROM (SELECT 'document ' || doc_id || chr(10) || text || chr(10) || 'from ' || source AS p FROM documents
      WHERE text IS NOT NULL)
"""
)
def large_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of text files that are never rows, one for each document."""
    text = r"concat('document ', doc_id, '\n', text, '\nfrom ', source, '\n')"
    found = large_documents.text_blocks(spark, _written(spark, sf_dir, text, "large-text"))
    return found.agg(
        F.count("*").alias("paragraphs"),
        F.sum(F.length("content")).alias("chars"),
        F.min("content").alias("first_one"),
        F.max("content").alias("last_one"),
    )


@query(
    """
SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, true AS gapless FROM documents WHERE text IS NOT NULL
"""
)
def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in parts: how many bytes, and whether each part starts where the
    one before it ends."""
    found = large_documents.parts(spark, _written(spark, sf_dir, "text", "large-parts"), part_bytes=1 << 16)
    size = F.octet_length("content").cast("long")
    ends = found.groupBy("document_id").agg(
        F.sum(size).alias("bytes"), F.max(F.col("offset") + size).alias("last"), F.count_distinct("part").alias("n"), F.max("part").alias("top")
    )
    gapless = (F.col("bytes") == F.col("last")) & (F.col("n") == F.col("top") + 1)
    return ends.agg(F.sum("bytes").alias("bytes"), F.bool_and(gapless).alias("gapless"))
