"""Ingest queries: listing, parsing to blocks, reading documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import BLOCKS
from quillframe.plans import render
from quillframe.plans.catalogue import query, table
from quillframe.session import materialise, scratch_path
from quillframe.sources import csv_documents, ingest, listing, markdown, paged, plaintext
from quillframe.sources.registry import Parser
from quillframe.sources.tables import read_csv_table

# Fixed value: Python's line boundaries, in RE2 syntax.
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Fixed value: Python's whitespace, in RE2 syntax.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: ``lined(doc_id, parts)``: every document as its array of lines.
_LINED = rf"""
cut AS (SELECT doc_id, regexp_split_to_array(text, '{_BREAK}') AS p FROM documents),
lined AS (
  SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts FROM cut
)
"""

_FILES = """
files AS (
  SELECT doc_id, lang, text,
         'doc_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') ||
           CASE lang WHEN 'fr' THEN '.md' WHEN 'de' THEN '.TXT'
                     WHEN 'es' THEN '.log' ELSE '.txt' END AS filename,
         'corpus/' || source || '/' AS folder,
         CASE lang WHEN 'fr' THEN '.md' WHEN 'es' THEN '.log' ELSE '.txt' END AS file_type
  FROM documents
)
"""


@query(
    f"""
WITH {_FILES}, sized AS (
  SELECT filename, regexp_extract(filename, '\\.[a-zA-Z]+$') AS extension,
         octet_length(encode(text)) AS n
  FROM files
)
SELECT filename AS name, extension,
       CASE WHEN n < 1024 THEN n || ' B' ELSE format('{{:.1f}} KB', n / 1024.0::DOUBLE) END AS size
FROM sized
"""
)
def list_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing says of the documents as files."""
    found = listing.describe_files(render.text_files(spark, sf_dir))
    return found.select("name", "extension", "size")


@query(
    """
SELECT doc_id,
  CASE WHEN n_chars < 1024 THEN n_chars || ' B'
       ELSE format('{:.1f} KB', n_chars / 1024.0::DOUBLE) END AS small_label,
  CASE WHEN n_chars < 1024 THEN format('{:.1f} KB', n_chars::DOUBLE)
       ELSE format('{:.1f} MB', n_chars / 1024.0::DOUBLE) END AS large_label
FROM documents
"""
)
def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes read once as bytes and once as kibibytes."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.size_label(F.col("n_chars")).alias("small_label"),
        tx.size_label(F.col("n_chars") * 1024).alias("large_label"),
    )


@query(
    f"""
WITH {_LINED}
SELECT doc_id, CAST(len(parts) AS BIGINT) AS total_lines, CAST(i AS BIGINT) AS line_no,
       parts[i] AS line
FROM lined, unnest(range(1, least(len(parts), 50) + 1)) AS t(i)
"""
)
def file_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.text_documents(spark, sf_dir)
    sample = listing.file_sample(docs, "document_id", max_lines=50)
    return sample.select(
        F.col("document_id").cast("long").alias("doc_id"),
        F.col("total_lines").cast("long").alias("total_lines"),
        F.col("line_no").cast("long").alias("line_no"),
        "line",
    )


@query(
    f"""
WITH {_FILES}, {_LINED}
SELECT filename AS name, regexp_extract(filename, '\\.[a-zA-Z]+$') AS extension,
       CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
       CAST(len(parts) AS BIGINT) AS line_count
FROM files JOIN lined USING (doc_id)
"""
)
def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = render.text_files(spark, sf_dir).withColumn(
        "modificationTime", F.lit(None).cast("timestamp")
    )
    return listing.file_info(files).drop("path", "modified")


@query(
    f"""
WITH {_FILES}
SELECT folder || filename AS path, filename, file_type,
       CAST(length(text) AS BIGINT) AS chars, md5(text) AS content_md5,
       CAST(row_number() OVER (ORDER BY folder || filename) AS BIGINT) AS doc_index
FROM files WHERE file_type <> '.log'
"""
)
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ingest.number(ingest.documents(render.text_files(spark, sf_dir)))
    return docs.select(
        "path",
        "filename",
        "file_type",
        F.length("content").cast("long").alias("chars"),
        F.md5("content").alias("content_md5"),
        "doc_index",
    )


@query(
    f"""
WITH {_FILES}
SELECT folder || filename AS path, filename,
       'Unsupported file extension ''.log''. Supported: .csv, .md, .txt' AS message
FROM files WHERE file_type = '.log'
"""
)
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_errors(render.text_files(spark, sf_dir))


@query(
    f"""
WITH {_FILES}, kept AS (
  SELECT folder || filename AS path, file_type, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run
  FROM files WHERE file_type <> '.log'
)
SELECT path, file_type, CAST(row_number() OVER (ORDER BY run, path) AS BIGINT) AS doc_index
FROM kept
"""
)
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English files first, then the whole folder twice more."""
    files = render.text_files(spark, sf_dir)
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select(
        F.format_string("%012d", "doc_id").alias("_n")
    )
    number = F.regexp_extract("path", r"doc_(\d+)\.", 1)
    first = files.join(english, number == F.col("_n"), "left_semi")
    docs = ingest.number(ingest.documents(first))
    for _ in range(2):
        docs = ingest.append_documents(docs, files)
    return docs.select("path", "file_type", "doc_index")


@query(
    f"""
WITH {_FILES}, sized AS (
  SELECT *, octet_length(encode(text)) > 2000 AS large FROM files
)
SELECT CASE WHEN file_type = '.log' THEN 'unsupported' WHEN large THEN 'too large' ELSE 'document' END AS outcome,
       file_type, CAST(count(*) AS BIGINT) AS files
FROM sized GROUP BY ALL
"""
)
def append_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every new file is a document or an error, with a limit that many pass."""
    none = table(spark, sf_dir, "documents").where("false")
    existing = ingest.number(ingest.documents(none.select(F.lit("").alias("path"), F.lit(b"").alias("content"))))
    docs, errors = ingest.append_files(existing, render.text_files(spark, sf_dir), max_bytes=2000)
    reason = F.when(F.col("message").contains("too large"), "too large").otherwise("unsupported")
    outcomes = docs.select(F.lit("document").alias("outcome"), "file_type").unionByName(
        errors.select(reason.alias("outcome"), tx.extension(F.col("filename")).alias("file_type"))
    )
    return outcomes.groupBy("outcome", "file_type").agg(F.count(F.lit(1)).alias("files"))


@query(
    f"""
WITH {_FILES}
SELECT file_type,
       CASE file_type WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown'
                      ELSE 'unsupported' END AS parser,
       CAST(count(*) AS BIGINT) AS files
FROM files GROUP BY ALL
"""
)
def route_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = ingest.route(render.text_files(spark, sf_dir))
    return routed.groupBy(
        "file_type", F.coalesce("parser", F.lit("unsupported")).alias("parser")
    ).agg(F.count(F.lit(1)).alias("files"))


@query(
    rf"""
WITH paragraphs AS (
  SELECT doc_id, 0 AS k, text AS body FROM documents
  UNION ALL SELECT doc_id, 1, source || chr(10) || 'second line' FROM documents
  UNION ALL SELECT doc_id, 2, lang FROM documents
), stripped AS (
  SELECT doc_id, k, regexp_replace(regexp_replace(body, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS content
  FROM paragraphs
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS block_index,
       'paragraph' AS block_type, content
FROM stripped WHERE content <> ''
"""
)
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, then two more paragraphs with blanks around them."""
    docs = render.text_documents(spark, sf_dir).withColumn(
        "content",
        F.concat(
            "content", F.lit("\n\n\t \n\n  "), "source", F.lit("\nsecond line \n\n\n"), "lang"
        ),
    )
    return plaintext.blocks(docs).select(
        F.col("document_id").cast("long").alias("doc_id"),
        F.col("block_index").cast("long").alias("block_index"),
        "block_type",
        "content",
    )


_MARKDOWN = """
pages AS (
  SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey
), blocks AS (
  SELECT c_custkey, 0 AS block_index, 'header' AS block_type, r_name AS content,
         '1' AS level, NULL AS language FROM pages
  UNION ALL SELECT c_custkey, 1, 'header', n_name, '2', NULL FROM pages
  UNION ALL SELECT c_custkey, 2, 'paragraph',
                   c_name || chr(10) || '#segment ' || c_mktsegment, NULL, NULL FROM pages
  UNION ALL SELECT c_custkey, 3, 'code', '# balance' || chr(10) || chr(10) || c_acctbal, NULL,
                   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'sql' END FROM pages
  UNION ALL SELECT c_custkey, 4, 'paragraph', 'end of page', NULL, NULL FROM pages
            WHERE c_mktsegment <> 'BUILDING'
)
"""


def _markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = markdown.blocks(render.customer_markdown(spark, sf_dir))
    return blocks.select(
        F.col("document_id").cast("long").alias("c_custkey"),
        F.col("block_index").cast("long").alias("block_index"),
        "block_type",
        "content",
        F.col("metadata")["level"].alias("level"),
        F.col("metadata")["language"].alias("language"),
    )


@query(
    f"""
WITH {_MARKDOWN}
SELECT c_custkey, CAST(block_index AS BIGINT) AS block_index, block_type, content, level, language
FROM blocks
"""
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown_blocks(spark, sf_dir)


@query(
    """
SELECT '1' AS level, r_name AS content, CAST(count(*) AS BIGINT) AS documents
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
UNION ALL
SELECT '2', n_name, CAST(count(*) AS BIGINT)
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
"""
)
def markdown_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = _markdown_blocks(spark, sf_dir).filter("block_type = 'header'")
    return headers.groupBy("level", "content").agg(F.count(F.lit(1)).alias("documents"))


@query(
    """
SELECT p_partkey, CAST(0 AS BIGINT) AS block_index, 'header' AS block_type,
       'unit,name,brand' AS content, CAST(NULL AS VARCHAR) AS row_index FROM part
UNION ALL
SELECT p_partkey, i, 'row',
       i || ',' || replace(p_name, ' ', ', "') || '",' || replace(p_brand, '#', chr(10)),
       CAST(i - 1 AS VARCHAR)
FROM part, unnest(range(1, p_size + 1)) AS t(i)
"""
)
def csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = csv_documents.blocks(render.part_csv(spark, sf_dir))
    return blocks.select(
        F.col("document_id").cast("long").alias("p_partkey"),
        F.col("block_index").cast("long").alias("block_index"),
        "block_type",
        "content",
        F.col("metadata")["row_index"].alias("row_index"),
    )


@query(
    """
SELECT p_partkey, CAST(p_size AS BIGINT) AS row_count, CAST(3 AS BIGINT) AS column_count,
       '["unit","name","brand"]' AS columns
FROM part
"""
)
def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.part_csv(spark, sf_dir).withColumn(
        "m", csv_documents.metadata(F.col("content"))
    )
    return docs.select(
        F.col("document_id").cast("long").alias("p_partkey"),
        F.col("m")["row_count"].cast("long").alias("row_count"),
        F.col("m")["column_count"].cast("long").alias("column_count"),
        F.col("m")["columns"].alias("columns"),
    )


@query(
    rf"""
SELECT conv_id, turn + 1 AS page, 'paragraph' AS block_type,
       regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS content
FROM conversations WHERE regexp_matches(text, '[^{_SPACE[1:]}')
"""
)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = paged.page_blocks(render.conversation_pages(spark, sf_dir))
    return blocks.select(
        F.col("document_id").cast("long").alias("conv_id"),
        F.col("metadata")["page"].cast("long").alias("page"),
        "block_type",
        "content",
    )


@query(
    """
SELECT conv_id, CAST(count(*) AS BIGINT) AS page_count,
       CAST(length(string_agg(text, chr(10) || chr(10))) AS BIGINT) AS char_count
FROM conversations GROUP BY conv_id
"""
)
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = paged.paged_documents(render.conversation_pages(spark, sf_dir))
    return docs.select(
        F.col("document_id").cast("long").alias("conv_id"), "page_count", "char_count"
    )


@query(
    """
SELECT conv_id, CAST(0 AS BIGINT) AS part_no,
       string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content
FROM conversations GROUP BY conv_id
"""
)
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = paged.page_contents(render.conversation_pages(spark, sf_dir))
    return parts.select(
        F.col("document_id").cast("long").alias("conv_id"), "part_no", "content"
    )


@query(
    """
SELECT doc_id + 1 AS doc_index, '.txt' AS file_type, CAST(length(text) AS BIGINT) AS chars,
       'doc_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS filename
FROM documents
"""
)
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.list_documents(render.text_documents(spark, sf_dir))


@query(
    """
SELECT doc_id + 1 AS doc_index, left(text, 3000) AS content,
       CAST(greatest(length(text) - 3000, 0) AS BIGINT) AS remaining_chars
FROM documents
"""
)
def read_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, asked for by file name."""
    references = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias(
            "reference"
        )
    )
    return ingest.read_documents(
        render.text_documents(spark, sf_dir), references, max_chars=3000
    ).select("doc_index", "content", "remaining_chars")


@query(
    """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice
FROM part
"""
)
def csv_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV and read back with inferred types."""
    path = scratch_path(spark, "parts-csv")
    table(spark, sf_dir, "part").write.option("header", True).csv(path)
    found = read_csv_table(spark, path)
    return found.select(
        F.col("p_partkey").cast("long").alias("p_partkey"),
        "p_name",
        "p_brand",
        "p_type",
        F.col("p_size").cast("long").alias("p_size"),
        "p_retailprice",
    )


def _stamped_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """User code of the kind a parser may run: a block per line of a log."""
    for batch in batches:
        for document_id, content in zip(batch["document_id"], batch["content"]):
            rows = content.split("\n")
            yield pd.DataFrame(
                {
                    "document_id": document_id,
                    "block_index": range(len(rows)),
                    "block_type": "entry",
                    "content": rows,
                    "metadata": [{} for _ in rows],
                }
            )


@query(
    f"""
WITH {_FILES}
SELECT file_type, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents,
       CAST(sum(CASE file_type WHEN '.log' THEN len(string_split(text, chr(10))) ELSE 1 END) AS BIGINT)
         AS blocks
FROM files GROUP BY file_type
"""
)
def custom_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own parser for log files, next to the built-in ones."""
    registry = ingest.default_registry()

    def blocks(docs: DataFrame) -> DataFrame:
        return docs.select("document_id", "content").mapInPandas(_stamped_lines, BLOCKS)

    def metadata(content: Column) -> Column:
        return F.create_map(F.lit("char_count"), F.length(content).cast("string"))

    registry.register([".log"], Parser("log", blocks, metadata))
    docs = materialise(ingest.documents(render.text_files(spark, sf_dir), registry), "docs")
    counts = ingest.blocks(docs, registry).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        docs.select("document_id", "file_type")
        .join(counts, "document_id")
        .groupBy("file_type")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("blocks"))
    )
