"""Text and Markdown documents of any size: parts and blocks from file splits.

A document that is larger than a row is never put together. Its lines are read
in splits like any other large input, and every split tells in one row how many
fences and cuts it has; a prefix over these rows carries the open fence and the
number of the open paragraph into the next split. A block is then the lines with
one number, whichever splits they come from, and equals the block that
:mod:`quillframe.sources.plaintext` and :mod:`quillframe.sources.markdown` make of
the whole text. Only a single block has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import METADATA
from quillframe.operators.ordered import row_numbers
from quillframe.session import materialise
from quillframe.sources import markdown
from quillframe.sources.listing import file_path

LINES = {"recursiveFileLookup": "true", "lineSep": "\n"}
BOM_BYTES = 3
#: Text bytes of a part, about; a longer line is a part alone.
PART_BYTES = 4 << 20


def _lines(
    spark: SparkSession, folder: str, pattern: str | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """``path, block, size, row, bytes, valid, line`` of the files below a folder."""
    reader = spark.read.options(**LINES)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(folder).select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.is_valid_utf8("value").alias("valid"),
        F.col("value").alias("line"),
    )
    return rows if paths is None else rows.join(paths.select("path"), "path", "left_semi")


def _upto() -> Window:
    here = Window.partitionBy("path", "block").orderBy("row")
    return here.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _done() -> Window:
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _before(total: str) -> Column:
    """Sum over the splits of the file before this one."""
    return F.coalesce(F.sum(total).over(_done()), F.lit(0))


def _at_split(rows: DataFrame, splits: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their split; there is one row for each split."""
    side = splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), *columns)
    return rows.join(side, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block"))).drop("_path", "_block")


def _ended() -> Column:
    """Whether a file's last line has its line feed: values come without them."""
    return (F.sum("bytes").over(Window.partitionBy("path")) - F.col("size")).isin(0, -BOM_BYTES)


def document_id(path: Column) -> Column:
    return F.sha2(path, 256)


def parts(
    spark: SparkSession,
    folder: str,
    pattern: str | None = None,
    part_bytes: int = PART_BYTES,
    paths: DataFrame | None = None,
) -> DataFrame:
    """``document_id, path, part, offset, content``: the text of every file in parts
    of about ``part_bytes``, cut at line ends, in order from part 0.

    ``offset`` counts bytes; the parts put together are the text of the file.
    """
    rows = _lines(spark, folder, pattern, paths)
    at = F.sum("bytes").over(_upto()) - F.col("bytes")
    # numbers of parts are dense within a split: a long line skips some
    rows = rows.withColumns({"at": at, "piece": F.floor(at / part_bytes)})
    pieces = rows.groupBy("path", "block", "piece").agg(
        F.sum("bytes").alias("bytes"),
        F.min("at").alias("at"),
        F.max("size").alias("size"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n"
        ).alias("content"),
    )
    pieces = materialise(pieces, "document-parts")
    splits = pieces.groupBy("path", "block").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("size"), F.max("piece").alias("last_piece")
    )
    splits = splits.withColumns({"start": _before("bytes"), "first": _before("n"), "ended": _ended()})
    last = F.col("block") == F.max("block").over(Window.partitionBy("path"))
    splits = splits.withColumn("open_piece", F.when(last & ~F.col("ended"), F.col("last_piece")))
    placed = _at_split(pieces, splits, "start", "first", "open_piece")
    number = F.row_number().over(Window.partitionBy("path", "block").orderBy("piece")) - 1
    line_feed = F.when(F.col("piece").eqNullSafe(F.col("open_piece")), "").otherwise("\n")
    return placed.select(
        document_id(F.col("path")).alias("document_id"),
        "path",
        (F.col("first") + number).alias("part"),
        (F.col("start") + F.col("at")).alias("offset"),
        F.concat("content", line_feed).alias("content"),
    )


def invalid_files(
    spark: SparkSession, folder: str, pattern: str | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """``path`` of files that are not UTF-8: a character never spans lines."""
    bad = _lines(spark, folder, pattern, paths).where(~F.col("valid"))
    return bad.select("path").distinct()


def _stretches(rows: DataFrame, fence: Column, cut: Column) -> DataFrame:
    """``path, row, line, kind, stretch``: the stretch between cuts that a line is in.

    A cut line opens the stretch after it. A ``cut`` inside fences is a line like
    any other; a ``fence`` always cuts. ``kind`` is fence, cut or line, and
    ``code`` says whether the stretch stands inside fences.
    """
    rows = rows.withColumns({"fence": fence, "cut": cut})
    rows = rows.withColumn("fences", F.sum(F.col("fence").cast("long")).over(_upto()))
    # behind a closing fence or inside one, if the split starts outside or inside
    for s in (0, 1):
        outside = F.pmod(F.col("fences") - F.col("fence").cast("long") + s, F.lit(2)) == 0
        rows = rows.withColumn(f"cuts{s}", F.col("fence") | (outside & F.col("cut")))
        rows = rows.withColumn(f"upto{s}", F.sum(F.col(f"cuts{s}").cast("long")).over(_upto()))
    rows = materialise(rows.drop("cut"), "document-lines")
    splits = rows.groupBy("path", "block").agg(
        *(F.max(c).alias(c) for c in ("fences", "upto0", "upto1", "size")),
        F.sum("bytes").alias("bytes"),
        F.max("row").alias("last_row"),
    )
    splits = splits.withColumns({"start": F.pmod(_before("fences"), F.lit(2)), "ended": _ended()})
    own = F.when(F.col("start") == 0, F.col("upto0")).otherwise(F.col("upto1"))
    last = F.col("block") == F.max("block").over(Window.partitionBy("path"))
    splits = splits.withColumn("own", own).withColumns(
        {"earlier": _before("own"), "end_row": F.when(last & F.col("ended"), F.col("last_row"))}
    )
    placed = _at_split(rows, splits, "start", "earlier", "end_row")
    by_start = lambda name: F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    inside = F.pmod(F.col("start") + F.col("fences"), F.lit(2)) == 1
    return placed.select(
        "path",
        "row",
        "line",
        F.when(F.col("fence"), "fence").when(by_start("cuts"), "cut").otherwise("line").alias("kind"),
        inside.alias("code"),
        (F.col("earlier") + by_start("upto")).alias("stretch"),
        F.col("row").eqNullSafe(F.col("end_row")).alias("ends"),
    )


def _gathered(placed: DataFrame) -> DataFrame:
    """One row per stretch: its opening line and the text of its other lines."""
    body = F.when(F.col("kind") == "line", F.struct("row", "line"))
    return placed.groupBy("path", "stretch").agg(
        F.max(F.when(F.col("kind") != "line", F.col("line"))).alias("opener"),
        F.max("code").alias("code"),
        F.max("ends").alias("ends"),
        F.count(body).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("body"),
    )


def _numbered(found: DataFrame) -> DataFrame:
    """Blocks with their place in the document."""
    rows = row_numbers(found, ["path"], ["stretch", "place"], "n")
    return rows.select(
        document_id(F.col("path")).alias("document_id"),
        (F.col("n") - 1).cast("int").alias("block_index"),
        "block_type",
        "content",
        F.col("metadata").cast(METADATA).alias("metadata"),
    )


def text_blocks(
    spark: SparkSession, folder: str, pattern: str | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """The paragraph blocks of text files of any size."""
    placed = _stretches(_lines(spark, folder, pattern, paths), F.lit(False), F.col("line") == "")
    found = _gathered(placed).select("path", "stretch", F.lit(0).alias("place"), tx.strip(F.col("body")).alias("content"))
    found = found.where(F.col("content") != "").withColumns(
        {"block_type": F.lit("paragraph"), "metadata": F.create_map().cast(METADATA)}
    )
    return _numbered(found)


def markdown_blocks(
    spark: SparkSession, folder: str, pattern: str | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """The header, code and paragraph blocks of Markdown files of any size."""
    line = F.col("line")
    fence = F.startswith(tx.strip(line), F.lit(markdown.FENCE))
    placed = _stretches(_lines(spark, folder, pattern, paths), fence, line.rlike(markdown.HEADER) | tx.is_blank(line))
    none = F.lit(None).cast("string")
    block = lambda place, kind, content, level, language: F.struct(
        F.lit(place).alias("place"), F.lit(kind).alias("block_type"), content.alias("content"),
        level.cast("string").alias("level"), language.alias("language"),
    )
    opener, body = F.col("opener"), F.col("body")
    language = F.nullif(tx.strip(F.substr(tx.strip(opener), F.lit(len(markdown.FENCE) + 1))), F.lit(""))
    # a fence that stays open keeps the line feed at the end of its file
    code = F.concat(body, F.when(F.col("ends") & (F.col("n") > 0), "\n").otherwise(""))
    is_header = opener.isNotNull() & opener.rlike(markdown.HEADER)
    prose = F.array(
        F.when(
            is_header,
            block(0, "header", tx.strip(F.regexp_extract(opener, markdown._HEADER_PARTS, 2)),
                  F.length(F.regexp_extract(opener, markdown._HEADER_PARTS, 1)), none),
        ),
        F.when(body != "", block(1, "paragraph", body, none, none)),
    )
    made = F.when(F.col("code"), F.array(block(0, "code", code, none, language))).otherwise(prose)
    found = _gathered(placed).select("path", "stretch", F.explode(made).alias("b")).where("b IS NOT NULL")
    facts = F.create_map(F.lit("level"), F.col("b.level"), F.lit("language"), F.col("b.language"))
    return _numbered(
        found.select(
            "path", "stretch", "b.place", "b.block_type", "b.content",
            F.map_filter(facts, lambda _, v: v.isNotNull()).alias("metadata"),
        )
    )
