"""From files to documents, blocks and ingest errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.model import METADATA
from quillframe.operators.ordered import with_ordinals
from quillframe.session import materialise
from quillframe.sources import csv_documents, large_documents, markdown, paged, plaintext, split_csv
from quillframe.sources.listing import empty_files, read_files
from quillframe.sources.registry import SUPPORTED, UNSUPPORTED, Parser, ParserRegistry

#: Largest file that becomes one row by default: a Spark row ends at 2 GB, and
#: text, blocks and bytes need room in it. Larger files are searched by lines.
MAX_DOCUMENT_BYTES = 1 << 30
# Why a file gives no document.
FAILED_TO_PARSE = "Failed to parse '"
CORRUPT = "The file may be corrupt or not a valid file of its declared type."


def default_registry() -> ParserRegistry:
    registry = ParserRegistry()
    registry.register([".txt"], plaintext.PARSER)
    registry.register([".md"], markdown.PARSER)
    registry.register([".csv"], csv_documents.PARSER)
    return registry


def document_id(path: Column) -> Column:
    """A stable id: the same path has the same id in every run."""
    return F.sha2(path, 256)


def extension_filter(extensions: str | Sequence[str]) -> list[str]:
    """``"csv, .MD"`` -> ``[".csv", ".md"]``."""
    names = extensions.split(",") if isinstance(extensions, str) else extensions
    cleaned = [n.strip().lower() for n in names]
    return [n if n.startswith(".") else f".{n}" for n in cleaned if n]


def named(files: DataFrame) -> DataFrame:
    """Files with their base name and lower-case extension."""
    return files.withColumn("filename", tx.base_name(F.col("path"))).withColumn(
        "file_type", tx.extension(F.col("filename"))
    )


def route(files: DataFrame, registry: ParserRegistry | None = None) -> DataFrame:
    """Files with name, extension and parser; parser is null if unsupported."""
    registry = registry or default_registry()
    choice = F.lit(None).cast("string")
    for parser, extensions in registry.by_parser().items():
        choice = F.when(
            F.col("file_type").isin(extensions), F.lit(parser.name)
        ).otherwise(choice)
    return named(files).withColumn("parser", choice)


_PARSED = ("path", "filename", "file_type", "content", "metadata", "message")


def _failure(reason: Column) -> Column:
    """Null without a reason."""
    return F.concat(F.lit(FAILED_TO_PARSE), "filename", F.lit("': "), reason, F.lit(f". {CORRUPT}"))


def _read_as_text(files: DataFrame, registry: ParserRegistry) -> DataFrame:
    """All files that no page reader takes, in one pass: the parser is a choice
    between expressions. Unsupported files are told so, their bytes unread."""
    raw, kind = F.col("content"), F.col("file_type")
    own = {p: e for p, e in registry.by_parser().items() if not p.read_pages}
    known = [e for extensions in own.values() for e in extensions]
    pages = sorted(set(registry.extensions()) - set(known))
    text = F.when(kind.isin(known) & tx.is_utf8(raw), tx.decode_utf8(raw))
    read = named(files).filter(~kind.isin(pages)).select(
        "path", "filename", "file_type", text.alias("content")
    )
    content = F.col("content")
    reason, facts = F.lit("invalid UTF-8 text"), F.lit(None).cast(METADATA)
    if_text = F.lit(None).cast("string")
    for parser, extensions in own.items():
        taken = kind.isin(extensions) & content.isNotNull()
        facts = F.when(taken, parser.metadata(content).cast(METADATA)).otherwise(facts)
        if parser.failure:
            if_text = F.when(taken, parser.failure(content)).otherwise(if_text)
    unsupported = F.concat(
        F.lit(UNSUPPORTED), kind, F.lit(f"{SUPPORTED}{', '.join(registry.extensions())}")
    )
    message = F.when(~kind.isin(known), unsupported).otherwise(
        _failure(F.when(content.isNull(), reason).otherwise(if_text))
    )
    return read.withColumns({"metadata": facts, "message": message}).select(*_PARSED)


def _read_as_pages(files: DataFrame, parser: Parser, extensions: list[str]) -> DataFrame:
    """The files of one page reader, which runs in Python."""
    own = named(files).filter(F.col("file_type").isin(extensions))
    read = paged.page_arrays(own, parser.read_pages)
    pages = F.col("pages")
    return read.select(
        "path",
        "filename",
        "file_type",
        F.array_join(pages, paged.PAGE_BREAK).alias("content"),
        F.when(pages.isNotNull(), parser.metadata(pages)).cast(METADATA).alias("metadata"),
        _failure(F.col("reason")).alias("message"),
    )


def parse(files: DataFrame, registry: ParserRegistry | None = None) -> DataFrame:
    """Every file once, with its text and metadata or a message why not.

    ``files`` needs path and content (bytes). Parsers made of expressions share
    one pass over the files; each page reader, which needs Python workers, has
    one of its own over its extensions. If ``files`` is a table kept apart by
    the ``parser`` column of :func:`route`, each reads only its part.
    """
    registry = registry or default_registry()
    apart = "parser" in files.columns
    readers = {p: e for p, e in registry.by_parser().items() if p.read_pages}
    rest = files
    if apart and readers:
        names = [p.name for p in readers]
        rest = files.filter(F.col("parser").isNull() | ~F.col("parser").isin(names))
    parts = [_read_as_text(rest, registry)]
    for parser, extensions in readers.items():
        own = files.filter(F.col("parser") == parser.name) if apart else files
        parts.append(_read_as_pages(own, parser, extensions))
    return reduce(DataFrame.unionByName, parts)


def documents_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("message").isNull()).select(
        document_id(F.col("path")).alias("document_id"),
        "path",
        "filename",
        "file_type",
        "content",
        "metadata",
    )


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("message").isNotNull()).select("path", "filename", "message")


def documents(files: DataFrame, registry: ParserRegistry | None = None) -> DataFrame:
    """One row per file that parses."""
    return documents_of(parse(files, registry))


def ingest_errors(files: DataFrame, registry: ParserRegistry | None = None) -> DataFrame:
    """Files that give no document, with the reason."""
    return errors_of(parse(files, registry))


def blocks(docs: DataFrame, registry: ParserRegistry | None = None) -> DataFrame:
    """Blocks of all documents, each by the parser of its file type."""
    registry = registry or default_registry()
    parts = [
        parser.blocks(docs.filter(F.col("file_type").isin(extensions)))
        for parser, extensions in registry.by_parser().items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _any_case_glob(ext: str) -> str:
    """Glob for a file extension in upper, lower or mixed case."""
    return "*" + "".join(
        f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext
    )


def read_folder(
    spark: SparkSession,
    folder: str,
    extensions: str | Sequence[str] = "",
    registry: ParserRegistry | None = None,
    known: DataFrame | None = None,
    max_bytes: int | None = None,
    large: str = "errors",
) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a folder, documents numbered in path order.

    Files above ``max_bytes`` cannot be one row. With ``large="parts"`` those of a
    built-in parser are documents without content, marked in their metadata, whose
    blocks and parts :func:`all_blocks` and :mod:`quillframe.sources.large_documents` read
    in splits; otherwise, and for page readers, they are errors.

    The names are listed once; one scan, with a name filter, reads all supported
    files, and unsupported ones are never read. Files whose path is in ``known``
    are left out by their names before anything is opened.
    """
    registry = registry or default_registry()
    allowed = extension_filter(extensions)
    chosen = [e for e in registry.extensions() if not allowed or e in allowed]
    empty = materialise(empty_files(spark, folder), "empty-files")
    listed = named(read_files(spark, folder, empty=False).select("path").unionByName(empty.select("path")))
    if allowed:
        listed = listed.filter(F.col("file_type").isin(allowed))
    if known is not None:
        listed = listed.join(known.select("path"), "path", "left_anti")
    listed = materialise(listed, "listed")
    parts = [_read_as_text(no_content(listed.filter(~F.col("file_type").isin(chosen))), registry)]
    if chosen:
        glob = f"{{{','.join(map(_any_case_glob, chosen))}}}"
        files = read_files(spark, folder, glob, empty=False).unionByName(
            named(empty).filter(F.col("file_type").isin(chosen)).select(*empty.columns)
        )
        if known is not None:
            files = files.join(listed.select("path"), "path", "left_semi")
        parts.append(parse(fitting(files, max_bytes), registry))
        split = [e for e in chosen if large == "parts" and registry.get(e) in SPLIT_BLOCKS]
        parts.append(too_large(files, [e for e in chosen if e not in split], max_bytes))
        if split:
            parts.append(_in_parts(spark, folder, files, split, max_bytes))
    # stored before it is split up and numbered: no file is opened again
    parsed = materialise(reduce(DataFrame.unionByName, parts), "parsed")
    return number(documents_of(parsed)), errors_of(parsed)


def no_content(listed: DataFrame) -> DataFrame:
    return listed.select("path", F.lit(None).cast("binary").alias("content"))


def number(docs: DataFrame) -> DataFrame:
    """Documents with their position in path order.

    Positions are found on paths alone; the texts then meet them by path, which
    a small table of positions does without moving texts at all.
    """
    places = with_ordinals(docs.select(F.col("path").alias("_path")), ["_path"])
    return docs.join(places, F.col("path") == F.col("_path")).drop("_path")


def fitting(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that fit into one cell. The condition reaches the file source,
    which then does not open the others."""
    return files.filter(F.col("length") <= (max_bytes or MAX_DOCUMENT_BYTES))


def too_large(
    files: DataFrame, extensions: list[str], max_bytes: int | None = None
) -> DataFrame:
    """Files that cannot be one row; their lines can still be read with
    :mod:`quillframe.sources.large_text`."""
    return (
        named(files.select("path", "length"))
        .filter((F.col("length") > (max_bytes or MAX_DOCUMENT_BYTES)) & F.col("file_type").isin(extensions))
        .select(
            "path",
            "filename",
            "file_type",
            F.lit(None).cast("string").alias("content"),
            F.lit(None).cast(METADATA).alias("metadata"),
            F.concat(
                F.lit(FAILED_TO_PARSE),
                "filename",
                F.lit("': "),
                tx.size_label(F.col("length")),
                F.lit(" is too large for one document. Read it by lines."),
            ).alias("message"),
        )
    )


#: Metadata of a document whose content is read in splits.
IN_PARTS = "in_parts"
#: Blocks of large files by the parser of their type.
SPLIT_BLOCKS = {
    plaintext.PARSER: large_documents.text_blocks,
    markdown.PARSER: large_documents.markdown_blocks,
    csv_documents.PARSER: lambda spark, folder, pattern, paths: split_csv.blocks(spark, folder, paths),
}


def _in_parts(
    spark: SparkSession, folder: str, files: DataFrame, extensions: list[str], max_bytes: int | None
) -> DataFrame:
    """Large files as documents without content; a scan of their lines tells those
    that are not UTF-8."""
    found = named(files.select("path", "length")).filter(
        (F.col("length") > (max_bytes or MAX_DOCUMENT_BYTES)) & F.col("file_type").isin(extensions)
    )
    found = materialise(found, "large-files")
    bad = large_documents.invalid_files(spark, folder, paths=found).withColumn("bad", F.lit(True))
    facts = F.create_map(F.lit(IN_PARTS), F.lit("true"), F.lit("size_bytes"), F.col("length").cast("string"))
    return found.join(bad, "path", "left").select(
        "path",
        "filename",
        "file_type",
        F.lit(None).cast("string").alias("content"),
        facts.cast(METADATA).alias("metadata"),
        F.when(F.col("bad"), _failure(F.lit("invalid UTF-8 text"))).alias("message"),
    )


def all_blocks(
    spark: SparkSession, folder: str, docs: DataFrame, registry: ParserRegistry | None = None
) -> DataFrame:
    """:func:`blocks` of all documents of a folder, those in parts included."""
    registry = registry or default_registry()
    in_parts = F.coalesce(F.element_at("metadata", IN_PARTS) == "true", F.lit(False))
    found = blocks(docs.filter(~in_parts), registry)
    for parser, extensions in registry.by_parser().items():
        if parser in SPLIT_BLOCKS:
            paths = docs.filter(in_parts & F.col("file_type").isin(extensions)).select("path")
            glob = f"{{{','.join(map(_any_case_glob, extensions))}}}"
            if not paths.isEmpty():
                found = found.unionByName(SPLIT_BLOCKS[parser](spark, folder, glob, paths))
    return found


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path is not among the documents already ingested.

    A second run over the same folder therefore adds nothing. Only paths are
    compared; contents meet the paths that are new, which usually are few.
    """
    fresh = materialise(
        files.select("path").join(known.select("path"), "path", "left_anti").distinct(), "new-files"
    )
    return files.join(fresh, "path", "left_semi")


def append_files(
    existing: DataFrame,
    files: DataFrame,
    registry: ParserRegistry | None = None,
    max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): existing documents plus those of the files not seen
    before, numbered on, and why the other new files gave none."""
    registry = registry or default_registry()
    new = new_files(files, existing)
    if "length" in files.columns:
        known = registry.extensions()
        found = parse(fitting(new, max_bytes), registry).unionByName(too_large(new, known, max_bytes))
        other = named(new.select("path", "length")).filter(
            (F.col("length") > (max_bytes or MAX_DOCUMENT_BYTES)) & ~F.col("file_type").isin(known)
        )
        found = found.unionByName(_read_as_text(no_content(other), registry))
    else:
        found = parse(new, registry)
    parsed = materialise(found, "parsed")
    docs = existing.unionByName(numbered_after(existing, number(documents_of(parsed))))
    return docs, errors_of(parsed)


def append_documents(
    existing: DataFrame, files: DataFrame, registry: ParserRegistry | None = None
) -> DataFrame:
    """The documents of :func:`append_files`, for callers who know of the errors."""
    return append_files(existing, files, registry)[0]


def numbered_after(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    last = existing.agg(F.max("doc_index")).first()[0] or 0  # a single number
    return fresh.withColumn("doc_index", F.col("doc_index") + F.lit(last))


def list_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_index",
        "filename",
        "file_type",
        F.length("content").cast("long").alias("chars"),
    )


def _excerpt(found: DataFrame, max_chars: int) -> DataFrame:
    return found.select(
        "doc_index",
        "filename",
        "file_type",
        F.substring("content", 1, max_chars).alias("content"),
        F.greatest(F.length("content") - max_chars, F.lit(0))
        .cast("long")
        .alias("remaining_chars"),
    )


def read_document(docs: DataFrame, reference: str, max_chars: int = 3000) -> DataFrame:
    """One document by 1-based position, else by file name (first match).

    Gives its first characters and how many are left.
    """
    found = docs.filter(F.col("filename") == reference)
    try:
        position = int(reference)
    except ValueError:
        pass
    else:
        at = docs.filter(F.col("doc_index") == position)
        found = found if at.isEmpty() else at
    return _excerpt(found.orderBy("doc_index").limit(1), max_chars)


def read_documents(docs: DataFrame, references: DataFrame, max_chars: int = 3000) -> DataFrame:
    """The documents named in a table of references, in one join.

    Where several documents have the name, it means the first of them; that
    choice is made on positions only, before any content moves.
    """
    named = docs.select("filename", "doc_index").join(
        references.select(F.col("reference").alias("filename")).distinct(),
        "filename",
        "left_semi",
    )
    first = named.groupBy("filename").agg(F.min("doc_index").alias("doc_index"))
    return _excerpt(docs.join(first.select("doc_index"), "doc_index", "left_semi"), max_chars)
