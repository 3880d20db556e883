"""An index for regex search: which documents hold which short runs of characters.

The index is two tables below a folder. ``texts`` has the documents in blocks
(a partition column), neighbouring paths together; ``grams`` lists the documents of
each run of GRAM printable ASCII characters and each ASCII sign. Every task lists
those of its own documents, sorted by run, so that nothing is shuffled for it and
looking one up reads a few pages of each file. A search takes the
runs that every match of its pattern must hold, finds the documents that have
them all, reads the blocks of those only and verifies each line. A pattern
without such runs is searched for in all blocks; the rows are the same.

Cases are folded as the search does: the few letters outside ASCII that match
an ASCII letter are replaced by it. Texts of any length are read in pieces that
overlap. Null texts have no lines; repeated documents stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import search
from quillframe.session import materialise

#: Characters in a run.
GRAM = 3
#: Characters of text in a block, which is read or left out as a whole.
BLOCK_CHARS = 1 << 28
#: Smaller blocks than that are made up to this number, which grows no further.
SMALL_BLOCKS = 512
#: Bytes of a piece whose runs are listed at once.
PIECE = 1 << 20
#: Pairs of a run and a document that a task holds before it writes them.
HELD = 1 << 22

TEXTS = "path string, filename string, content string, doc long, block int"
GRAMS = "gram string, block int, docs array<long>"

# What matches an ASCII letter besides that letter, cases ignored.
_ALSO, _LETTERS = "İıſK", "iisk"
_SIGNS = r"[!-/:-@\[-`{-~]"


def _folds() -> np.ndarray:
    """For each byte of a text: itself in lower case, or 0 if no run holds it."""
    folds = np.zeros(256, np.uint8)
    folds[32:127] = list(bytes(range(32, 127)).lower())
    return folds


_FOLDS = _folds()
_IS_SIGN = np.array([re.fullmatch(_SIGNS, chr(i)) is not None for i in range(128)])


def _codes(text: np.ndarray) -> np.ndarray:
    """The distinct runs and signs in the bytes of a text, seven bits a character."""
    seen = np.zeros(1 << 7 * GRAM, bool) if len(text) > PIECE else None
    found = []
    for at in range(0, max(len(text), 1), PIECE):
        folded = _FOLDS[text[at : at + PIECE + GRAM - 1]]
        n = max(len(folded) - GRAM + 1, 0)
        code, whole = np.zeros(n, np.int32), np.ones(n, bool)
        for i in range(GRAM):
            code = code << 7 | folded[i : i + n]
            whole &= folded[i : i + n] > 0
        signs = folded[_IS_SIGN[folded]].astype(np.int32)
        found = np.concatenate([code[whole], signs])
        if seen is not None:
            seen[found] = True
    return np.unique(found) if seen is None else np.flatnonzero(seen)


def _gram(code: int) -> str:
    return "".join(chr(code >> 7 * i & 127) for i in reversed(range(GRAM))).lstrip("\0")


def _listed(block: int, docs: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
    """The documents of each run, as a batch of GRAMS."""
    pairs = np.concatenate([c.astype(np.int64) << 32 | i for i, c in enumerate(codes)])
    pairs.sort()
    found, first = np.unique(pairs >> 32, return_index=True)
    ids = np.array(docs, np.int64)[pairs & 0xFFFFFFFF]
    lists = pa.ListArray.from_arrays(np.append(first, len(pairs)).astype(np.int32), pa.array(ids))
    grams = pa.array([_gram(c) for c in found.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([grams, pa.array([block] * len(found), pa.int32()), lists], ["gram", "block", "docs"])


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc, text as bytes) to rows of GRAMS; a document is in one of the rows of a run."""
    block, docs, codes, held = None, [], [], 0
    for batch in batches:
        columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for here, doc, text in zip(*columns, strict=True):
            if docs and (here != block or held >= HELD):
                yield _listed(block, docs, codes)
                docs, codes, held = [], [], 0
            of_text = _codes(np.frombuffer(text.as_buffer(), np.uint8)) if text.is_valid else ()
            block = here
            if len(of_text):
                docs.append(doc)
                codes.append(of_text)
                held += len(of_text)
    if docs:
        yield _listed(block, docs, codes)


#: Parts of a class that are not looked into.
_ODD_CLASS = re.compile(r"\[\^?\]|\\[QE]")


def _class_end(pattern: str, at: int) -> int | None:
    """Behind the character class that starts at ``at``; None if it has a form
    that is not looked into."""
    depth = 0
    while at < len(pattern) and not _ODD_CLASS.match(pattern, at):
        depth += {"[": 1, "]": -1}.get(pattern[at], 0)
        at += 2 if pattern[at] == "\\" else 1
        if depth == 0:
            return at
    return None


#: Escapes of one letter that stand for a class, a place or a control character.
_ESCAPES = set("dDwWsSbBAzZGhHvVRtnrfae")


def required_texts(pattern: str) -> list[list[str]] | None:
    """For each alternative of a pattern, texts in lower case that its matches hold.

    Only plain characters outside groups and classes count. None: the pattern has
    inline flags or escapes that are not looked into, so anything may match.
    """
    at = depth = 0
    run, runs, found = "", [], []
    while at < len(pattern):
        c, taken = pattern[at], None
        step = 1
        if c == "\\":
            escaped, step = pattern[at + 1 : at + 2], 2
            if not escaped or (escaped.isalnum() and escaped not in _ESCAPES):
                return None
            taken = None if escaped in _ESCAPES else escaped
        elif c == "[":
            end = _class_end(pattern, at)
            if end is None:
                return None
            step = end - at
        elif c == "(":
            if re.match(r"\(\?(?![:=!>]|<)", pattern[at:]):
                return None
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif c in "*+?{":
            quantifier = re.match(r"[*+?]|\{\d+(?:,\d*)?\}", pattern[at:])
            if quantifier is None:
                return None
            step = quantifier.end()
            if re.match(r"[*?]|\{0+[,}]", quantifier[0]):
                run = run[:-1]
        elif c not in ".^$|":
            taken = c
        if depth == 0 and taken is not None and " " <= taken <= "~":
            run += taken.lower()
        else:
            runs, run = [*runs, *([run] if run else [])], ""
        if c == "|" and depth == 0:
            found, runs = [*found, runs], []
        at += step
    return [*found, [*runs, *([run] if run else [])]]


def required_grams(pattern: str) -> list[list[str]] | None:
    """For each alternative, the runs to look up; None if one has none."""
    alternatives = required_texts(pattern)
    if alternatives is None:
        return None
    found = [
        sorted({t[i : i + GRAM] for t in texts for i in range(len(t) - GRAM + 1)} | set(re.findall(_SIGNS, "".join(texts))))
        for texts in alternatives
    ]
    return found if all(found) else None


@dataclass
class SearchIndex:
    """A stored index. The tables are read by whatever needs them."""

    spark: SparkSession
    folder: str

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.folder}/texts")

    @property
    def grams(self) -> DataFrame:
        """(gram, block, doc), each once."""
        listed = self.spark.read.schema(GRAMS).parquet(f"{self.folder}/grams")
        return listed.select("gram", "block", F.explode("docs").alias("doc"))

    def candidates(self, pattern: str) -> DataFrame | None:
        """(block, doc) of the documents that have all runs of an alternative of the
        pattern; None if the pattern has no runs to look up."""
        alternatives = required_grams(pattern)
        if alternatives is None:
            return None
        wanted = sorted({g for grams in alternatives for g in grams})
        has = self.grams.where(F.col("gram").isin(wanted)).groupBy("block", "doc").agg(
            *[F.count_if(F.col("gram").isin(grams)).alias(f"_has{i}") for i, grams in enumerate(alternatives)]
        )
        fits = reduce(or_, [F.col(f"_has{i}") == len(grams) for i, grams in enumerate(alternatives)])
        # stored, so that Spark knows the size; the condition, said once more, tells it
        # that few may be left: then they are sent to the scan, which skips other blocks
        return materialise(has.where(fits), "candidates").where(fits).select("block", "doc")

    def documents(self, pattern: str) -> DataFrame:
        """The documents that may match, as (path, filename, content)."""
        found = self.candidates(pattern)
        texts = self.texts
        if found is not None:
            texts = texts.join(found, ["block", "doc"], "left_semi")
        return texts.select("path", "filename", "content")

    def matching_lines(self, pattern: str) -> DataFrame:
        """The rows of :func:`quillframe.operators.search.matching_lines`."""
        return search.matching_lines(self.documents(pattern), pattern)


def build_index(documents: DataFrame, folder: str, block_chars: int = BLOCK_CHARS) -> SearchIndex:
    """Index documents given as (path, filename, content) below a new folder."""
    spark = documents.sparkSession
    chars = documents.agg(F.sum(F.length("content").cast("long"))).first()[0] or 0
    # tasks, folders and listings cost by the block: many blocks are large ones
    blocks = max(1, min(-(-chars // block_chars), SMALL_BLOCKS), -(-chars // max(block_chars, BLOCK_CHARS)))
    # neighbouring paths share a block; a path that repeats is split by its texts
    placed = documents.select("path", "filename", "content").repartitionByRange(
        blocks, "path", F.xxhash64("content")
    )
    texts = placed.withColumns({"block": F.spark_partition_id(), "doc": F.monotonically_increasing_id()})
    texts.write.partitionBy("block").parquet(f"{folder}/texts")
    index = SearchIndex(spark, folder)
    folded = F.translate("content", _ALSO, _LETTERS).cast("binary")
    listed = index.texts.select("block", "doc", folded.alias("text")).mapInArrow(_list_grams, GRAMS)
    listed.sortWithinPartitions("gram", "block").write.parquet(f"{folder}/grams")
    return index
