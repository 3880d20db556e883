"""Benchmark decontamination by word n-grams.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lowering A-Z. Every
run of 13 words of a benchmark item is a window; an item of fewer words is one
window. Documents are scanned with the hashes of their own word runs against
the benchmark's hashes; each hit is compared word by word before it counts.

A benchmark of at most ``BLOCK_BYTES`` of text is one broadcast. A larger one
never passes through the driver or a worker as a whole:

1. Tasks cut its items into windows, a stored table of hash, words and item.
2. Its distinct hashes are broadcast in sorted blocks of ``HASHES`` at most, one
   after another; each pass over the documents keeps the hashes that occur.
3. Windows with such a hash are broadcast with their words in blocks of
   ``BLOCK_WINDOWS``, again one for each pass; its hits are stored by text. The
   hits of all passes are put together for each text and joined to the documents.

Cases: a null or empty text has no words and is never hit; a benchmark item
without words or without an id has no window; repeated items count once;
repeated documents are each judged. An empty benchmark hits nothing, an empty
table gives an empty result. Other columns of the documents stay as they are.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import Words, byte_class, covered, private, query, steps, table
from quillframe.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: After lowering A-Z, every byte of a character beyond ASCII belongs to a word.
IS_WORD = byte_class(WORD)
WINDOW = 13
#: Text of a benchmark that is one broadcast, windows with their words in one
#: broadcast of a larger one (about as much), and hashes in one. All set memory
#: only: a worker holds one broadcast, some 300 MB at most.
BLOCK_BYTES = 4 << 20
BLOCK_WINDOWS = 700_000
HASHES = 8_000_000
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20

SPANS = "n_words long, spans array<struct<start:int,end:int,first:int,last:int>>, items array<string>"
FILTER_BITS = 16


class Windows:
    """Windows, given as (words in it, hash, words, item): hashes by length, and
    the items of each window."""

    def __init__(self, windows: Iterable[tuple[int, int, bytes, str]]):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        hashes: dict[int, set[int]] = defaultdict(set)
        for n, code, words, item in windows:
            hashes[n].add(code)
            self.items[words].add(item)
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in hashes.items()}
        self.filters = {n: prefixes(h) for n, h in self.hashes.items()}

    def find(self, found: Words) -> list[tuple[int, int, set[str]]]:
        """(first word, length, items) of every occurrence of a window."""
        hits = []
        for n, known in self.hashes.items():
            at, codes = found.grams(n)
            for i in at[among(codes, known, self.filters[n])].tolist():
                if items := self.items.get(joined(found, i, n)):
                    hits.append((i, n, items))
        return hits


def prefixes(hashes: np.ndarray) -> np.ndarray:
    """Which upper bits any of the hashes has."""
    known = np.zeros(1 << FILTER_BITS, bool)
    known[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return known


def among(codes: np.ndarray, known: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Places of the codes that are among the sorted hashes ``known``."""
    near = np.flatnonzero(upper[codes >> np.uint64(64 - FILTER_BITS)])
    place = np.minimum(np.searchsorted(known, codes[near]), len(known) - 1)
    return near[known[place] == codes[near]]


def windows_of(item: str, text: str, window: int) -> Iterator[tuple[int, int, bytes, str]]:
    """The windows of an item as ``Windows`` takes them."""
    found = Words([text.encode()], IS_WORD)
    if n := min(window, len(found.starts)):
        at, codes = found.grams(n)
        for i, code in zip(at.tolist(), codes.tolist(), strict=True):
            yield n, code, joined(found, i, n), item


def joined(found: Words, i: int, n: int) -> bytes:
    ends = zip(found.starts[i : i + n].tolist(), found.ends[i : i + n].tolist(), strict=True)
    return b" ".join(found.lower[s:e] for s, e in ends)


def scan(found: Words, windows: Windows) -> list[dict]:
    """For each text its words, the runs of hit words and the items found."""
    hits = windows.find(found)
    starts = np.array([i for i, _, _ in hits], np.int64)
    ends = starts + np.array([n for _, n, _ in hits], np.int64)
    hit = covered(starts, ends, len(found.starts)) if hits else np.zeros(len(found.starts), bool)
    items: dict[int, set[str]] = defaultdict(set)
    for i, _, names in hits:
        items[int(found.doc[i])] |= names
    out = []
    for d in range(len(found.offsets) - 1):
        first, last, base = int(found.first[d]), int(found.first[d + 1]), int(found.offsets[d])
        spans = []
        if d in items:
            edges = np.flatnonzero(np.diff(hit[first:last].view(np.int8), prepend=0, append=0))
            for a, b in edges.reshape(-1, 2).tolist():
                start, end = found.starts[first + a] - base, found.ends[first + b - 1] - base
                spans.append({"start": int(start), "end": int(end), "first": a, "last": b})
        out.append({"n_words": last - first, "spans": spans, "items": sorted(items.get(d, ()))})
    return out


HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "first", "last")]))),
        ("items", pa.list_(pa.string())),
    ]
)


def hits_of(text: Column, block: Broadcast) -> Column:
    """A struct for a text: n_words, the byte spans and word runs that windows of
    the block hit, and the ids of the items found."""

    @F.arrow_udf(SPANS)
    def look(texts: pa.Array) -> pa.Array:
        rows = [row for run in steps(texts) for row in scan(Words(run, IS_WORD), block.value)]
        return pa.array(rows, HITS)

    return look.asNondeterministic()(text)


def united(spans: list[dict]) -> list[dict]:
    """Runs of hit words of several passes as the runs that their union has."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and span["first"] <= out[-1]["last"]:
            if span["last"] > out[-1]["last"]:
                out[-1] |= {"end": span["end"], "last": span["last"]}
        else:
            out.append(dict(span))
    return out


def hits_together(text: Column, spans: Column, items: Column) -> Column:
    """The struct of ``hits_of`` from the spans and items of all passes."""

    @F.arrow_udf(SPANS)
    def unite(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        sizes = [n for run in steps(texts) for n in np.diff(Words(run, IS_WORD).first).tolist()]
        rows = zip(sizes, spans.to_pylist(), items.to_pylist(), strict=True)
        return pa.array([{"n_words": n, "spans": united(s or []), "items": i or []} for n, s, i in rows], HITS)

    return unite.asNondeterministic()(text, spans, items)


def stored_windows(items: DataFrame, window: int) -> DataFrame:
    """``n, code, words, item`` of all windows, as a table."""
    schema = "n int, code long, words binary, item string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(windows_of(item, text, window))
                n, code, words, names = zip(*rows, strict=True) if rows else ((), (), (), ())
                signed = pa.array(np.array(code, np.uint64).view(np.int64))
                columns = [pa.array(n, pa.int32()), signed, pa.array(words, pa.binary()), pa.array(names, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["n", "code", "words", "item"])

    return materialise(items.mapInArrow(cut, schema), "windows")


def occurring(docs: DataFrame, text: str, windows: DataFrame, at_once: int) -> DataFrame:
    """``n, code`` of the windows whose hash some document has, a pass for every
    ``at_once`` distinct hashes."""
    spark = docs.sparkSession
    codes = materialise(windows.select("n", "code").distinct(), "codes")
    passes = max(1, -(-codes.count() // at_once))

    def look(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts in steps(batch.column(0)):
                    found = Words(texts, IS_WORD)
                    for n, (known, upper) in block.value.items():
                        _, seen = found.grams(n)
                        seen = np.unique(seen[among(seen, known, upper)])
                        columns = [pa.array(np.full(len(seen), n, np.int32)), pa.array(seen.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["n", "code"])

        return run

    tables = []
    for k in range(passes):
        part = codes.where(F.pmod(F.xxhash64("n", "code"), F.lit(passes)) == k).toArrow()
        n, code = part["n"].to_numpy(), part["code"].to_numpy().view(np.uint64)
        known = {int(m): np.sort(code[n == m]) for m in np.unique(n)}
        block = spark.sparkContext.broadcast({m: (h, prefixes(h)) for m, h in known.items()})
        found = docs.select(F.col(text).cast("string")).mapInArrow(look(block), "n int, code long")
        tables.append(materialise(found.distinct(), "occurring"))
        block.unpersist()
    return reduce(DataFrame.unionByName, tables)


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    hits: str,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    block_windows: int = BLOCK_WINDOWS,
    hashes: int = HASHES,
) -> DataFrame:
    """The documents with the struct of ``hits_of`` over all items as column ``hits``."""
    share = docs.sparkSession.sparkContext.broadcast
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    )
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= block_bytes:
        rows = items.toLocalIterator()
        block = share(Windows(w for r in rows for w in windows_of(r.i, r.t, window)))
        return docs.withColumn(hits, hits_of(F.col(text), block))
    windows = stored_windows(items, window)
    windows = materialise(windows.join(occurring(docs, text, windows, hashes), ["n", "code"], "left_semi"), "found")
    passes = max(1, -(-windows.count() // block_windows))
    key, found = private("text"), []
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    for k in range(passes):
        rows = windows.where(F.pmod(F.xxhash64("n", "code"), F.lit(passes)) == k).toLocalIterator()
        block = share(Windows((r.n, r.code % (1 << 64), bytes(r.words), r["item"]) for r in rows))
        seen = keyed.select(key, hits_of(F.col(text), block).alias("h")).where(F.size("h.items") > 0)
        found.append(materialise(seen.select(key, "h.spans", "h.items").dropDuplicates([key]), "hits"))
        block.unpersist()
    spans, names = private("spans"), private("items")
    together = (
        reduce(DataFrame.unionByName, found)
        .groupBy(key)
        .agg(
            F.flatten(F.collect_list("spans")).alias(spans),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(names),
        )
    )
    joined_back = keyed.join(together, key, "left")
    return joined_back.withColumn(hits, hits_together(F.col(text), F.col(spans), F.col(names))).drop(key, spans, names)


def verdict(hits: Column) -> dict[str, Column]:
    """Counts and verdict from the struct of ``hits_of``."""
    n_hit = F.aggregate(
        hits["spans"], F.lit(0).cast("long"), lambda a, s: a + s["last"].cast("long") - s["first"]
    )
    return {
        "n_words": hits["n_words"],
        "n_hit": n_hit,
        "n_items": F.size(hits["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(hits["items"], ","), 256),
        "contaminated": (n_hit > 0) & (n_hit * SHARE >= hits["n_words"]),
    }


def without_spans(text: Column, hits: Column) -> Column:
    """The text with its hit spans, from first to last word, taken out."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, places in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            raw, at, kept = (value or "").encode(), 0, []
            for span in places:
                kept.append(raw[at : span["start"]])
                at = span["end"]
            out.append(None if value is None else b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return cut(text, hits["spans"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents"
) -> DataFrame:
    """Documents without benchmark passages.

    ``remove="documents"`` drops contaminated documents and leaves all others
    untouched; ``remove="spans"`` keeps every document and cuts out all hits.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    hits = private("hits")
    found = with_hits(docs, benchmark, hits, text)
    if remove == "documents":
        return found.where(~verdict(F.col(hits))["contaminated"]).drop(hits)
    return found.withColumn(text, without_spans(F.col(text), F.col(hits))).drop(hits)


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{WORD}+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, CASE WHEN len(w) < {WINDOW} THEN w ELSE w[i:i + {WINDOW - 1}] END AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i
        FROM b WHERE len(w) > 0 AND item IS NOT NULL)
), sizes AS (
  SELECT DISTINCT len(g) AS n FROM windows
), runs AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, n, i, item FROM runs JOIN windows USING (g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(ORACLE)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), "h")
    return found.select("doc_id", *(c.alias(k) for k, c in verdict(F.col("h")).items()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, all others stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
