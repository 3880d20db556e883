"""Ranked lexical search: k2-treaps over the grid of terms and documents.

Terms are runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lowered. A
document's impact of a term is ``(10**9 * tf) div (1000 * tf + 20 * m)``, with m
from its length and the mean length; its score for an item is the sum of the
impacts of the item's terms times their weights, by how rare a term is.

The index is a table of shards. A shard holds the documents of a stretch of one
task, up to ``SHARD_BYTES`` of text, as a grid with a row for each term (frequent
ones first) and a column for each document (short ones first). The grid is a
quadtree of its non-empty cells: level by level, a cell has four bits for its
quarters and the largest impact below it. Only terms that occur take space, and
no term is compared by a hash.

A search descends the rows of all terms of an item jointly. A node is a range of
documents with each term's cell at that level; the weighted sum of the cells'
maxima bounds every score in the range. The best nodes of every item are opened
first, ``OPEN`` at a time so that it is array work, until no bound reaches the
k-th best score, which a task takes along from shard to shard. Each task hands
on its k best of an item, and a window picks the k best of these.

The items go to the executors in blocks of at most ``BLOCK_BYTES`` of text, or
one item; each block is a pass over the index. Only the document counts of a
block's terms come to the driver.

Cases: null and empty texts have no terms; such documents are not counted in N
and never found, such items find nothing. Items without an id are left out, rows
that share an item's id are one item with all their terms. Repeated documents
are each ranked; a null document id comes first among equal scores. Terms that
no document has weigh nothing. Empty tables give an empty result. Other columns
of either table are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import query, raw_texts, table
from quillframe.session import scratch_path

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every byte of a character beyond ASCII is part of a term.
TERM_BYTES = re.compile(TERM.encode())
GAP_BYTES = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Text bytes that are cut into terms at a time.
STEP = 1 << 20
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
TOP = 50
#: A shard is a large row: readers hold a row group at once, so it has few.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Nodes of one item that are opened together.
OPEN = 32

QUARTERS = np.array([bin(m).count("1") for m in range(16)], np.int64)


def terms_in(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    at, low = 0, raw.lower()  # bytes.lower changes A-Z only
    while at < len(low):
        gap = GAP_BYTES.search(low, at + STEP)
        end = gap.start() if gap else len(low)
        yield TERM_BYTES.findall(low, at, end)
        at = end


@dataclass
class Index:
    """Shards of a corpus; ``documents`` have ``terms`` terms in all."""

    shards: DataFrame
    documents: int
    terms: int
    key: T.DataType


@dataclass
class Grid:
    """Cells of a shard's quadtree, level by level from the root."""

    height: int
    masks: np.ndarray
    maxima: np.ndarray

    def __post_init__(self) -> None:
        # children of a level stand in the order of their parents
        inner = QUARTERS[self.masks]
        self.child = 1 + np.cumsum(inner) - inner


def build_grid(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> Grid:
    """The quadtree of the points (row, column) with these impacts."""
    height = max(int(rows.max(initial=0)).bit_length(), int(columns.max(initial=0)).bit_length(), 1)
    place = np.zeros(len(rows), np.uint64)
    for bit in range(height):
        place |= ((columns >> bit) & 1).astype(np.uint64) << np.uint64(2 * bit)
        place |= ((rows >> bit) & 1).astype(np.uint64) << np.uint64(2 * bit + 1)
    order = np.argsort(place, kind="stable")
    place, best = place[order], impacts[order].astype(np.uint32)
    masks, maxima = [], [best]
    for _ in range(height):
        parent = place >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        quarter = (1 << (place & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(quarter, first))
        best = np.maximum.reduceat(best, first)
        maxima.append(best)
        place = parent[first]
    # the last level's cells have no quarters, so their masks are not stored
    return Grid(height, np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]))


class Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.codes: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.keys: list[pa.Array] = []
        self.bytes = 0

    def add(self, raw: bytes, key: pa.Array) -> None:
        n = 0
        for found in terms_in(raw):
            self.codes.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
            n += len(found)
        self.lengths.append(n)
        self.keys.append(key)
        self.bytes += len(raw)

    def row(self, documents: int, terms: int) -> dict | None:
        """The shard as a row of the index; none if there is no term."""
        if not self.ids:
            return None
        lengths = np.array(self.lengths, np.int64)
        codes = np.concatenate(self.codes).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        places, tf = np.unique(codes * len(lengths) + owner, return_counts=True)
        rows, columns = np.divmod(places, len(lengths))
        m = 100 - 50 + (50 * lengths * documents) // terms
        impacts = (10**9 * tf) // (1000 * tf + 20 * m[columns])
        counts = np.bincount(rows, minlength=len(self.ids))
        by_count, by_length = np.argsort(-counts, kind="stable"), np.argsort(lengths, kind="stable")
        at_row, at_column = (np.empty(len(o), np.int64) for o in (by_count, by_length))
        at_row[by_count], at_column[by_length] = np.arange(len(by_count)), np.arange(len(by_length))
        grid = build_grid(at_row[rows], at_column[columns], impacts)
        names = list(self.ids)
        return {
            "docs": pa.concat_arrays(self.keys).take(pa.array(by_length)),
            "terms": b"\n".join(names[i] for i in by_count.tolist()),
            "counts": counts[by_count].astype("<i4").tobytes(),
            "height": grid.height,
            "masks": grid.masks.tobytes(),
            "maxima": grid.maxima.astype("<u4").tobytes(),
        }


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES
) -> Index:
    """The shards of all documents, stored in the shared folder."""
    kind = docs.schema[key].dataType
    size = docs.select(F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long").alias("n"))
    totals = size.agg(F.count_if(F.col("n") > 0).alias("d"), F.sum("n").alias("t")).first()
    documents, terms = totals.d or 0, totals.t or 0
    names = ("terms", "counts", "masks", "maxima")
    schema = T.StructType(
        [
            T.StructField("docs", T.ArrayType(kind)),
            T.StructField("height", T.IntegerType()),
            *(T.StructField(n, T.BinaryType()) for n in names),
        ]
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: Shard) -> Iterator[pa.RecordBatch]:
            if row := shard.row(documents, terms):
                ids = row.pop("docs")
                both = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [both, pa.array([row["height"]], pa.int32()), *(pa.array([row[n]], pa.binary()) for n in names)],
                    ["docs", "height", *names],
                )

        shard = Shard()
        for batch in batches:
            for i, raw in enumerate(raw_texts(batch.column(1))):
                shard.add(raw, batch.column(0).slice(i, 1))
                if shard.bytes >= shard_bytes:
                    yield from out(shard)
                    shard = Shard()
        yield from out(shard)

    made = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(shards, schema)
    path = scratch_path(docs.sparkSession, "lexical-index")
    made.write.options(**ROW_GROUPS).parquet(path)
    return Index(docs.sparkSession.read.schema(schema).parquet(path), documents, terms, kind)


@dataclass
class Block:
    """Items of one pass: term j of item ``owner[j]`` is ``names[term[j]]``."""

    items: list
    names: list[bytes]
    owner: np.ndarray
    term: np.ndarray
    weights: np.ndarray | None = None


def blocks_of(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[Block]:
    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    )
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        found: dict[object, set[bytes]] = defaultdict(set)
        # by id, so that rows sharing one meet in a block
        for row in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).toLocalIterator():
            for terms in terms_in(row.t.encode()):
                found[row.i].update(terms)
        ids: dict[bytes, int] = defaultdict(count().__next__)
        term = [ids[t] for terms in found.values() for t in sorted(terms)]
        owner = np.repeat(np.arange(len(found)), [len(t) for t in found.values()])
        if term:
            yield Block(list(found), list(ids), owner, np.array(term))


def document_counts(index: Index, block: Broadcast) -> np.ndarray:
    """In how many documents each term of a block occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.value.names), np.int64)
        for batch in batches:
            for terms, n in zip(raw_texts(batch.column(0)), raw_texts(batch.column(1)), strict=True):
                at = rows_of(terms, block.value.names)
                total[at >= 0] += np.frombuffer(n, "<i4")[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    found = index.shards.select("terms", "counts").mapInArrow(counts, "term long, n long")
    out = np.zeros(len(block.value.names), np.int64)
    for row in found.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


def rows_of(terms: bytes, names: list[bytes]) -> np.ndarray:
    """Each name's row in a shard, or -1."""
    rows = {t: i for i, t in enumerate(terms.split(b"\n"))}
    return np.array([rows.get(n, -1) for n in names], np.int64)


def descend(
    grid: Grid, owner: np.ndarray, rows: np.ndarray, weights: np.ndarray, known: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, column, score) of all documents of a shard that may be among the
    ``top`` best of an item, whose best scores so far are the rows of ``known``.

    Term j belongs to item ``owner[j]``; items count from 0 and owners ascend.
    """
    best = np.sort(known, axis=1)[:, ::-1].copy()
    need = np.maximum(best[:, top - 1], 1)
    items = np.unique(owner)
    # nodes: item, level, first column and bound; parts: node, term and cell
    node_item, node_level, node_column = items, np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    part_node = np.searchsorted(items, owner)
    part_term, part_cell = np.arange(len(owner)), np.zeros(len(owner), np.int64)
    bound = np.zeros(len(items), np.int64)
    np.add.at(bound, part_node, weights * int(grid.maxima[0]))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(node_item):
        order = np.lexsort((-bound, node_item))
        ahead = node_item[order]
        rank = np.arange(len(order)) - np.searchsorted(ahead, ahead)
        opened = np.zeros(len(order), bool)
        opened[order[rank < OPEN]] = True
        number = np.cumsum(opened) - 1
        mine = opened[part_node]
        parent, term, cell = part_node[mine], part_term[mine], part_cell[mine]
        level = node_level[parent]
        mask = grid.masks[cell].astype(np.int64)
        row_bit = (rows[term] >> (grid.height - 1 - level)) & 1
        new = []
        for side in (0, 1):
            quarter = 2 * row_bit + side
            has = (mask >> quarter) & 1 == 1
            before = QUARTERS[mask & ((1 << quarter) - 1)]
            new.append(((2 * number[parent] + side)[has], term[has], (grid.child[cell] + before)[has]))
        node, term, cell = (np.concatenate(x) for x in zip(*new, strict=True))
        old = np.flatnonzero(opened)
        made_item, made_level = np.repeat(node_item[old], 2), np.repeat(node_level[old] + 1, 2)
        made_column = np.repeat(2 * node_column[old], 2) + np.tile([0, 1], len(old))
        made_bound = np.zeros(2 * len(old), np.int64)
        np.add.at(made_bound, node, weights[term] * grid.maxima[cell].astype(np.int64))
        # documents are results at once, and raise what the others need
        leaf = (made_level == grid.height) & (made_bound >= need[made_item])
        if leaf.any():
            found.append((made_item[leaf], made_column[leaf], made_bound[leaf]))
            best, need = raised(best, need, made_item[leaf], made_bound[leaf], top)
        keep_old = ~opened & (bound >= need[node_item])
        keep_new = (made_level < grid.height) & (made_bound >= need[made_item])
        old_at, new_at = np.cumsum(keep_old) - 1, np.cumsum(keep_new) - 1 + keep_old.sum()
        stay, come = keep_old[part_node], keep_new[node]
        part_term = np.concatenate([part_term[stay], term[come]])
        part_cell = np.concatenate([part_cell[stay], cell[come]])
        part_node = np.concatenate([old_at[part_node[stay]], new_at[node[come]]])
        node_item = np.concatenate([node_item[keep_old], made_item[keep_new]])
        node_level = np.concatenate([node_level[keep_old], made_level[keep_new]])
        node_column = np.concatenate([node_column[keep_old], made_column[keep_new]])
        bound = np.concatenate([bound[keep_old], made_bound[keep_new]])
    if not found:
        return (np.empty(0, np.int64),) * 3
    item, column, score = (np.concatenate(x) for x in zip(*found, strict=True))
    last = score >= need[item]
    return item[last], column[last], score[last]


def raised(
    best: np.ndarray, need: np.ndarray, item: np.ndarray, score: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray]:
    """The best scores with new ones, and the least score that can still count."""
    touched = np.unique(item)
    at = np.concatenate([np.repeat(touched, top), item])
    scores = np.concatenate([best[touched].ravel(), score])
    order = np.lexsort((-scores, at))
    at, scores = at[order], scores[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    best[touched] = scores[rank < top].reshape(len(touched), top)
    need[touched] = np.maximum(best[touched, top - 1], 1)
    return best, need


def search_block(index: Index, block: Broadcast, item: T.DataType, top: int) -> DataFrame:
    """``item, doc, score``: each task's best documents for the block's items."""

    def best_first(entry: tuple[int, object]) -> tuple:
        score, doc = entry
        return -score, doc is not None, doc

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask: Block = block.value
        known = np.zeros((len(ask.items), top), np.int64)
        results: dict[int, list[tuple[int, object]]] = defaultdict(list)
        for batch in batches:
            for i in range(batch.num_rows):
                docs, height, terms, masks, maxima = (batch.column(c)[i] for c in range(5))
                raw = masks.as_buffer(), maxima.as_buffer()
                grid = Grid(height.as_py(), np.frombuffer(raw[0], np.uint8), np.frombuffer(raw[1], "<u4"))
                rows = rows_of(terms.as_py(), ask.names)[ask.term]
                have = (rows >= 0) & (ask.weights[ask.term] > 0)
                weights = ask.weights[ask.term[have]]
                who, column, score = descend(grid, ask.owner[have], rows[have], weights, known, top)
                ids = docs.values.take(pa.array(column)).to_pylist()
                for w, s, d in zip(who.tolist(), score.tolist(), ids, strict=True):
                    results[w].append((s, d))
                for w in np.unique(who).tolist():
                    results[w] = sorted(results[w], key=best_first)[:top]
                    known[w, : len(results[w])] = [s for s, _ in results[w]]
        rows = [(ask.items[w], d, s) for w, entries in results.items() for s, d in entries]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("item", "doc", "score"), r, strict=True)) for r in rows], arrow_schema
        )

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [T.StructField("item", item), T.StructField("doc", index.key), T.StructField("score", T.LongType())]
    )
    arrow_schema = to_arrow_schema(schema)
    shards = index.shards.select("docs", "height", "terms", "masks", "maxima")
    return shards.mapInArrow(found, schema)


def search(
    index: Index,
    items: DataFrame,
    item: str = "item_id",
    text: str = "text",
    key: str = "doc_id",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item, rank, key, score``: the best documents of every item."""
    spark, kind = items.sparkSession, items.schema[item].dataType
    schema = T.StructType(
        [T.StructField("item", kind), T.StructField("doc", index.key), T.StructField("score", T.LongType())]
    )
    found = spark.createDataFrame([], schema)
    for block in blocks_of(items, item, text, block_bytes):
        counts = document_counts(index, spark.sparkContext.broadcast(block))
        block.weights = np.array(
            [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) if n else 0 for n in counts.tolist()],
            np.int64,
        )
        found = found.unionByName(search_block(index, spark.sparkContext.broadcast(block), kind, top))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, w FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS w
    FROM documents) WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS documents, CAST(sum(len(w)) AS BIGINT) AS words FROM d
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * documents + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(weight *
    ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // words)))) AS BIGINT) AS score
  FROM postings JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
WHERE rank <= {TOP}
"""


@query(ORACLE)
def op12_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark"))
