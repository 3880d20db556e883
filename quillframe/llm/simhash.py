"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints: 64 bits, each the majority of that bit in the XXH64 hashes (seed
42) of a text's four-word shingles. Two fingerprints are linked if they differ
in at most RADIUS bits; documents in one component are near-duplicates.

Tables: bit i has the code c(i), a nonzero vector of RADIUS + 1 bits, and table
v (a nonzero vector as well) looks at the bits with odd c(i)·v. The codes of at
most RADIUS bits never span the whole space, so some v is orthogonal to all of
them and its table sees none of the bits in which a linked pair differs: every
linked pair shares a bucket for certain, with 2**(RADIUS + 1) - 1 tables.

Copies of a fingerprint are one row from the start. A bucket's members are
first compared with the bucket's smallest one only. What is then still in two
components within a bucket is compared in blocks, block by block, each pair of
blocks giving no more links than a spanning forest needs. So groups of near
copies cost a row for each member, no pairs are listed, and no link between two
components is lost.

Cases: null, empty and blank texts have no words, fingerprint zero, and are
linked like others; fewer than four words are one shingle. Repeated rows share
a component. An empty table gives an empty result. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import by_shuffle, private, query, raw_texts, table
from quillframe.session import materialise

SHINGLE = 4
HASH_SEED = 42
RADIUS = 4
BITS = 64
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text, as an unsigned number."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)
        hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in pairs], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed long with the same 64 bits."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(r) for r in raw_texts(texts)], np.uint64).view(np.int64))

    return prints.asNondeterministic()(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The tables' bit masks, as signed longs."""
    size = 1 << (radius + 1)
    code = [1 + i % (size - 1) for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (code[i] & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bucketed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each row of ``fps`` with ``table, bucket`` for every table."""
    tables = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks)))
    return fps.select("*", tables.alias("table", "bucket"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, component`` for undirected ``a, b``: the smallest node reachable.

    Alternating star operations: each round points a node's larger neighbours
    at its smallest one, then its smaller ones, until all point at the
    component's smallest. Rounds grow with the logarithm of the path lengths.
    Nodes are never gathered by group: a round is an aggregation and a join.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialise(edges.where("a <> b").distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # now each b's smaller neighbours a: the smallest takes all others and b
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        edges = (
            large.join(small, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = materialise(edges, label)
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = state


def block_links(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """Links between fingerprints of one bucket that lie in two components.

    Members get one of size/block block numbers; each pair of blocks is a group
    of its own, compared with arrays, and gives the links that join two of its
    components so far, not all that there are.
    """
    size = rows.groupBy("table", "bucket").agg(F.ceil(F.count("*") / block).alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = (
        rows.join(size, ["table", "bucket"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "table",
            "bucket",
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
            "mine",
            "fp",
            "component",
        )
    )

    def links(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy()
        bits = fp.view(np.uint64)
        comp = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        a, b = [], []
        for k in range(len(fp)):
            near = np.flatnonzero(
                (np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= radius) & (comp[k + 1 :] != comp[k])
            ) + k + 1
            if len(near):
                _, one = np.unique(comp[near], return_index=True)
                for x in near[one].tolist():
                    if comp[x] != comp[k]:
                        a.append(fp[k])
                        b.append(fp[x])
                        comp[comp == comp[x]] = comp[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("table", "bucket", "i", "j").applyInArrow(links, "a long, b long")


def near_classes(
    prints: DataFrame, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """``fp, class_fp`` for every fingerprint of ``prints`` (column ``fp``): the
    smallest fingerprint reachable through links of at most ``radius`` bits."""
    fps = materialise(prints.select("fp").distinct(), "fingerprints")
    masks = covering_masks(radius)
    tables = bucketed(fps, masks)
    shared = tables.groupBy("table", "bucket").agg(
        F.count("*").alias("n"), F.min("fp").alias("pivot")
    ).where("n > 1").drop("n")
    stars = (
        by_shuffle(tables)
        .join(shared, ["table", "bucket"])
        .where((F.col("fp") != F.col("pivot")) & (distance(F.col("fp"), F.col("pivot")) <= radius))
        .select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )
    first = materialise(stars, "stars")
    known = components(first, "components")
    named = fps.join(known, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )
    open_rows = bucketed(named, masks)
    mixed = (
        open_rows.groupBy("table", "bucket")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("table", "bucket")
    )
    rest = materialise(by_shuffle(open_rows).join(mixed, ["table", "bucket"]), "open-buckets")
    more = block_links(rest, radius, block)
    final = components(first.unionByName(more), "components")
    return fps.join(final, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("class_fp")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, class_fp, component_id`` for every row of ``docs``: the
    fingerprint, the smallest one of its component and the smallest key of the
    component. Rows without a key have a component of the others' smallest key,
    null if there is none. Where keys repeat with different texts, components of
    one name may be several; ``class_fp`` tells them apart."""
    prints = materialise(
        docs.select(F.col(key).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")), "prints"
    )
    classes = near_classes(prints)
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp")
    smallest = ids.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    by_print = ids.join(smallest, "class_fp").select("fp", "class_fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "class_fp", "component_id")


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest key,
    then fingerprint.

    A row is named by key and fingerprint, as a key may come back with another
    text. Only rows with such keys have their fingerprints computed again. Rows
    without a key are kept, as nothing names them.
    """
    member, mark = private("component"), private("fp")
    found = near_duplicates(docs, key, text).where("doc_id is not null")
    kept = materialise(
        found.groupBy("class_fp").agg(F.min(F.struct("doc_id", "fp")).alias("least")).select("least.*"),
        "kept",
    )
    repeated = materialise(
        found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated"
    ).select("doc_id")
    others = found.join(kept, ["doc_id", "fp"], "left_anti").select("doc_id")
    gone = others.unionByName(repeated).distinct().withColumnRenamed("doc_id", member)
    single = docs.join(gone, F.col(key) == F.col(member), "left_anti")
    again = docs.join(
        repeated.withColumnRenamed("doc_id", member), F.col(key) == F.col(member), "left_semi"
    ).withColumn(mark, fingerprint_of(F.col(text)))
    named = kept.join(repeated, "doc_id", "left_semi").withColumnsRenamed({"doc_id": member, "fp": "fp_" + mark})
    first = again.join(
        named, (F.col(key) == F.col(member)) & (F.col(mark) == F.col("fp_" + mark)), "left_semi"
    )
    return single.unionByName(first.dropDuplicates([key, mark]).drop(mark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays."""
    return one_of_each(docs)
