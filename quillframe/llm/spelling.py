"""Spelling variants: words at one edit from each other, by blocked Gram matrices.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered; of these, runs
of ``LEAST_LETTERS`` or more that occur ``LEAST_COUNT`` times or more over all
documents make up the vocabulary. Two words are near if one inserted, deleted or
replaced code point makes them equal.

A word is a vector of letter counts. One replacement changes two counts by one,
one insertion changes one, so near words have equal length and squared distance
2, or adjacent lengths and squared distance 1. Words are put into blocks by length
and, within a length, by how many letters of each of a few groups they have: an
edit moves at most one letter between groups, so a block meets itself and a fixed
number of adjacent blocks. A block is dealt out to tiles of bounded size by a
hash of the word; each pair of tiles is a row with both tiles' words, whose
squared distances come from one matrix product. The few pairs that pass are
verified letter by letter, and only those that are near leave the task.

A word's form is its near word of largest count, ties by code points, where that
count is at least ``FORM_TIMES`` its own; its root is found by doubling along the
forms, whose counts grow by that factor, in a number of rounds known beforehand.

Cases: null and empty texts have no words. A null id reads as an empty one in the
hash that damages runs. Repeated rows count each. Runs of any length are words; a
tile of very long ones holds fewer. Empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import let
from quillframe.llm.common import query, table
from quillframe.session import materialise

LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_TIMES = 5
#: Of the damaged copies that the query counts: one run in so many loses a letter.
DAMAGE_EVERY = 199

RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Groups of letters whose counts name a block of a length.
GROUPS = 4
#: Words of a tile, at most about, and their letters.
TILE_WORDS = 2048
TILE_LETTERS = 1 << 16
#: Letters compared at once when pairs are verified.
STEP_LETTERS = 1 << 22

PAIRS = "word string, near string, near_n long"


def runs_of(text: Column) -> Column:
    """The runs of a text that are long enough, lowered."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))
    return F.transform(found, lambda r: F.translate(r, UPPER, LOWER))


def damaged(key: Column, run: Column, every: int = DAMAGE_EVERY) -> Column:
    """The run; where ``every`` divides the CRC-32 of key and run, less a letter."""

    def cut(h: Column) -> Column:
        at = (h % F.length(run)).cast("int")
        left = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
        return F.when(h % every == 0, left).otherwise(run)

    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run)
    return let(F.crc32(name.cast("binary")), cut)


def vocabulary(runs: DataFrame, word: str = "word") -> DataFrame:
    """``word, n``: the words that are long and frequent enough, of a table with
    a row for each occurrence."""
    counted = runs.where(F.length(word) >= LEAST_LETTERS).groupBy(word).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT).select(F.col(word).alias("word"), "n")


def group_counts(word: Column) -> list[Column]:
    """How many letters of each group a word has."""
    groups = [LETTERS[g::GROUPS] for g in range(GROUPS)]
    other = ["".join(set(LETTERS) - set(g)) for g in groups]
    return [F.length(F.translate(word, "".join(sorted(o)), "")) for o in other]


def block_name(counts: list[Column]) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in counts))


def tiles_of(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of each tile, and each block's counts with its number of tiles."""
    counts = group_counts(F.col("word"))
    placed = words.select(
        "word", "n", F.array(*counts).alias("counts"), block_name(counts).alias("block"), F.length("word").alias("size")
    )
    fit = F.least(F.lit(TILE_WORDS), F.greatest(F.lit(1), F.floor(TILE_LETTERS / F.col("size"))))
    blocks = placed.groupBy("block").agg(
        F.first("counts").alias("counts"), F.ceil(F.count("*") / F.first(fit)).cast("int").alias("tiles")
    )
    blocks = materialise(blocks, "word-blocks")
    dealt = placed.join(blocks.select("block", "tiles"), "block").select(
        F.concat_ws("#", "block", F.pmod(F.xxhash64("word"), "tiles").cast("string")).alias("tile"), "word", "n"
    )
    tiles = dealt.groupBy("tile").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return materialise(tiles, "word-tiles"), blocks


def tile_pairs(blocks: DataFrame) -> DataFrame:
    """``one, other, adjacent``: the tiles that may hold near words, each pair once."""

    def moved(up: int, down: int | None) -> Column:
        step = lambda g: (g == up) - (g == down)
        return block_name([F.get("counts", F.lit(g)) + step(g) for g in range(GROUPS)])

    # of two blocks of a length, the one that loses letters of the later group asks
    swaps = [moved(i, j) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    same = [F.struct(b.alias("name"), F.lit(0).alias("adjacent")) for b in [F.col("block"), *swaps]]
    longer = [F.struct(moved(i, None).alias("name"), F.lit(1).alias("adjacent")) for i in range(GROUPS)]
    asked = blocks.select("block", "tiles", F.explode(F.array(*same, *longer)).alias("to"))
    met = asked.join(blocks.select(F.col("block").alias("_b"), F.col("tiles").alias("_t")), F.col("to.name") == F.col("_b"))
    number = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    each = met.withColumn("i", number(F.col("tiles"))).withColumn("j", number(F.col("_t")))
    once = (F.col("block") != F.col("_b")) | (F.col("i") <= F.col("j"))
    name = lambda b, i: F.concat_ws("#", b, F.col(i).cast("string"))
    return each.where(once).select(
        name("block", "i").alias("one"), name("_b", "j").alias("other"), F.col("to.adjacent").alias("adjacent")
    )


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each word."""
    column = np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26).astype(np.int64)
    flat = np.arange(len(codes))[:, None] * len(LETTERS) + column
    counts = np.bincount(flat.ravel(), minlength=len(codes) * len(LETTERS)).reshape(len(codes), -1)
    # sums of products of counts stay exact in this type
    return counts.astype(np.float32 if codes.shape[1] < 2048 else np.float64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a letter taken out of ``long`` leaves ``short``, row by row."""
    size = short.shape[1]
    unlike = short != long[:, :-1]
    head = np.where(unlike.any(1), unlike.argmax(1), size)
    unlike = (short != long[:, 1:])[:, ::-1]
    tail = np.where(unlike.any(1), unlike.argmax(1), size)
    return head + tail >= size


def near_pairs(one: list[str], other: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words in two tiles: of one length, or ``other`` one longer.
    With ``same`` both are one tile, and each pair is given once."""
    a, b = letters_of(one), letters_of(other)
    longer = b.shape[1] - a.shape[1]
    va, vb = vectors(a), vectors(b)
    used = va.any(0) | vb.any(0)
    i, j = np.nonzero(squared_distances(va[:, used], vb[:, used]) == (1 if longer else 2))
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, STEP_LETTERS // a.shape[1])
    test = one_inserted if longer else one_replaced
    parts = [test(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    near = np.concatenate(parts) if parts else np.zeros(0, bool)
    return i[near], j[near]


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every word with each of its near words and its count."""
    tiles, blocks = tiles_of(words)
    side = lambda to: tiles.select(F.col("tile").alias(to), F.col("words").alias(f"{to}_words"))
    # a pair of tiles is the unit of work, so that a large block is many tasks
    pairs = tile_pairs(blocks).join(side("one"), "one").join(side("other"), "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [a == b for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for r, twin in enumerate(same):
                one, other = (batch.column(c)[r].values for c in (2, 3))
                names = [side.field(0).to_pylist() for side in (one, other)]
                counts = [side.field(1) for side in (one, other)]
                i, j = (pa.array(x) for x in near_pairs(*names, twin))
                if len(i):
                    first, second = one.field(0).take(i), other.field(0).take(j)
                    for w, near, n in ((first, second, counts[1].take(j)), (second, first, counts[0].take(i))):
                        yield pa.RecordBatch.from_arrays([w, near, n], ["word", "near", "near_n"])

    return pairs.select("one", "other", "one_words", "other_words").mapInArrow(compare, PAIRS)


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n``."""
    words = materialise(words, "vocabulary")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    strong = -F.col("best.less") >= FORM_TIMES * F.col("n")
    rows = materialise(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1
    # a chain of forms has counts that grow by FORM_TIMES, and each round doubles its reach
    longest = math.floor(math.log(max(most / LEAST_COUNT, 1), FORM_TIMES)) + 1
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        roots = materialise(roots, "spelling-roots")
        ahead = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        roots = roots.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root")
        )
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


_CRC = """list_reduce(list_concat([4294967295], list_transform(range(1, len(hx) // 2 + 1),
      lambda i: CAST('0x' || hx[2 * i - 1:2 * i] AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""
ORACLE = rf"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor({_CRC}, 4294967295) AS h
  FROM (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs), tab
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % {DAMAGE_EVERY} = 0
      THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (cut, i) WHERE a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM cuts a JOIN v ON a.cut = v.word
  UNION SELECT v.word, a.word, a.n FROM cuts a JOIN v ON a.cut = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word
), picked AS (
  SELECT near.word, min(encode(near)) AS form FROM near JOIN best USING (word) WHERE near_n = top GROUP BY near.word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top >= {FORM_TIMES} * v.n THEN decode(form) END AS form,
    CASE WHEN top >= {FORM_TIMES} * v.n THEN top END AS form_n
  FROM v LEFT JOIN best USING (word) LEFT JOIN picked USING (word)
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.at AS root FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@query(ORACLE)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some damaged, with their near words and forms."""
    docs = table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(runs_of(F.col("text"))).alias("run"))
    return variants(vocabulary(runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))))
