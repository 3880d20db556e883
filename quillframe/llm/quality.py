"""Quality rules: document statistics judged by gradient-boosted trees.

``document_statistics`` turns a text into the counts of the base rules and the
ratios the trees look at. ``train_trees`` fits boosted trees for the logistic
loss on a bounded sample of labelled rows, by histograms, with monotonic
constraints; ``Forest`` holds all trees as flat node arrays and scores a block
of rows with one array step per level.

Cases: a null or empty text has no words, all counts are 0 and the base rule
(fewer than 20 words) rejects it. Repeated rows are judged alike, each for
itself. Without labelled rows only the base rules decide. An empty table gives
an empty result. Columns of the documents are never renamed or overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import GOLDEN, mix, private, query, raw_texts, table

SYMBOLS = b"#*$%&|<>"
#: Bytes that continue a character, so that the rest counts code points.
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Documents scored below this are rejected.
THRESHOLD = 0.5

FEATURES = (
    "log_words",
    "symbol_share",
    "repeat_share",
    "duplicate_lines",
    "word_length",
    "upper_share",
    "distinct_share",
    "sign_share",
    "digit_share",
    "words_per_line",
)
#: More of these never raises a score.
MONOTONE = {"symbol_share": -1, "repeat_share": -1, "duplicate_lines": -1}

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in runs of ``window`` (a power of two) words that the text has twice or more.

    Hashes of the runs show at once that most texts have none, as equal runs
    have equal hashes. Else it is exact: words become numbers, and pairs of runs
    become numbers of runs of twice the length, until they are long enough.
    """
    if len(words) <= window:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    spread, count = mix(ids.view(np.uint64) + GOLDEN), len(ids) - window + 1
    runs = np.zeros(count, np.uint64)
    for k in range(window):
        runs = runs * GOLDEN + spread[k : k + count]
    runs.sort()
    if not (runs[1:] == runs[:-1]).any():
        return 0
    step = 1
    while step < window:
        _, ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(ids)] += twice
    edges[window : window + len(ids)] -= twice
    return int((np.cumsum(edges) > 0).sum())


def document_statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The five counts of the base rules, and the inputs of the trees."""
    words = raw.split()
    joined = b"".join(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, chars = len(words), len(joined.translate(None, CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    duplicates = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    share = lambda delete: (len(joined) - len(joined.translate(None, delete))) / max(chars, 1)
    inputs = [
        np.log1p(n),
        symbols / max(chars, 1),
        repeats / max(n, 1),
        duplicates / max(len(lines), 1),
        chars / max(n, 1),
        share(UPPER),
        len(set(words)) / max(n, 1) ** 0.8,
        share(SIGNS),
        share(DIGITS),
        np.log1p(n / max(len(lines), 1)),
    ]
    return [n, chars, symbols, duplicates, repeats], inputs


@dataclass
class Forest:
    """Boosted trees as flat arrays: node i sends a row with feature[i] <=
    threshold[i] to left[i], others to right[i]; a leaf points to itself."""

    base: float = 0.0
    depth: int = 0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row."""
        rows = np.arange(len(x))[:, None]
        at = np.tile(np.array(self.roots, np.int32), (len(x), 1))
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        total = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def train_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: int = 10,
) -> Forest:
    """Boosted trees for the logistic loss.

    A constrained feature is only split where the sides' values are in its
    order, and the middle of both values bounds everything below, so the
    constraint holds for the whole tree and thus for the sum.
    """
    good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(base=float(np.log(good / (1 - good))), depth=depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
    total = np.full(len(y), forest.base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = slope[rows], curve[rows]
        own = float(np.clip(g.sum() / (h.sum() + ridge), low, high))
        node = leaf(own * rate)
        if level == depth or len(rows) < 2 * least:
            return node
        best: tuple = (1e-6, None)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            bin_of, size = binned[rows, f], len(cut) + 1
            gl, hl, nl = (np.cumsum(np.bincount(bin_of, w, size))[:-1] for w in (g, h, None))
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
            vl, vr = (np.clip(a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = lambda v, a, b: 2 * v * a - v * v * (b + ridge)
            better = gain(vl, gl, hl) + gain(vr, gr, hr) - gain(own, g.sum(), h.sum())
            allowed = (nl >= least) & (nr >= least) & (monotone[f] * (vr - vl) >= 0)
            better = np.where(allowed, better, -1)
            k = int(better.argmax())
            if better[k] > best[0]:
                best = (better[k], f, k, vl[k], vr[k])
        if best[1] is None:
            return node
        _, f, k, vl, vr = best
        goes = binned[rows, f] <= k
        middle = (vl + vr) / 2
        left = (low, middle) if monotone[f] > 0 else (middle, high) if monotone[f] < 0 else (low, high)
        right = (middle, high) if monotone[f] > 0 else (low, middle) if monotone[f] < 0 else (low, high)
        nodes[node][:4] = [
            f,
            cuts[f][k],
            grow(rows[goes], level + 1, *left),
            grow(rows[~goes], level + 1, *right),
        ]
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        first = len(nodes)
        forest.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        flat = np.array(nodes[first:], dtype=float)
        at = np.zeros(len(y), np.int64)
        for _ in range(depth):
            low = x[np.arange(len(y)), flat[at, 0].astype(int)] <= flat[at, 1]
            at = np.where(low, flat[at, 2], flat[at, 3]).astype(np.int64) - first
        total = total + flat[at, 4]
    flat = np.array(nodes, dtype=float)
    forest.feature, forest.threshold = flat[:, 0].astype(np.int32), flat[:, 1]
    forest.left, forest.right = flat[:, 2].astype(np.int32), flat[:, 3].astype(np.int32)
    forest.value = flat[:, 4]
    return forest


def inputs_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def inputs(texts: pa.Array) -> pa.Array:
        return pa.array([document_statistics(raw)[1] for raw in raw_texts(texts)], pa.list_(pa.float64()))

    return inputs.asNondeterministic()(text)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Forest | None:
    """Trees fitted on at most ``sample_rows`` labelled documents, those first
    in the order of a hash of their key; None if none is labelled. Of rows that
    share a key the one with the smallest hash of its text is taken."""
    rows, goal = private("key"), private("goal")
    sample = (
        labels.select(F.col(key).alias(rows), F.col(label).cast("double").alias(goal))
        .where(F.col(rows).isNotNull() & F.col(goal).isNotNull())
        .groupBy(rows)
        .agg(F.min(goal).alias(goal))
        .orderBy(F.xxhash64(rows), rows)
        .limit(sample_rows)
    )
    found = (
        docs.select(key, text)
        .join(F.broadcast(sample), F.col(key) == F.col(rows))  # sample_rows rows at most
        .select(rows, F.xxhash64(text).alias("h"), inputs_of(F.col(text)).alias("x"), F.col(goal).alias("y"))
        .groupBy(rows)
        .agg(F.min(F.struct("h", "x", "y")).alias("s"))  # a row for each key comes to the driver
        .select("s.x", "s.y")
        .toPandas()
    )
    if found.empty:
        return None
    x, y = np.stack(found["x"].to_numpy()), found["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums then do not differ
    return train_trees(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def quality_of(
    spark: SparkSession, text: Column, forest: Forest | None, threshold: float = THRESHOLD
) -> Column:
    """A struct of the counts, base_failed, score and kept for a text."""
    shared = spark.sparkContext.broadcast(forest)  # a few thousand nodes

    @F.arrow_udf(f"{COUNTS}, base_failed boolean, score double, kept boolean")
    def judge(texts: pa.Array) -> pa.Array:
        both = [document_statistics(raw) for raw in raw_texts(texts)]
        counts = np.array([c for c, _ in both], np.int64).reshape(-1, 5)
        n, repeats = counts[:, 0], counts[:, 4]
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        x = np.array([i for _, i in both], float).reshape(-1, len(FEATURES))
        score = shared.value.score(x) if shared.value else np.ones(len(x))
        columns = [*counts.T, failed, score, ~failed & (score >= threshold)]
        names = [*(c.split()[0] for c in COUNTS.split(", ")), "base_failed", "score", "kept"]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names)

    return judge.asNondeterministic()(text)


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the trees' verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality_of(spark, F.col("text"), forest).alias("q")).select(
        "doc_id", "q.*"
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules or the trees reject go."""
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    verdict = private("quality")
    judged = docs.withColumn(verdict, quality_of(spark, F.col("text"), forest))
    return judged.where(F.col(verdict).getField("kept")).drop(verdict)
