"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are its words, pairs of neighbours, pairs with one word
skipped and the beginnings of longer words, each hashed to one of ``2**BITS``
coordinates and counted once. FTRL
gives every coordinate a learning rate of its own; its L1 term leaves most
weights at exactly zero, so the model is a short list of coordinates, which is
broadcast. Ids, sources, languages and labels are never features.

The model is fitted in one task on at most ``SAMPLE_ROWS`` labelled documents
and ``SAMPLE_BYTES`` of text, in the order of a hash of their ids.

Cases: null, empty and wordless texts have no feature and score with the
intercept. Without labelled rows every score is 0. Documents labelled twice
count as toxic if one label says so. Repeated rows are scored each. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import GOLDEN, Words, byte_class, mix, query, steps, table
from quillframe.session import materialise

BITS = 20
IS_WORD = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
#: FTRL: rate, its smoothing, and the L1 and L2 terms; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 4.0, 0.0, 5
#: Bytes of a word's beginning, for words that are longer.
BEGINNING = 4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of every feature, repeats included."""
    w, doc = found.hashes, found.doc
    out = [(doc, mix(w + np.uint64(1)))]
    for gap in (1, 2):
        if len(w) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = mix(w[:-gap] * GOLDEN + w[gap:] + np.uint64(gap))
            out.append((doc[:-gap][same], pair[same]))
    long = np.flatnonzero(found.ends - found.starts > BEGINNING)
    data = np.frombuffer(found.lower, np.uint8)
    begin = np.zeros(len(long), np.uint64)
    for k in range(BEGINNING):
        begin = begin << np.uint64(8) | data[found.starts[long] + k]
    out.append((doc[long], mix(begin + (np.uint64(BEGINNING) << np.uint64(40)))))
    places = np.concatenate([h for _, h in out]) >> np.uint64(64 - BITS)
    return np.concatenate([d for d, _ in out]), places.astype(np.int32)


@dataclass
class Model:
    """Coordinates with a weight, in order, and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.places] = self.weights
        return table

    def score(self, texts: list[bytes], dense: np.ndarray) -> np.ndarray:
        doc, place = features(Words(texts, IS_WORD))
        weight = dense[place]
        some = np.flatnonzero(weight)
        once = np.unique(doc[some].astype(np.int64) << BITS | place[some])
        total = np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -50, 50)))


def train(rows: list[tuple[np.ndarray, int]]) -> Model:
    """FTRL-proximal over rows of distinct coordinates and a label."""
    last = 1 << BITS  # the intercept's coordinate, without L1
    z, n = np.zeros(last + 1), np.zeros(last + 1)

    def weights(at):
        shrink = np.where(at == last, 0.0, L1)
        w = -np.sign(z[at]) * np.maximum(np.abs(z[at]) - shrink, 0)
        return w / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rows = [(np.append(at, last), label) for at, label in rows]
    for step in range(PASSES):
        for i in np.random.default_rng(step).permutation(len(rows)):
            at, label = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - label
            if abs(g) < 1e-4:
                continue
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(last + 1))
    places = np.flatnonzero(w[:last])
    return Model(places.astype(np.int32), w[places].astype(np.float32), float(w[last]))


def held_out(key: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model | None:
    """A model of the labelled rows outside the held-out fold; None without any."""
    usable = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where("k is not null and y is not null")
        .where(~held_out(F.col("k")))
        .groupBy("k")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    sample = materialise(
        texts.join(F.broadcast(usable), "k")  # sample_rows rows at most
        .groupBy("k")
        .agg(F.max("text").alias("text"), F.max("y").alias("y"))
        .select("*", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")),
        "toxicity-sample",
    )
    sizes = sample.select("k", F.xxhash64("k").alias("h"), "size").toPandas().sort_values(["h", "k"])
    if sizes.empty:
        return None
    fits = sizes["size"].cumsum() <= sample_bytes
    fits.iloc[0] = True  # one document at least, however long
    chosen = sample.join(
        F.broadcast(docs.sparkSession.createDataFrame(sizes[fits][["k"]])), "k", "left_semi"
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labels, done = batch["y"].to_pylist(), 0
            for run in steps(batch["text"]):
                doc, place = features(Words(run, IS_WORD))
                once = np.unique(doc.astype(np.int64) << BITS | place)
                cuts = np.searchsorted(once >> BITS, np.arange(1, len(run)))
                parts = np.split((once & ((1 << BITS) - 1)).astype(np.int32), cuts)
                rows += zip(parts, labels[done : done + len(run)], strict=True)
                done += len(run)
        if rows:
            model = train(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(model.places, -1), pa.int32()),
                    pa.array(np.append(model.weights, model.intercept), pa.float64()),
                ],
                ["place", "weight"],
            )

    ordered = chosen.select("k", "text", "y").repartition(1).sortWithinPartitions(F.xxhash64("k"), "k")
    found = ordered.select("text", "y").mapInArrow(fit, "place int, weight double").toPandas()
    if found.empty:
        return None
    found = found.sort_values("place")
    weights = found["weight"].to_numpy()
    return Model(found["place"].to_numpy()[1:], weights[1:].astype(np.float32), float(weights[0]))


def toxic_score(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """Probability that a text is toxic."""
    shared = spark.sparkContext.broadcast(model)  # a coordinate and a weight each
    expanded: list[np.ndarray] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if shared.value is None:
            return pa.array(np.zeros(len(texts)))
        if not expanded:
            expanded.append(shared.value.dense())
        runs = [shared.value.score(run, expanded[0]) for run in steps(texts)]
        return pa.array(np.concatenate([*runs, np.zeros(0)]))

    return score.asNondeterministic()(text)


def toxicity(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    scored = docs.select(
        F.col(key).alias("doc_id"),
        held_out(F.col(key)).alias("held_out"),
        toxic_score(docs.sparkSession, F.col(text), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two folds of three."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
