"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import configure

#: Text bytes that one vectorised step looks at; a longer text is a step alone.
STEP_BYTES = 1 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register ``(spark, sf_dir) -> DataFrame`` under the function's name."""

    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if oracle is not None:
            ORACLES[fn.__name__] = oracle.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled whatever Spark takes its size for:
    an explode counts there as one row for each, and its table would be broadcast."""
    return df.hint("merge")


def private(label: str) -> str:
    """A column name that no column of a caller's table has."""
    return f"__{label}_{uuid.uuid4().hex[:12]}"


def raw_texts(texts: pa.Array) -> Iterator[bytes]:
    """The texts as UTF-8, one after another; a null is empty."""
    for value in texts.cast(pa.large_binary()):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def steps(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in runs of about STEP_BYTES."""
    run: list[bytes] = []
    size = 0
    for raw in raw_texts(texts):
        if run and size + len(raw) > STEP_BYTES:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield run


class Words:
    """Words of several texts as arrays: where they are and a hash of each.

    ``lower`` holds all texts one after another with the letters A-Z lowered
    and a space behind each; ``starts`` and ``ends`` are byte positions in it,
    ``doc`` the number of the text, ``first[i]`` the first word of text i.
    ``hashes`` covers a word's first and last eight bytes and its length, so
    equal words have equal hashes and a use that must be exact compares again.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.lower = b" ".join(texts).lower() + b" "
        data = np.frombuffer(self.lower, np.uint8)
        mask = is_word[data]
        edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        size = self.ends - self.starts
        cut = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        head = eight[self.starts + 8].copy().view("<u8").ravel() << cut
        tail = eight[self.ends].copy().view("<u8").ravel() >> cut
        return mix(mix(head) + tail + (size.astype(np.uint64) << np.uint64(57)))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of n words within one text."""
        count = len(self.starts) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        acc = np.zeros(count, np.uint64)
        for k in range(n):
            acc = acc * GOLDEN + self.hashes[k : k + count]
        return at, mix(acc)[at]


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (multiply and fold, twice)."""
    x = (x ^ (x >> np.uint64(32))) * GOLDEN
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_class(members: str) -> np.ndarray:
    """Which of the 256 bytes a character class like ``[^\\x00-\\x20]`` has."""
    pattern = re.compile(members.encode())
    return np.array([bool(pattern.match(bytes([b]))) for b in range(256)])


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any of the intervals [start, end)."""
    edges = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(edges[:-1]) > 0


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))
