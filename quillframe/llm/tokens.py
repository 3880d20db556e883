"""Token counts of whole texts, huge ones by overlapping chunks.

A text above ``CHUNK`` characters is encoded in chunks that overlap. In the
overlap both encodings are cut at a boundary that is proven stable, and the
counts up to it and from it on are added. The proof: byte-pair merges only
ever make pieces of the vocabulary, so no merge crosses a place between two
characters that stand side by side in no piece. The text on either side is then
merged independently of the other, wherever a chunk begins or ends. A stable
place must also be a boundary of both encodings; if the overlap has none, it is
doubled and encoded again, up to the end of the text if need be.

Cases: a null or empty text has no bytes and no tokens; texts without any stable
place end up encoded whole; repeated rows are counted each. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import query, raw_texts, table

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk and of the first overlap tried.
CHUNK = 1 << 14
OVERLAP = 256
#: Characters of short texts that are given to the library at once.
BATCH = 1 << 20
LIMIT = 4096
#: The character that stands for a space inside pieces (fixed by the library).
SPACE = "▁"


class PieceCounter:
    """Counts tokens with a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        single = [self.model.is_byte(i) for i in ids]
        self.size = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, single, strict=True)])
        plain = [p for p, b in zip(pieces, single, strict=True) if not b]
        self.joins = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}

    def stable(self, text: str, start: int, end: int):
        """Places in [start, end) that no merge can cross, from the middle on."""
        middle = (start + end) // 2
        for place in (*range(middle, end), *range(middle - 1, start, -1)):
            if text[place - 1 : place + 1] not in self.joins:
                yield place

    def boundaries(self, text: str, start: int, end: int) -> np.ndarray:
        """Ends of the tokens of text[start:end], in bytes from ``start``."""
        ids = np.array(self.model.encode(text[start:end]), np.int64)
        # every encoding begins with a space of its own, which is not in the text
        return np.cumsum(self.size[ids]) - len(SPACE.encode())

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        text = text.replace(" ", SPACE)
        start = total = 0  # of the chunk, and tokens before it
        skipped = -1  # bytes of the chunk that belong to the one before
        while True:
            end = min(len(text), start + chunk + overlap)
            following, reach = end - overlap, overlap
            while True:
                ends = self.boundaries(text, start, end)
                if end == len(text):
                    return total + self._after(ends, skipped)
                cut = self._splice(text, start, end, following, ends, skipped, overlap)
                if cut is not None:
                    break
                reach *= 2
                end = min(len(text), following + reach)
            upto, start, next_skipped = cut
            total += self._after(ends, skipped) - self._after(ends, upto)
            skipped = next_skipped

    @staticmethod
    def _after(ends: np.ndarray, place: int) -> int:
        """Tokens that end behind a place; the own space of a chunk ends at 0."""
        return len(ends) - int(np.searchsorted(ends, place, "right"))

    def _splice(self, text, start, end, following, ends, skipped, overlap) -> tuple[int, int, int] | None:
        """A stable place in [following, end) as bytes from the chunk's start, where the
        next chunk starts, and the place as bytes from there. The next chunk starts an
        overlap before the place at most, so a widened stretch is never encoded again."""
        codes = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), "<u4")
        size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size)])
        for place in self.stable(text, following, end):
            here = int(at[place - start])
            if here <= skipped or not self._ends_at(ends, here):
                continue
            first = max(following, place - overlap)
            there = here - int(at[first - start])
            if self._ends_at(self.boundaries(text, first, min(end, place + overlap)), there):
                return here, first, there
        return None

    @staticmethod
    def _ends_at(ends: np.ndarray, place: int) -> bool:
        i = np.searchsorted(ends, place)
        return bool(i < len(ends) and ends[i] == place)

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        out, short, size = [0] * len(texts), [], 0

        def flush():
            for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
                out[i] = len(ids)
            short.clear()

        for i, text in enumerate(texts):
            if len(text) > chunk + overlap:
                out[i] = self.count_long(text, chunk, overlap)
                continue
            short.append(i)
            size += len(text)
            if size > BATCH:
                flush()
                size = 0
        flush()
        return out


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_count(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Tokens of each text under the model at ``path``."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        decoded = [raw.decode() for raw in raw_texts(texts)]
        return pa.array(counter(path).counts(decoded, chunk, overlap), pa.int64())

    return count.asNondeterministic()(text)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    counted = docs.select(
        F.col(key).alias("doc_id"), size.alias("n_bytes"), token_count(F.col(text), path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(MODEL)))
