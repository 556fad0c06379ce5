"""Helpers shared by the operators: Arrow mapping, vocabulary files, word hashes of whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch; no shuffle."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column with null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read by the driver; vocabularies have a fixed size of a few MB."""
    with open(path, "rb") as f:
        return f.read()


def id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# --- hashes of all words of a batch of texts -------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240607)
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = CODES.copy()
FOLDED[65:91] = CODES[97:123]  # A-Z hash as a-z
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^j and BASE^-j modulo 2^64 for j < n; arrays grow as needed."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", BASE), ("down", INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[key] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Words ([^ \\t-\\r]+, with A-Z folded) of a list of texts.

    data: all bytes, each text followed by a space; start, end: byte positions of words; doc: index of each word's text;
    first: index of each text's first word (one more entry at the end); hash: 64-bit hash of each word.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.offset = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        white = WHITE[self.data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(self.data) and not white[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = powers(len(self.data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(FOLDED[self.data] * up[:-1], dtype=np.uint64)])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words and the index of each gram's first word; grams don't cross texts."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - n + 1
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * np.uint64(BASE) + h[i : i + m]
        inside = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(out[inside]), inside

    def whole(self, i: int) -> int:
        """Hash of the whole word sequence of text i."""
        out = 0
        for x in self.hash[self.first[i] : self.first[i + 1]].tolist():
            out = (out * BASE + x) & MASK64
        return out


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """An ordered key of each row: doc_id and, only where some doc_id repeats, a digest of the text (else 0)."""
    again = docs.groupBy(F.col(doc_id).cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND d IS NOT NULL").limit(1).count()
    digest = F.coalesce(F.xxhash64(text), F.lit(0)) if again else F.lit(0).cast("long")
    return F.struct(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("x"))
