"""Importance resampling of documents towards a target distribution, over hashed word features.

1. Every map task counts the buckets of its features in one array and emits its non-zero counts, so the shuffle holds at most
   `buckets` rows a task. The counts of all documents and all target texts give one integer gain a bucket.
2. A second pass sums gains by bucket (an array of fixed size is sent to the tasks) and adds the row's own noise; its narrow
   rows are written once.
3. The cutoff is found by bisection over (score, doc_id, row): each job counts, exactly and over all rows, how many lie above
   SECTIONS thresholds at once. Selected rows are dealt by range of that order; a rank is a row's place in its range plus
   the rows of the ranges before. Nothing is sorted or held in one task.

Features are runs of 1 to 3 words, joined by one blank; the bucket is the crc32 of the bytes modulo `buckets`. As a crc is linear, the
crc of a run follows from those of its words. Null texts and texts without words have no features and weight 0. A null
doc_id hashes as the empty string and comes last in ties; rows of equal doc_id are separate documents, their further ties fall by a
row number given when the scores are written. Texts of any length are read whole. Other columns are dropped. An empty table has no rows; an empty
target has counts of 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import map_arrow, tune
from tickloom.session import materialize

BUCKETS, SECTIONS = 10_000, 15
#: Letters A-Z to a-z; a-z, 0-9 and all bytes of other code points stay; the rest separates words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_tables: list[np.ndarray] = []


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def _advance(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shift_tables() -> list[np.ndarray]:
    """For each of the four digits (base 256) of a length, tables that move a crc over that many zero bytes: [digit value, byte of the crc, its value]."""
    if not _tables:
        byte = np.arange(256, dtype=np.uint32)
        one = np.zeros((4, 256), np.uint32)
        step = byte.copy()  # the register after one zero byte, for a register of one low byte
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0)).astype(np.uint32)
        one[0] = step
        for k in range(1, 4):
            one[k] = byte << np.uint32(8 * (k - 1))
        for _ in range(4):
            table = np.zeros((256, 4, 256), np.uint32)
            for k in range(4):
                table[0, k] = byte << np.uint32(8 * k)
            for n in range(1, 256):
                table[n] = _advance(one, table[n - 1])
            _tables.append(table)
            one = _advance(one, table[255])  # 256 times the step
    return _tables


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crcs moved over `length` bytes: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    for digit, table in enumerate(shift_tables()):
        n = length >> (8 * digit) & 255
        if digit and not n.any():
            continue
        crc = table[n, 0, crc & 255] ^ table[n, 1, crc >> 8 & 255] ^ table[n, 2, crc >> 16 & 255] ^ table[n, 3, crc >> 24]
    return crc


def feature_crcs(words: list[bytes]) -> np.ndarray:
    """crc32 of all runs of 1 to 3 words."""
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    if len(words) < 2:
        return one
    blank = np.uint32(zlib.crc32(b" "))
    after = shift(np.full(len(words), blank, np.uint32), length) ^ one  # crc of a blank and the word
    two = shift(one[:-1], length[1:] + 1) ^ after[1:]
    three = shift(two[:-1], length[2:] + 1) ^ after[2:]
    return np.concatenate([one, two, three])


def _pieces(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of bounded size (or one text)."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often features of all texts (column text) fall in each bucket."""
    tune(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    total += np.bincount(feature_crcs(words_of(text)) % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in counted.collect():  # at most `buckets` rows
        out[r["bucket"]] = int(r["n"])
    return out


def gains(documents: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares in target and documents)."""
    size, aim = sum(documents), sum(target)
    ratio = lambda s, t: (t + 1) * (size + len(documents)) / ((s + 1) * (aim + len(documents)))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(documents, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, rows = shared.value, []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text or "")
            crcs = feature_crcs(words)
            weight = int(value[crcs % np.uint32(len(value))].sum())
            rows.append((doc_id, len(words), len(crcs), weight, weight + noise(doc_id, seed)))
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "n_words", "n_features", "weight", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, score, "doc_id long, n_words long, n_features long, weight long, score long")


def _cut(rows: DataFrame, column: str, wanted: int) -> tuple[int, int] | None:
    """The smallest value v of a long column so that at most `wanted` rows are below it or equal, and how many are below; None without rows.

    Each job counts SECTIONS thresholds over all rows.
    """
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if ends["a"] is None:
        return None
    low, high, below = int(ends["a"]), int(ends["b"]), 0  # the wanted-th row has a value in [low, high]; `below` rows are < low
    while low < high:
        step = -(-(high - low) // (SECTIONS + 1))
        marks = [m for m in range(low + step - 1, high, step)]
        got = rows.agg(*[F.count_if(F.col(column) <= F.lit(m).cast("long")).alias(f"m{i}") for i, m in enumerate(marks)]).first()
        for m, n in zip(marks, got, strict=True):
            if n >= wanted:
                high = m
                break
            low, below = m + 1, n
    return low, below


def draw(scored: DataFrame, wanted: int) -> tuple[Column, Column]:
    """Which rows are among the `wanted` first by (score falling, doc_id, row), and the complement; scored: score, doc_id, row.

    The order is found one column at a time: the score at the cutoff, the doc_id among rows of this score, the row among rows of both.
    """
    inside, tied, left = F.lit(False), F.lit(True), wanted
    if wanted <= 0:
        return F.lit(False), F.lit(True)
    keyed = {"_s": -F.col("score"), "_null": F.col("doc_id").isNull().cast("long"), "_d": F.coalesce("doc_id", F.lit(0)), "_r": F.col("row")}
    rows = scored.select(*[c.cast("long").alias(k) for k, c in keyed.items()])
    for k in keyed:
        cut, below = _cut(rows, k, left)
        inside = inside | (tied & (keyed[k] < F.lit(cut).cast("long")))
        tied, left = tied & (keyed[k] == F.lit(cut).cast("long")), left - below
        rows = rows.filter(F.col(k) == F.lit(cut).cast("long"))
    chosen = inside | tied
    return chosen, ~chosen


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with `rank`, their place by (score falling, doc_id, row), from ranges of that order."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(before), "range").withColumn("rank", (F.col("place") + F.col("before")).cast("long")).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn. Both frames have a column text."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = materialize(scores(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    pool = scored.filter(able)
    chosen, left = draw(pool, percent * pool.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.filter(~able | left).withColumn("rank", F.lit(None).cast("long"))
    return ranked(pool.filter(chosen)).select(*columns).unionByName(rest.select(*columns))
