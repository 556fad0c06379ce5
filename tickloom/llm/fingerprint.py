"""Document fingerprints from prefix polynomial hashes.

`Prefix` holds, for one text, modular prefix sums of c_i * B^i over its code points for two bases modulo 2^31 - 1. Any
span's hash comes from two entries, so equality of spans is answered at once and the longest common extension of two
places is found by binary search. A fingerprint is built on span hashes of all positions: 64 bins keep their smallest
span hash (16 code points long), and likeness is the share of bins that agree; empty bins take over from their neighbour
to the right, in both texts alike. Equal texts have equal fingerprints, and spans that move keep their hashes, so an edit
changes only the bins whose minima it touches.

`fingerprint_edits` pairs each document with the next one in order of doc_id: rows are dealt by ranges of doc_id and sorted there;
only the last document of each range meets the first of the next in a second step, joined on the range's number. Rows of
equal doc_id follow each other in order of text; null doc_ids come first. Null text counts as empty. The next document of a
single row is the row itself. Texts shorter than a span are one span; an empty text has a fingerprint of its own. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import id_text, mix, tune
from tickloom.session import materialize

P31 = np.uint64((1 << 31) - 1)
BASES = (911382323, 972663749)
INVERSES = tuple(pow(b, -1, (1 << 31) - 1) for b in BASES)
SPAN, BINS = 16, 64
_powers: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^63; both steps leave at most one multiple too much."""
    x = (x & P31) + (x >> np.uint64(31))
    x = (x & P31) + (x >> np.uint64(31))
    return np.where(x >= P31, x - P31, x)


def powers(base: int, n: int) -> np.ndarray:
    """base^i modulo 2^31 - 1 for i < n, grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = _powers[base] = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), int(P31)))
        have = _powers[base] = np.concatenate([have, _mod(have * step)])
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    def __init__(self, codes: np.ndarray, like: Prefix | None = None, same: int = 0):
        """like: the prefix of a text with the same first `same` code points, whose sums are taken over."""
        self.n = len(codes)
        c = codes[same:].astype(np.uint64) + np.uint64(1)
        self.sums = []
        for i, base in enumerate(BASES):
            terms = c * powers(base, self.n)[same:]
            terms = (terms & P31) + (terms >> np.uint64(31))  # below 2^32, so 2^31 of them sum without overflow
            head = like.sums[i][: same + 1] if like else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([head, _mod(np.cumsum(terms, dtype=np.uint64) + head[-1])]))

    def spans(self, length: int, start: int = 0) -> np.ndarray:
        """Hashes of all spans of a length that begin at `start` or later, from two entries of the first array each."""
        s, last = self.sums[0], self.n - length + 1
        at = powers(INVERSES[0], last)[start:]
        return mix(_mod((s[start + length :] + P31 - s[start:last]) * at))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """The hash of one span."""
        p = int(P31)
        return tuple((int(s[start + length]) - int(s[start])) * pow(inverse, start, p) % p for inverse, s in zip(INVERSES, self.sums, strict=True))


def equal_spans(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    return a.span(i, length) == b.span(j, length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """The longest common extension to the right of place i of a text and place j of another."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


FIRST = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
NONE = ~np.uint64(0)


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; a bin is the top six bits."""
    h = np.append(np.sort(h), NONE)
    out = h[np.searchsorted(h, FIRST)]
    return np.where(out >> np.uint64(58) == np.arange(BINS, dtype=np.uint64), out, NONE)


def sketch(smallest: np.ndarray) -> np.ndarray:
    """The bins' minima, cut to 32 bits."""
    out = ((smallest >> np.uint64(26)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    filled = smallest != NONE
    if not filled.any():
        return np.zeros(BINS, np.uint32)
    if not filled.all():
        at = np.flatnonzero(filled)
        take = at[np.searchsorted(at, np.arange(BINS)) % len(at)]
        out = np.where(filled, out, out[take] * np.uint32(2654435761) + np.arange(BINS, dtype=np.uint32))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def text_of(codes: np.ndarray) -> bytes:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
          ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64())]
EDGE = [("_range", pa.int32()), ("_edge", pa.string()), ("text", pa.string())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_edited long"


class Row:
    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.codes = doc_id, code_points(text or "")
        n = self.n = len(self.codes)
        self.prefix = Prefix(self.codes)
        self.kept = n - n // 4
        self.length = min(SPAN, n)
        hashes = self.prefix.spans(self.length) if n else np.zeros(0, np.uint64)
        self.inside = max(0, self.kept - self.length + 1)  # spans inside the part that an edit keeps
        self.low = minima(hashes[: self.inside])
        self.sketch = sketch(np.minimum(self.low, minima(hashes[self.inside :])))

    def against(self, following: Row) -> tuple:
        codes = np.concatenate([self.codes[: self.kept], following.codes[: self.n // 4]])
        prefix = Prefix(codes, self.prefix, self.kept)
        if prefix.n < SPAN:
            low = minima(prefix.spans(prefix.n)) if prefix.n else self.low
        else:  # then the text itself has as many code points
            low = np.minimum(self.low, minima(prefix.spans(SPAN, self.inside)))
        other = sketch(low)
        return (self.doc_id, self.n, hashlib.sha256(text_of(codes)).digest(), self.sketch.astype(">u4").tobytes(), other.astype(">u4").tobytes(),
                likeness(self.sketch, other), likeness(self.sketch, following.sketch), common_extension(self.prefix, 0, prefix, 0))


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def fingerprint_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited (length of the prefix
    that text and edited text share)."""
    spark = docs.sparkSession
    tune(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their next one in the range; the first row, and the last row that still lacks its next, as texts."""
        number, last, nothing = TaskContext.get().partitionId(), None, (None,) * len(FIELDS)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row = Row(doc_id, text)
                if last is None:
                    rows.append((doc_id, *nothing[1:], number, "first", text or ""))
                else:
                    rows.append((*last.against(row), number, None, None))
                last = row
            if rows:
                yield _batch(rows, FIELDS + EDGE)
        if last is not None:
            yield _batch([(last.doc_id, *nothing[1:], number, "last", last.codes.tobytes().decode("utf-32-le", "surrogatepass"))], FIELDS + EDGE)

    made = materialize(ordered.mapInArrow(run, SCHEMA + ", _range int, _edge string, text string"))
    edges = made.filter("_edge IS NOT NULL").select("_range", "_edge", "doc_id", "text")
    # one number for each range: its place among the ranges that have rows
    places = edges.filter("_edge = 'first'").select("_range").withColumn("_no", F.row_number().over(Window.orderBy("_range")) - 1)
    total = places.agg(F.count(F.lit(1)).alias("_of"))
    edges = edges.join(places, "_range")
    lasts = edges.filter("_edge = 'last'").join(F.broadcast(total)).select(((F.col("_no") + 1) % F.col("_of")).alias("_no"), "doc_id", "text")
    firsts = edges.filter("_edge = 'first'").select("_no", F.col("text").alias("next_text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")]
            if batch.num_rows:
                yield _batch([Row(i, t).against(Row(None, x)) for i, t, x in zip(*cols, strict=True)], FIELDS)

    closed = lasts.join(firsts, "_no").select("doc_id", "text", "next_text").mapInArrow(close, SCHEMA)
    out = made.filter("_edge IS NULL").select(*[n for n, _ in FIELDS]).unionByName(closed)
    return out.select(*[F.lower(F.hex(n)).alias(n) if k == pa.binary() else F.col(n) for n, k in FIELDS])
