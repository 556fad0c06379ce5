"""Packing of tokenised documents into sequences by exact complements.

Documents are tokenised once, closed with an end id, and cut only where longer than a sequence. What is planned is the
histogram of piece lengths (at most `capacity` numbers, whatever the corpus size): a plan is a list of patterns, each a
tuple of lengths and how often it is used. A pattern starts with the longest piece left; singles, pairs and triples of
lengths whose sum is exactly the gap are looked up in an index of sums and consumed as often as their counts allow; where
none fills the gap, the best-fitting piece goes in and the rest of the gap is looked up again. Every pattern uses up at
least one length, so a plan has a bounded number of patterns. Pieces take the plan's slots by their rank within their
length: ranks come from counts by task and length, so no length is sorted or gathered in one task.

Null text counts as empty (its end id alone is a piece of one token). Repeated rows and rows of null doc_id are packed as
rows of their own; other columns are dropped. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import id_text, map_arrow, mix, powers, read_bytes, texts_of
from tickloom.session import materialize

MEMO = 600_000
GROUP_CHARS = 1 << 18
#: Below this code point characters are told apart by tables; none of them combines with its neighbours.
LATIN = 0x250
BLANK, LETTER, DIGIT, OTHER, ODD = range(5)


def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character below LATIN. ODD: white space other than blank and line feed, what a contraction or
    a special token begins with, and what lower case makes longer."""
    kinds, lower = np.full(LATIN + 1, ODD, np.uint8), np.arange(LATIN + 1, dtype=np.uint32)
    for i in range(LATIN):
        c = chr(i)
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
        k = unicodedata.category(c)[0]
        kinds[i] = BLANK if c in " \n" else ODD if c in "\t\v\f\r\x85\xa0'<" or len(c.lower()) > 1 or lower[i] >= LATIN else LETTER if k == "L" else DIGIT if k == "N" else OTHER
    return kinds, lower


KINDS, LOWER = _latin_tables()


class WordTokenizer:
    """Token ids of whole texts, as the library gives them, by a bounded memo of words.

    Of this tokenizer's steps none looks past a blank or line feed, so the ids of a text are those of its strings in turn.
    Strings of plain Latin characters fall into words as the file's pattern says (runs of letters, single digits, runs of
    anything else); a string with any other character is one word here and goes to the library as it is. Words are found
    and looked up by 64-bit hashes for about GROUP_CHARS of text at once; the library encodes the new ones.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _find(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of a text."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(code, LATIN)
        kind = KINDS[low]
        blank = kind == BLANK
        edge = np.concatenate([[True], blank[1:] != blank[:-1]])
        string = np.cumsum(edge) - 1
        odd = np.zeros(string[-1] + 1, bool)
        odd[string[kind == ODD]] = True
        begins = edge | (np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)]) & ~odd[string])
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(code))
        keep = ~blank[starts]
        starts, ends = starts[keep], ends[keep]
        plain = np.where(low < LATIN, LOWER[low], code)
        up, down = powers(len(code) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(plain.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        return starts, ends, mix((total[ends] - total[starts]) * down[starts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            first, size = i, 0
            while i < len(texts) and (i == first or size + len(texts[i]) < GROUP_CHARS):
                size += len(texts[i])
                i += 1
            out += self._group(texts[first:i])
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        text = "\n".join(texts) + "\n"
        starts, ends, hashes = self._find(text)
        if not len(starts):
            return [b""] * len(texts)
        if len(self.keys) > MEMO:
            self.reset()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        if not known.all():
            new = first[~known]
            found = self.tokenizer.encode_batch_fast([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], add_special_tokens=False)
            ids = [e.ids for e in found]
            n = np.array([len(x) for x in ids], np.int64)
            at = np.cumsum(n) - n + len(self.ids)
            self.ids = np.concatenate([self.ids, np.array([t for x in ids for t in x], np.uint32)])
            keys = np.concatenate([self.keys, unique[~known]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.n = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]
            place = np.searchsorted(self.keys, unique)
        at, n = self.at[place][inverse], self.n[place][inverse]
        behind = np.cumsum(n)
        ids = self.ids[np.repeat(at - behind + n, n) + np.arange(behind[-1])].astype("<u4").tobytes()
        lengths = np.array([len(t) + 1 for t in texts])
        border = np.searchsorted(starts, np.cumsum(lengths))
        cuts = 4 * np.concatenate([[0], np.concatenate([[0], behind])[border]])
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_tokenizers: dict[bytes, WordTokenizer] = {}


def word_tokenizer(data: bytes) -> WordTokenizer:
    key = hashlib.md5(data).digest()
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(data)
    return _tokenizers[key]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for), with the task that made the row and its rank there among pieces of its length."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))
    end = np.array([end_id], "<u4").tobytes()

    seen: dict[int, Counter] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        context = TaskContext.get()
        ranks = seen.setdefault(context.taskAttemptId(), Counter())
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), word_tokenizer(data.value).encode(texts_of(batch)), strict=True):
            ids += end
            for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[at : at + 4 * capacity]
                n = len(piece) // 4
                rows.append((doc_id, no, at // 4, n, zlib.crc32(piece), context.partitionId(), ranks[n], piece if keep_ids else None))
                ranks[n] += 1
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank", "ids"]
        n = len(names) if keep_ids else len(names) - 1
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long" + ", ids binary" * keep_ids
    return map_arrow(id_text(docs), run, schema)


# --- the plan ------------------------------------------------------------------------------------------------------------


class Lengths:
    """Counts of the pieces left, with an index of the sums of one, two and three lengths (bit s: there may be such a sum).
    Sums go stale only by being gone, so the index is renewed now and then and every find is checked."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        self.bits = self.mirror = 0  # mirror: bit capacity - length
        for n, c in counts.items():
            self.add(n, c)
        self.age = 0
        self.index()

    def add(self, n: int, c: int) -> None:
        self.left[n] += c
        if self.left[n]:
            self.bits |= 1 << n
            self.mirror |= 1 << self.capacity - n
        else:
            self.bits &= ~(1 << n)
            self.mirror &= ~(1 << self.capacity - n)

    def index(self) -> None:
        keep = (1 << self.capacity + 1) - 1
        self.pairs = self.triples = 0
        n, rest = 0, self.bits
        lengths = []
        while rest:
            low = (rest & -rest).bit_length() - 1
            lengths.append(low)
            rest &= rest - 1
        for n in lengths:
            self.pairs |= self.bits << n
        self.pairs &= keep
        for n in lengths:
            self.triples |= self.pairs << n
        self.triples &= keep

    def largest(self, most: int) -> int:
        return (self.bits & ((1 << most + 1) - 1)).bit_length() - 1

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths left that sum to the gap: those with the most pieces left of the first found."""
        if not self.pairs >> gap & 1:
            return None
        # bit n of hits: lengths n and gap - n are left
        hits = self.bits & (self.mirror >> self.capacity - gap if gap <= self.capacity else 0)
        hits >>= (gap + 1) // 2
        best, found = 0, None
        for _ in range(8):
            if not hits:
                break
            n = (hits & -hits).bit_length() - 1 + (gap + 1) // 2
            hits &= hits - 1
            c = min(self.left[n], self.left[gap - n]) if 2 * n != gap else self.left[n] // 2
            if c > best:
                best, found = c, (n, gap - n)
        return found

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        if not self.triples >> gap & 1:
            return None
        n = self.largest(gap - 2)
        while n > 0 and 3 * n >= gap:
            self.add(n, -1)
            two = self.pair(gap - n)
            self.add(n, 1)
            if two:
                return (n, *two)
            n = self.largest(n - 1)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that sum to at most the capacity, with their numbers; together they use every piece once."""
    left, out = Lengths(counts, capacity), []
    while left.bits:
        first = left.largest(capacity)
        pattern, gap = [first], capacity - first
        left.add(first, -1)
        while gap:
            more = left.exact(gap)
            if more is None:
                best = left.largest(gap)
                if best < 1:
                    break
                more = (best,)
            for n in more:
                left.add(n, -1)
            pattern += more
            gap -= sum(more)
        times = 1 + min(left.left[n] // m for n, m in Counter(pattern).items())
        for n in pattern:
            left.add(n, 1 - times)
        out.append((tuple(sorted(pattern, reverse=True)), times))
        left.age += 1
        if left.age % 256 == 0:
            left.index()
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, offset): piece `rank` of a length goes to sequence + (rank - first rank) at the offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id, keep_ids))
    by_task = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    by_task = materialize(by_task)
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_task", "_before")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = table.value
        key = slot[:, 0] << 44 | slot[:, 1]
        length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
        at = np.searchsorted(key, length << 44 | rank, side="right") - 1
        columns = {c: batch.column(c) for c in out_names[:-2]} | {"sequence_id": slot[at, 2] + rank - slot[at, 1], "offset": slot[at, 3]}
        return pa.record_batch([pa.array(columns[c]) if isinstance(columns[c], np.ndarray) else columns[c] for c in out_names], out_names)

    out_names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]
    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long")
