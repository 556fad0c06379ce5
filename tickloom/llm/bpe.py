"""Byte-level BPE: a SentencePiece model written straight from the ranks, used to encode and to decode.

Every token becomes a piece whose characters stand for its bytes, scored by its negative rank, so the library's merge
order (best score, leftmost first) is the merge order of the ranks. Normalisation is the identity. Each match of the
pre-token pattern is encoded separately; decoding maps the pieces' characters back to bytes. The stage is a narrow map:
no shuffle, one bounded memo of pre-tokens for each Python worker, the vocabulary broadcast (a file of fixed size).

Null text counts as empty: no tokens, digests of no bytes. Rows repeat as they are; other columns are dropped. A row's
doc_id may be null.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import id_text, map_arrow, read_bytes, texts_of

MEMO = 400_000
GROUP_CHARS = 1 << 20


def byte_characters() -> list[str]:
    """One printable character for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks; one id more is the unknown piece, which no text reaches."""
    char = byte_characters()
    size = max(ranks.values(), default=-1) + 1
    by_rank: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        by_rank[rank] = token
    out = []
    for rank, token in enumerate(by_rank):
        piece = f"{rank}" if token is None else "".join(char[b] for b in token)
        kind = b"" if token is not None else b"\x18\x05"  # 5: unused
        out.append(_field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank)) + kind))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02"))
    trainer = b"\x18\x02" + b"\x20" + _varint(size + 1) + b"\xc0\x02" + _varint(size)  # BPE, vocab_size, unk_id
    normalizer = _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with a model that it makes from a rank file."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(data)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(pattern).findall
        char = byte_characters()
        self.table = {b: char[b] for b in range(256)}
        back = {c: b for b, c in enumerate(char)}
        self.piece_bytes = [bytes(back.get(c, 63) for c in self.model.id_to_piece(i)) for i in range(self.model.vocab_size())]
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        rest, raw = [], []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(b)) is not None:
                self.memo[w] = struct.pack("<I", rank)
            else:
                rest.append(w)
                raw.append(b.decode("latin-1").translate(self.table))
        for w, ids in zip(rest, self.model.encode(raw, num_threads=1) if raw else [], strict=True):
            self.memo[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; learns the new pre-tokens of about GROUP_CHARS at once."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and size < GROUP_CHARS:
                group.append(self.find(texts[i]))
                size += len(texts[i])
                i += 1
            if len(self.memo) > MEMO:
                self.memo.clear()
            if new := {w for words in group for w in words if w not in self.memo}:
                self._learn(new)
            get = self.memo.__getitem__
            out += [b"".join(map(get, words)) for words in group]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (hashlib.md5(data).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of long), decoded (binary) of every text."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(data.value, pattern)
        ids = c.encode(texts_of(batch))
        return pa.record_batch([batch.column("doc_id"), pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())),
                                pa.array([c.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(id_text(docs), run, "doc_id long, ids array<long>, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with its arrays digested where they are made."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(data.value, pattern)
        rows = []
        for ids in c.encode(texts_of(batch)):
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        n, a, b = zip(*rows, strict=True)
        return pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
