"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a whole text are its words, trigrams of byte classes (which show layout, case and punctuation in any language) and how its
words repeat their neighbours, hashed to fixed bins. Each block is log-scaled and normalised; a truncated singular value
decomposition of labelled texts gives the latent space. A document's vector meets all labelled vectors in blocked
products (both sides unit length, so these are cosines, in double precision); the NEIGHBOURS largest, and all that tie with the last of
them, vote with a power of their similarity.

The labelled side is a bounded sample: at most PER_CLASS rows of each label, those whose id hashes lowest. It has a fixed
size (PER_CLASS * 2 vectors of RANK numbers, and the basis), so it is broadcast. Labels, language, source and id are no inputs
of a score: labelled texts equal to the scored one have no vote, whatever their ids, so a row's own label doesn't vote for it, and
equal texts have equal scores. Null text counts as empty; a text without terms has no similarity to
anything and gets the share of label 1 in the sample. Rows repeat as they are. Without labelled rows every score is 0.5.
Labels that are null or not 0 or 1, null ids and ids without a text are no labels; an id with several labels counts by its smallest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WHITE, Words, id_text, map_arrow, texts_of

PER_CLASS = 2000
RANK, NEIGHBOURS, POWER = 48, 15, 8
WORD_BINS, SHAPE_BINS = 1024, 2048
BINS = WORD_BINS + SHAPE_BINS + 4
BLOCK_BYTES = 1 << 20
VOTERS = 32


def byte_classes() -> np.ndarray:
    """Lower and upper letters, digits, bytes of non-ASCII characters, white space but the line feed; any other byte is its own class."""
    out = np.arange(256, dtype=np.uint64)
    out[WHITE] = 32
    out[10] = 10
    out[48:58], out[65:91], out[97:123], out[128:] = 48, 65, 97, 97
    return out


CLASSES = byte_classes()


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def features(texts: list[str]) -> np.ndarray:
    """A row of BINS numbers for each text."""
    w, n = Words(texts), len(texts)
    out = np.zeros((n, BINS), np.float32)
    if not len(w.hash):
        return out
    bins = (w.hash >> np.uint64(40)).astype(np.int64) % WORD_BINS
    out[:, :WORD_BINS] = np.bincount(w.doc * WORD_BINS + bins, minlength=n * WORD_BINS).reshape(n, -1)
    c = CLASSES[w.data]
    # runs of lower-case letters count as one, so that trigrams see borders of words and not their lengths
    run = np.concatenate([[True], (c[1:] != c[:-1]) | (c[1:] != 97)])
    at = np.flatnonzero(run)
    c = c[at]
    if len(c) > 2:
        doc = np.searchsorted(w.offset, at, side="right") - 1
        gram = ((c[:-2] << np.uint64(16) | c[1:-1] << np.uint64(8) | c[2:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        inside = doc[:-2] == doc[2:]
        bins = gram[inside].astype(np.int64) % SHAPE_BINS
        out[:, WORD_BINS : WORD_BINS + SHAPE_BINS] = np.bincount(doc[:-2][inside] * SHAPE_BINS + bins, minlength=n * SHAPE_BINS).reshape(n, -1)
    if len(w.hash) > 1:
        pair = w.doc[1:] == w.doc[:-1]
        same = (w.hash[1:] == w.hash[:-1]) & pair
        out[:, -4] = np.bincount(w.doc[1:][same], minlength=n)
        out[:, -3] = np.bincount(w.doc[1:][pair & ~same], minlength=n)
    for a, b, weight, log in ((0, WORD_BINS, 0.5, True), (WORD_BINS, WORD_BINS + SHAPE_BINS, 1.0, True), (BINS - 4, BINS, 1.0, False)):
        part = out[:, a:b]
        if log:
            np.log1p(part, out=part)
        part *= weight / np.maximum(np.sqrt((part**2).sum(1, keepdims=True)), 1e-12)
    return out


class Model:
    """basis: BINS x RANK; vectors: unit rows of the labelled sample with digests of their texts and labels."""

    def __init__(self, x: np.ndarray, digests: np.ndarray, labels: np.ndarray):
        rng = np.random.default_rng(11)
        rank = min(RANK, *x.shape) if len(x) else 0
        q = rng.normal(size=(x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
        for _ in range(3 if rank else 0):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        if rank:
            _, _, v = np.linalg.svd(x @ q, full_matrices=False)
            self.basis = (q @ v[:rank].T).astype(np.float64)
        else:
            self.basis = np.zeros((x.shape[1], 1))
        self.digests, self.labels = digests, labels.astype(np.float64)
        self.vectors = self.place(x) if len(x) else np.zeros((0, 1))
        self.prior = float(self.labels.mean()) if len(labels) else 0.5

    def place(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        y = self.place(features(texts).astype(np.float64))
        if not len(self.digests):
            return np.full(len(texts), self.prior)
        digests, k, out = np.array([digest(t) for t in texts]), min(NEIGHBOURS, len(self.digests)), []
        for first in range(0, len(texts), VOTERS):
            near = y[first : first + VOTERS] @ self.vectors.T
            np.maximum(np.round(near, 9, out=near), 0, out=near)  # products of different blocks differ in the last bits
            near[digests[first : first + VOTERS, None] == self.digests] = 0
            near[near < np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]] = 0
            weight = np.power(near, POWER, out=near)
            total = weight.sum(1)
            out.append(np.where(total > 1e-9, weight @ self.labels / np.maximum(total, 1e-300), self.prior))
        return np.clip(np.concatenate(out), 0, 1).round(12)


def groups(texts: list[str]) -> list[slice]:
    """Consecutive texts of about BLOCK_BYTES characters, at most 256."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > BLOCK_BYTES or i - first >= 256):
            out.append(slice(first, i))
            first, size = i, 0
        size += len(t)
    return [*out, slice(first, len(texts))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None) -> Model:
    """The model of a bounded sample of labelled rows; usable: a condition on doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).filter("doc_id IS NOT NULL AND _label IN (0, 1)")
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    parts = [known.filter(F.col("_label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    sample = docs.sparkSession.createDataFrame([(r["doc_id"], r["_label"]) for p in parts for r in p.collect()], "doc_id long, _label int")
    # at most 2 * PER_CLASS pairs of numbers: small enough to send to every task
    rows = id_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "_label", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = texts_of(batch), []
        for part in groups(texts):
            for row in features(texts[part]):
                at = np.flatnonzero(row)
                out.append((at.astype(np.uint16).tobytes(), row[at].tobytes()))
        return pa.record_batch([batch.column("doc_id"), batch.column("_label"), pa.array([digest(t) for t in texts], pa.int64()), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())],
                               ["doc_id", "_label", "digest", "at", "values"])

    made = map_arrow(rows, run, "doc_id long, _label int, digest long, at binary, values binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    x = np.zeros((len(made), BINS), np.float32)
    for i, r in enumerate(made):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    return Model(x, np.array([r["digest"] for r in made], np.int64), np.array([r["_label"] for r in made], np.int64))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (doc_id) and the score of every text; a column of the score's name is replaced."""
    keep = [c for c in keep or ["doc_id"] if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f for f in docs.schema}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"k{i} {fields[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        out = np.concatenate([shared.value.scores(texts[part]) for part in groups(texts)])
        names = [f"k{i}" for i in range(len(keep))]
        return pa.record_batch([*[batch.column(c) for c in names], pa.array(out)], [*names, "score"])

    made = map_arrow(rows, run, f"{schema}, score double")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))
