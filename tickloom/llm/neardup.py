"""MinHash near-duplicates with sequential Bayesian verification.

1. One narrow pass over the texts gives each document a digest of its word sequence, the size of its shingle set and the
   keys of 32 bands of 4 minima; a pair of similarity 0.8 shares none of them with probability 5e-8. Equal sequences
   collapse to their smallest doc_id before anything is paired.
2. In each bucket the member with the most company in all its buckets leads. Buckets of one leader are one cluster, and pairs go
   from leaders to their clusters only, so a group of m copies makes m pairs. Only documents in shared buckets
   get their sets and signatures kept.
3. Candidate signatures are compared 32 minima at a time. With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1)
   posterior; a pair is pruned once P(similarity >= threshold) falls below `miss`. Survivors are decided on their full sets.
4. Documents of a cluster that are not linked to its leader are compared with each other and with those that are, in blocks
   of BLOCK x BLOCK documents inside tasks. A block prunes by the same posterior, decides on full sets, and returns only
   links that join what isn't joined there yet, never all pairs.
5. Links become components by alternating stars.

Null and empty texts, and texts without words, have the size 0 and are linked with nothing. A text of fewer words than a
shingle has its whole sequence as its only one. Rows of equal doc_id are one node with the links of all of them; a row of
null doc_id is linked with nothing and kept. Other columns are dropped. Nothing is capped: buckets of any size are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import MASK64, Words, id_text, map_arrow, mix, texts_of, tune
from tickloom.llm.graph import components
from tickloom.session import materialize

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
BATCH = 32
BLOCK = 256
COLUMNS = 8192
GROUP_CHARS = 1 << 18
_rng = np.random.default_rng(77)
FACTORS = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each text a digest of its word sequence (None without words) and the sorted distinct hashes of its shingles."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < GROUP_CHARS):
            size += len(texts[last])
            last += 1
        w = Words(texts[first:last])
        grams, at = w.grams(words)
        border = np.searchsorted(at, w.first)
        for i in range(last - first):
            a, b = w.first[i], w.first[i + 1]
            if a == b:
                yield None, np.zeros(0, np.uint64)
            else:
                digest = hashlib.blake2b(w.hash[a:b].tobytes(), digest_size=16).digest()
                if b - a < words:
                    yield digest, np.array([(w.whole(i) * 31 + int(b - a)) & MASK64], np.uint64)
                else:
                    yield digest, np.unique(grams[border[i] : border[i + 1]])
        first = last


def signature(shingles: np.ndarray) -> bytes:
    out = np.full(SIZE, MASK64, np.uint64)
    for i in range(0, len(shingles), 2048):
        h = np.multiply.outer(FACTORS, shingles[i : i + 2048])
        h += SHIFTS[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4").tobytes()


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of minima compared, the fewest matches that leave the posterior of similarity >= threshold at `miss` or more.

    P(Beta(m + 1, n - m + 1) >= t) is the chance of at most m successes in n + 1 trials of chance t."""
    out = {}
    for n in range(BATCH, SIZE + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                out[n] = m
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of two signature arrays survive all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, fewest in least.items():
        matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
        alive = alive[matches[alive] >= fewest]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def keys_of(sig: bytes) -> np.ndarray:
    """One 64-bit key for each band."""
    m = np.frombuffer(sig, "<u4").reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return out.view(np.int64)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, over the hashes that both lists have."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(both), COLUMNS):
        some = both[first : first + COLUMNS]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(some)), np.float32)
            for i, s in enumerate(sets):
                s = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], side="right")]
                at = np.searchsorted(some, s)
                m[i, at[some[np.minimum(at, len(some) - 1)] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


class Joiner:
    """Union-find over components within one block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _verified(pairs: DataFrame, data: DataFrame, percent: int, least: dict[int, int]) -> DataFrame:
    """The pairs (a, b) that sizes and posteriors leave and full sets confirm. data: doc_id, n, sig, set."""
    side = lambda x: data.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def prune(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SIZE) for c in ("sig_a", "sig_b"))
        return batch.select(["a", "b"]).filter(pa.array(plausible(a, b, least)))

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep))

    left = map_arrow(rows.select("a", "b", "sig_a", "sig_b"), prune, "a long, b long")
    sets = lambda x: data.select(F.col("doc_id").alias(x), F.col("set").alias(f"set_{x}"))
    return map_arrow(left.join(sets("b"), "b").join(sets("a"), "a").select("a", "b", "set_a", "set_b"), decide, "a long, b long")


def _rest(clusters: DataFrame, links: DataFrame, data: DataFrame, percent: int, least: dict[int, int]) -> DataFrame:
    """Links within clusters of documents that aren't linked to the leader; clusters: leader, doc_id; links: a (the leader), b."""
    linked = links.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), F.lit(True).alias("in_main")).distinct()
    known = materialize(clusters.join(linked, ["leader", "doc_id"], "left").select("leader", "doc_id", F.coalesce("in_main", F.lit(False)).alias("in_main")))
    # tables that an aggregate makes are written before they are joined back, so that hot keys of the join can be split
    sizes = known.groupBy("leader").agg(F.ceil(F.count_if("in_main") / BLOCK).cast("int").alias("mains"), F.ceil(F.count_if(~F.col("in_main")) / BLOCK).cast("int").alias("rests"), F.count(F.lit(1)).alias("all"))
    rows = known.join(materialize(sizes.filter("rests > 0 AND all > 1").drop("all")), "leader").withColumn("comp", F.when(F.col("in_main"), F.col("leader")).otherwise(F.col("doc_id")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    # block pairs (x, y): x is a block of the rest; y one of those linked to the leader (negative) or of the rest
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.struct(F.least(r, F.col("own")).alias("x"), F.greatest(r, F.col("own")).alias("y")))
    with_main = F.transform(F.slice(F.sequence(F.lit(0), F.col("mains")), F.lit(2), F.col("mains")), lambda m: F.struct(F.col("own").alias("x"), (-m).alias("y")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.struct(r.alias("x"), (-F.col("own") - 1).alias("y")))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("in_main"), from_main).otherwise(F.concat(with_rest, with_main))))
    rows = rows.select("leader", "pair.x", "pair.y", F.when(F.col("in_main"), -F.col("own") - 1).otherwise(F.col("own")).alias("own"), "doc_id", "comp").join(data, "doc_id")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].iloc[0], rows["y"].iloc[0]
        a, b = rows[rows["own"] == x], rows[rows["own"] == y]
        out, joined = [], Joiner()
        if len(a) and len(b):
            sets = [[np.frombuffer(s, np.uint64) for s in side["set"]] for side in (a, b)]
            sigs = [np.frombuffer(b"".join(side["sig"]), "<u4").reshape(-1, SIZE) for side in (a, b)]
            n, comp, ids = ([side[c].to_numpy() for side in (a, b)] for c in ("n", "comp", "doc_id"))
            shared = intersections(*sets)
            for i in range(len(a)):
                j = np.flatnonzero((comp[1] != comp[0][i]) & (100 * shared[i] >= percent * (n[0][i] + n[1] - shared[i])))
                if len(j):
                    for k in j[plausible(np.repeat(sigs[0][i : i + 1], len(j), 0), sigs[1][j], least)]:
                        if joined.join(comp[0][i], comp[1][k]):
                            out.append((ids[0][i], ids[1][k]))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("leader", "x", "y").applyInPandas(block, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    tune(docs.sparkSession)
    least = least_matches(percent / 100, miss)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [(d, len(s), keys_of(signature(s)) if len(s) else None) for d, s in shingle_sets(texts_of(batch), words)]
        digest, n, keys = zip(*made, strict=True)
        return pa.record_batch([batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "keys"])

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for _, s in shingle_sets(texts_of(batch), words)]
        return pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                               ["doc_id", "n", "sig", "set"])

    signed = materialize(map_arrow(id_text(docs), sign, "doc_id long, digest binary, n long, keys array<long>"))
    usable = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    copies = materialize(usable.select("doc_id", "digest").join(first, "digest").filter("doc_id <> rep"))
    keyed = usable.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", F.explode("keys").alias("key"))
    full = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = materialize(keyed.join(full, "key"))
    weights = members.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("weight"))
    lead = members.join(weights, "doc_id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("least"))).alias("m")).select("key", (-F.col("m.least")).alias("leader"))
    clusters = materialize(members.join(materialize(lead), "key").filter("doc_id <> leader").select("leader", "doc_id").distinct())
    wanted = clusters.select("doc_id").unionAll(clusters.select("leader")).distinct()
    data = materialize(map_arrow(id_text(docs).join(wanted, "doc_id", "left_semi"), describe, "doc_id long, n long, sig binary, set binary").filter("n > 0"))
    links = materialize(_verified(clusters.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), data, percent, least))
    more = materialize(_rest(clusters, links, data, percent, least))
    comps = components(links.unionAll(more).unionAll(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(comps, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
