"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Each vector gets one more component, so that nearness by inner product is nearness by Euclidean distance among all vectors; the
vector is cut in two halves, each half is quantised by its own codebook, and a cell is a pair of centroids. A query walks the
cells in order of the summed distances of its halves, with a heap over the two sorted lists, until it has met enough
entries; these are reranked by exact inner products of the original vectors in double precision.

What is fitted or measured on a bounded sample: the codebooks (SAMPLE vectors) and the number of entries that a query has to meet (CALIBRATION
queries, compared with all vectors, so that a share `reach` of their true neighbours is met). Every vector is indexed. A first-half list
is dealt in blocks of bounded size, for entries and for queries, so a cell that holds a third of all rows is shared
out; a block returns its best k for a query and the best of these are kept.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no part.
Rows of equal vec_id are separate candidates; equal query ids count once. Ties go to the smaller vec_id. Null ids take no
part. An empty table has no rows; other columns are dropped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import tune
from tickloom.session import materialize

SAMPLE = 8192
CALIBRATION = 128
ENTRY_BLOCK, QUERY_BLOCK = 8192, 2048


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    out = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((out**2).sum(1) - 2 * x @ out.T).argmin(1)
        for c in range(len(out)):
            if (own := near == c).any():
                out[c] = x[own].mean(0)
    return out


class Index:
    """Codebooks of the two halves; the longest norm gives the added component."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], half: int, longest: float):
        self.books, self.half, self.longest = books, half, longest

    def halves(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return x[:, : self.half], np.column_stack([x[:, self.half :], more])

    def distances(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        return [(c**2).sum(1) - 2 * h @ c.T for h, c in zip(self.halves(x, query), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x, False)
        return a.argmin(1).astype(np.int32), b.argmin(1).astype(np.int32)


def walk(d0: np.ndarray, d1: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids in order of the sum of their distances."""
    o0, o1 = d0.argsort(kind="stable").tolist(), d1.argsort(kind="stable").tolist()
    s0, s1 = d0[o0].tolist(), d1[o1].tolist()
    heap, seen = [(s0[0] + s1[0], 0, 0)], {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield o0[a], o1[b]
        for to in ((a + 1, b), (a, b + 1)):
            if to[0] < len(s0) and to[1] < len(s1) and to not in seen:
                seen.add(to)
                heapq.heappush(heap, (s0[to[0]] + s1[to[1]], *to))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest finite scores and of all that come near the last of them."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least - 1e-9 * max(1.0, abs(least))) & np.isfinite(scores))
    else:
        at = np.flatnonzero(np.isfinite(scores))
    return at


def exact_best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest, with correctly rounded inner products; ties to the smaller id."""
    scored = [(-math.fsum(p), i) for p, i in zip((x * q).tolist(), ids.tolist(), strict=True)]
    return [(i, -s) for s, i in heapq.nsmallest(k, scored)]


def _matrix(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest vectors found for each query (columns as those of the vectors), without rows of the query's own id."""
    spark = vectors.sparkSession
    tune(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors, id_col, vector_col)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    total, draw = size["n"], F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = rows.filter(draw < int(min(1.0, 1.1 * SAMPLE / total) * (1 << 30)) + 1).limit(SAMPLE).toPandas()
    if not len(sample):
        sample = rows.limit(SAMPLE).toPandas()
    dim = int(sample["vec"].map(len).mode()[0])
    x = np.stack([np.asarray(v, float) for v in sample["vec"] if len(v) == dim])
    k0 = int(min(256, max(8, math.sqrt(total / 200))))
    index = Index((np.zeros((1, 0)), np.zeros((1, 0))), dim // 2, math.sqrt(size["m"]))
    index.books = tuple(kmeans(h, k0) if h.shape[1] else np.zeros((1, 0)) for h in index.halves(x, False))
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.array(batch.column("vec").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, dim)
                i, j = shared.value.cells(m)
                yield pa.record_batch([batch.column("vec_id"), pa.array(i), pa.array(j), pa.array([v.tobytes() for v in m], pa.binary())], ["vec_id", "i", "j", "vec"])

    entries = materialize(rows.filter(F.size("vec") == dim).mapInArrow(assign, "vec_id long, i int, j int, vec binary"))
    counts = np.zeros((len(index.books[0]), len(index.books[1])), np.int64)
    for r in entries.groupBy("i", "j").count().collect():  # at most 256 x 256 rows
        counts[r["i"], r["j"]] = r["count"]
    asked = valid(queries, id_col, vector_col).filter(F.size("vec") == dim).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id")

    # --- how many entries to meet: a cell counts at most a share, so that one full cell doesn't end a walk
    weight = np.minimum(counts, max(1, total // 64))
    tried = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).toPandas()
    if not len(tried):
        return spark.createDataFrame([], schema)
    tried_ids, tried_x = tried["query_id"].to_numpy(), np.stack([np.asarray(v, float) for v in tried["vec"]])

    def true_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"))
            i, j = (batch.column(c).to_numpy() for c in "ij")
            scores = np.where(tried_ids[:, None] == ids, -np.inf, tried_x @ m.T)
            out = []
            for no, s in enumerate(scores):
                at = np.argsort(-s, kind="stable")[:k]
                out += [(no, s[a], int(i[a]), int(j[a])) for a in at if np.isfinite(s[a])]
            yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.int32(), pa.int32()))], ["no", "s", "i", "j"])

    first = Window.partitionBy("no").orderBy(F.desc("s"))
    near = entries.mapInArrow(true_near, "no int, s double, i int, j int").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).collect()
    d0, d1 = index.distances(tried_x, True)
    needed: list[int] = []
    for no in range(len(tried_x)):
        met, before = 0, {}
        for cell in walk(d0[no], d1[no]):
            before[cell] = met
            met += int(weight[cell])
        needed += [before[r["i"], r["j"]] for r in near if r["no"] == no]
    enough = 1 + int(np.quantile(needed, reach, method="higher")) if needed else 1

    # --- walks: one row for each query and first-half list, with the second halves that it visits there
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.array(batch.column("vec").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, dim)
            a, b = shared.value.distances(m, True)
            out = []
            for no, q in enumerate(batch.column("query_id").to_pylist()):
                met, seen, lists = 0, 0, {}
                for i, j in walk(a[no], b[no]):
                    if met >= enough and seen >= 2 * k:
                        break
                    if counts[i, j]:
                        lists.setdefault(i, []).append(j)
                        met += int(weight[i, j])
                        seen += int(counts[i, j])
                out += [(q, i, np.array(js, np.int32).tobytes(), m[no].tobytes()) for i, js in lists.items()]
            yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["query_id", "i", "js", "vec"])

    probes = materialize(asked.mapInArrow(probe, "query_id long, i int, js binary, vec binary"))
    askers = dict.fromkeys(range(len(counts)), 0) | {r["i"]: r["count"] for r in probes.groupBy("i").count().collect()}
    blocks = F.array(*[F.lit(int(-(-c // ENTRY_BLOCK)) or 1) for c in counts.sum(1)])
    turns = F.array(*[F.lit(int(-(-askers[i] // QUERY_BLOCK)) or 1) for i in range(len(counts))])
    at = lambda a: F.element_at(a, F.col("i") + 1)
    left = probes.withColumn("turn", F.pmod(F.xxhash64("query_id"), at(turns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), at(blocks) - 1)))
    right = entries.withColumn("block", F.pmod(F.xxhash64("vec_id"), at(blocks)).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), at(turns) - 1)))
    width = counts.shape[1]

    def rerank(asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(met):
            ids, j, x = met["vec_id"].to_numpy(), met["j"].to_numpy(), _matrix(met["vec"])
            for first in range(0, len(asked), 128):
                part = asked.iloc[first : first + 128]
                allowed = np.zeros((len(part), width), bool)
                for no, js in enumerate(part["js"]):
                    allowed[no, np.frombuffer(js, np.int32)] = True
                m = _matrix(part["vec"])
                scores = np.where(allowed[:, j] & (part["query_id"].to_numpy()[:, None] != ids), m @ x.T, -np.inf)
                for no, q in enumerate(part["query_id"]):
                    at = best(scores[no], ids, k)
                    out += [(q, i, s) for i, s in exact_best(m[no], x[at], ids[at], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("i", "block", "turn").cogroup(right.groupBy("i", "block", "turn")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
