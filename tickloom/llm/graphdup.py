"""Near-duplicate vectors by range search in a robust-pruned flat graph.

1. Equal vectors are one node. Nodes are dealt to the cells of a codebook (fitted on SAMPLE vectors); a cell of many nodes is cut into parts.
   In each part, nodes within half the linking angle of a first one form a ball: all of a ball are linked with each other for certain, so a
   group of any number of close copies becomes a few balls. What follows works on balls (their pivots, with radius and size).
2. Pivots go to their two nearest cells, so that shards overlap. Each shard is built by itself: the nearest pivots of each are pruned robustly (a neighbour
   goes if a chosen one is nearer to it by SLACK), reversed links are added, and what can't be reached from the medoid is tied to its nearest reachable pivot. The
   flat graph is the union of the lists over shards.
3. Every pivot searches the shards of its nearest cells: greedily from the medoid with a beam, then on through all pivots in range,
   which is the linking angle plus both radii. Links that lead out of the shard are followed in rounds of joins until nothing in range is new.
4. Audit: AUDIT pivots are compared with all pivots. While less than `reach` of their true neighbours was found, all pivots
   search twice as many cells; with all cells the search meets every shard.
5. Verification: of two balls in range, members are counted as a whole where the angles leave no doubt, and compared one by one, in
   blocks, where they do. No pair below the threshold is linked. Components are made over balls.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components link with nothing,
as does a row of null vec_id, whose component is null and which is kept. Rows of equal vec_id are separate vectors; a component's id is its
smallest vec_id. Other columns are dropped; an empty table has no rows. Nothing is capped: lists, parts, blocks and probes bound
tasks, not results. Work on a group grows with its balls squared; vectors that are linked but no nearer to each other than half the
angle are balls of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.ann import kmeans, valid
from tickloom.llm.common import map_arrow, tune
from tickloom.llm.graph import components
from tickloom.session import materialize

SAMPLE, AUDIT = 8192, 4096
SHARD, MAX_CELLS = 2048, 1024
POOL, DEGREE, SLACK, BEAM = 64, 24, 1.2, 32
BLOCK, TURN = 1024, 4096
EPS = 1e-7  # radians; nothing is decided by angles that are nearer than this


def matrix(column) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def balls_of(u: np.ndarray, radius: float) -> np.ndarray:
    """For each row its pivot: the first row, in order, that has no pivot takes all others without one within the radius."""
    pivot, least = np.arange(len(u)), math.cos(radius)
    near = np.zeros(len(u), bool)
    for a in range(0, len(u), 512):
        near[a : a + 512] = (u[a : a + 512] @ u.T >= least).sum(1) > 1
    free = near.copy()
    for i in np.flatnonzero(near):
        if free[i]:
            own = np.flatnonzero(free & (u @ u[i] >= least))
            pivot[own], free[own], free[i] = i, False, False
    return pivot


def prune(u: np.ndarray, pool: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Of each row's pool (indices, -1 for none) the robustly pruned neighbours, nearest first, -1 for none."""
    out = np.full((len(pool), degree), -1)
    for a in range(0, len(pool), 256):
        ids = pool[a : a + 256]
        there = ids >= 0
        x = u[ids]
        far = np.where(there, 2 - 2 * np.einsum("bcd,bd->bc", x, u[a : a + 256]), np.inf)
        order = far.argsort(1, kind="stable")
        ids, far, there, x = (np.take_along_axis(v, order if v.ndim == 2 else order[:, :, None], 1) for v in (ids, far, there, x))
        between = 2 - 2 * np.einsum("bcd,bed->bce", x, x)
        rows, alive = np.arange(len(ids)), there.copy()
        for t in range(degree):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            out[a + rows[some], t] = ids[some, first[some]]
            alive &= ~(some[:, None] & (slack**2 * between[rows, first] <= far))
            alive[rows, first] = False
    return out


def build(u: np.ndarray) -> tuple[list[list[int]], int]:
    """Neighbour lists and medoid of a shard; all rows can be reached from the medoid."""
    m = len(u)
    medoid = int((u @ u.mean(0)).argmax())
    if m == 1:
        return [[]], 0
    size = min(POOL, m - 1)
    pool = np.zeros((m, size), np.int64)
    for a in range(0, m, 512):
        s = u[a : a + 512] @ u.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        pool[a : a + 512] = np.argpartition(-s, size - 1, axis=1)[:, :size]
    own = prune(u, pool, DEGREE, SLACK)
    lists: list[set[int]] = [set(r[r >= 0].tolist()) for r in own]
    for i, r in enumerate(own):
        for j in r[r >= 0].tolist():
            lists[j].add(i)
    long = [i for i, x in enumerate(lists) if len(x) > 2 * DEGREE]
    for i in long:
        more = np.array(sorted(lists[i]))
        lists[i] = set(more[prune_one(u, i, more)].tolist())
    reached = np.zeros(m, bool)
    reached[medoid] = True
    todo = [medoid]
    while True:
        while todo:
            for j in lists[todo.pop()]:
                if not reached[j]:
                    reached[j] = True
                    todo.append(j)
        if reached.all():
            return [sorted(x) for x in lists], medoid
        left = int(np.flatnonzero(~reached)[0])
        there = np.flatnonzero(reached)
        lists[int(there[(u[there] @ u[left]).argmax()])].add(left)
        reached[left] = True
        todo = [left]


def prune_one(u: np.ndarray, i: int, pool: np.ndarray) -> np.ndarray:
    """Places in the pool of the robustly pruned neighbours of one row, of a pool of any size."""
    far = 2 - 2 * u[pool] @ u[i]
    alive, out = np.ones(len(pool), bool), []
    for p in far.argsort(kind="stable"):
        if alive[p]:
            out.append(p)
            if len(out) == 2 * DEGREE:
                break
            alive &= SLACK**2 * (2 - 2 * u[pool] @ u[pool[p]]) > far
    return np.array(out)


def range_search(u: np.ndarray, radius: np.ndarray, lists: np.ndarray, starts: np.ndarray, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and angle of all that greedy, range-expanding search finds in range.

    lists: neighbours (-1: none); starts: for each query the places to start from (-1: none); reach: for each query the angle within which, plus its own radius, a row is in range.
    """
    n, m, rows = len(q), len(u), np.arange(len(q))
    seen, expanded = np.zeros((n, m), bool), np.zeros((n, m), bool)
    angle = np.full((n, m), np.inf)

    def meet(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles of neighbours (a row of ids for each query in at) that are new; inf for others."""
        new = (ids >= 0) & ~seen[at[:, None], ids]
        got = np.where(new, np.arccos(np.clip(np.einsum("bcd,bd->bc", u[ids], q[at]), -1, 1)), np.inf)
        r, c = np.nonzero(new)
        seen[at[r], ids[r, c]] = True
        angle[at[r], ids[r, c]] = got[r, c]
        return got, np.where(new, ids, -1)

    beam_a, beam = meet(rows, starts)
    pad = ((0, 0), (0, BEAM))
    beam_a, beam = np.pad(beam_a, pad, constant_values=np.inf), np.pad(beam, pad, constant_values=-1)
    while True:
        open_ = np.where((beam >= 0) & ~expanded[rows[:, None], beam], beam_a, np.inf)
        best = open_.argmin(1)
        at = np.flatnonzero(np.isfinite(open_[rows, best]))
        if not len(at):
            break
        current = beam[at, best[at]]
        expanded[at, current] = True
        got, ids = meet(at, lists[current])
        both_a, both = np.concatenate([beam_a[at], got], 1), np.concatenate([beam[at], ids], 1)
        keep = np.argpartition(both_a, BEAM - 1, axis=1)[:, :BEAM]
        beam_a[at, :BEAM], beam[at, :BEAM] = np.take_along_axis(both_a, keep, 1), np.take_along_axis(both, keep, 1)
        beam_a[at, BEAM:], beam[at, BEAM:] = np.inf, -1
    while True:
        inside = angle <= reach[:, None] + radius
        open_ = inside & ~expanded
        at = np.flatnonzero(open_.any(1))
        if not len(at):
            break
        current = open_[at].argmax(1)
        expanded[at, current] = True
        meet(at, lists[current])
    r, c = np.nonzero(inside)
    return r, c, angle[r, c]


class Cells:
    """The codebook, and how many parts each cell is cut into."""

    def __init__(self, book: np.ndarray):
        self.book = book

    def nearest(self, u: np.ndarray, first: int, last: int) -> np.ndarray:
        """The cells of rank first to last - 1 by distance."""
        far = (self.book**2).sum(1) - 2 * u @ self.book.T
        return far.argsort(1, kind="stable")[:, first:last].astype(np.int32)


def _celled(df: DataFrame, cells, first: int, last: int) -> DataFrame:
    """The rows once for each of their cells of these ranks, in column cell."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = cells.value.nearest(matrix(batch.column("vec")), first, last)
        at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
        return pa.record_batch([*[batch.column(c).take(at) for c in names], pa.array(near.ravel())], [*names, "cell"])

    return map_arrow(df, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int")


def _parts(counts: dict[int, int], cells: int, size: int) -> Column:
    """Into how many parts the cell in column cell is cut; counts has at most MAX_CELLS entries."""
    return F.element_at(F.array(*[F.lit(-(-counts.get(c, 1) // size)) for c in range(cells)]), F.col("cell") + 1)


def _counts(df: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id, digest, vec (unit, bytes) of the rows that take part, and the length of their vectors."""
    rows = valid(vectors, id_col, vector_col)
    sizes = rows.select(F.size("vec").alias("n")).limit(SAMPLE).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 0

    def unit(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("vec").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, dim)
        x = x / np.abs(x).max(1, keepdims=True)
        made = [v.tobytes() for v in x / np.sqrt((x**2).sum(1, keepdims=True)) + 0.0]
        return pa.record_batch([batch.column("vec_id"), pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in made], pa.binary()), pa.array(made, pa.binary())], ["vec_id", "digest", "vec"])

    return map_arrow(rows.filter(F.size("vec") == dim), unit, "vec_id long, digest binary, vec binary"), dim


def _balls(nodes: DataFrame, cells, sizes: int, radius: float) -> DataFrame:
    """node, first, n, vec, pivot, and of pivots also radius, size, members."""
    celled = materialize(_celled(nodes, cells, 0, 1))
    dealt = celled.withColumn("part", F.pmod(F.xxhash64("node"), _parts(_counts(celled), sizes, SHARD)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        u = matrix(rows["vec"])
        pivot = balls_of(u, radius)
        far = np.arccos(np.clip((u * u[pivot]).sum(1), -1, 1))
        far[pivot == np.arange(len(u))] = 0
        widest, total, members = np.zeros(len(u)), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        np.maximum.at(widest, pivot, far)
        np.add.at(total, pivot, rows["n"].to_numpy())
        np.add.at(members, pivot, 1)
        return pd.DataFrame({"node": rows["node"], "first": rows["first"], "n": rows["n"], "vec": rows["vec"], "pivot": rows["node"].to_numpy()[pivot], "radius": widest, "size": total, "members": members})

    return materialize(dealt.groupBy("cell", "part").applyInPandas(run, "node long, first long, n long, vec binary, pivot long, radius double, size long, members long"))


def _shards(pivots: DataFrame, cells, sizes: int) -> tuple[DataFrame, Column]:
    """shard, node, vec, radius, medoid, links (node, angle, radius) of every pivot in its two nearest cells; links are the union over shards. And the parts of a cell."""
    placed = materialize(_celled(pivots.select("node", "vec", "radius"), cells, 0, 2))
    parts = _parts(_counts(placed), sizes, 2 * SHARD)
    placed = placed.withColumn("shard", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), parts)).drop("cell")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        u, ids, radius = matrix(rows["vec"]), rows["node"].to_numpy(), rows["radius"].to_numpy()
        lists, medoid = build(u)
        turn = [np.arccos(np.clip(u[x] @ u[i], -1, 1)) for i, x in enumerate(lists)]
        return pd.DataFrame({"node": ids, "shard": rows["shard"], "medoid": np.arange(len(u)) == medoid, "to": [ids[x] for x in lists], "angle": turn, "far": [radius[x] for x in lists]})

    made = materialize(placed.groupBy("shard").applyInPandas(run, "node long, shard long, medoid boolean, to array<long>, angle array<double>, far array<double>"))
    zipped = F.transform(F.arrays_zip("to", "angle", "far"), lambda z: F.struct(z["to"].alias("node"), z["angle"].alias("angle"), z["far"].alias("radius")))
    flat = made.groupBy("node").agg(F.flatten(F.collect_list(zipped)).alias("links"))  # a node is in two shards at most
    both = placed.join(made.select("node", "shard", "medoid"), ["node", "shard"]).join(flat, "node")
    return materialize(both.select("shard", "node", "vec", "radius", "medoid", "links")), parts


def _search(asked: DataFrame, placed: DataFrame, parts: Column, theta: float) -> DataFrame:
    """q, v, angle of pivots in range; with angle null, links that lead out of the shard and may be in range. asked: node, vec, radius, cell."""
    spread = asked.select("node", "vec", "radius", F.col("cell").cast("long").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    spread = materialize(spread.select("node", "vec", "radius", (F.col("c") * (1 << 32) + F.col("part")).alias("shard")))
    turns = materialize(spread.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TURN).alias("turns")))
    left = spread.join(turns, "shard").withColumn("turn", F.pmod(F.xxhash64("node"), "turns")).drop("turns")
    right = placed.join(turns, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "angle": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return none
        rows = rows.sort_values("node", ignore_index=True)
        u, ids, radius = matrix(rows["vec"]), rows["node"].to_numpy(), rows["radius"].to_numpy()
        inner, outer = [], []
        for links in rows["links"]:
            to = np.array([x["node"] for x in links], np.int64)
            at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            here = ids[at] == to
            inner.append(np.unique(at[here]))
            outer.append((to[~here], np.array([x["angle"] for x in links])[~here], np.array([x["radius"] for x in links])[~here]))
        lists = np.full((len(ids), max(1, max(map(len, inner)))), -1)
        for i, x in enumerate(inner):
            lists[i, : len(x)] = x
        medoid, out = int(np.flatnonzero(rows["medoid"])[0]), []
        for a in range(0, len(queries), 256):
            some = queries.iloc[a : a + 256]
            q, qid, reach = matrix(some["vec"]), some["node"].to_numpy(), some["radius"].to_numpy() + theta + EPS
            at = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
            own = np.where((ids[at] == qid) & (at != medoid), at, -1)  # a pivot of the shard starts at its own place, too
            r, c, angle = range_search(u, radius, lists, np.column_stack([np.full(len(q), medoid), own]), q, reach)
            other = ids[c] != qid[r]
            out.append(pd.DataFrame({"q": qid[r][other], "v": ids[c][other], "angle": angle[other]}))
            for i, j, turn in zip(r, c, angle, strict=True):
                to, by, far = outer[j]
                may = (by - turn <= reach[i] + far) & (to != qid[i])
                if may.any():
                    out.append(pd.DataFrame({"q": qid[i], "v": to[may], "angle": np.nan}))
        return pd.concat([none, *out]) if out else none

    found = left.groupBy("shard", "turn").cogroup(right.groupBy("shard", "turn")).applyInPandas(run, "q long, v long, angle double")
    return materialize(found.withColumn("angle", F.when(~F.isnan("angle"), F.col("angle"))))


def _followed(found: DataFrame, front: DataFrame, pivots: DataFrame, flat: DataFrame, theta: float) -> DataFrame:
    """q, v, angle of found and of all that links out of shards lead to; front: q, v to be tried."""
    side = lambda x: pivots.select(F.col("node").alias(x), F.col("vec").alias(f"vec_{x}"), F.col("radius").alias(f"radius_{x}"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = matrix(batch.column("vec_q")), matrix(batch.column("vec_v"))
        return pa.record_batch([*[batch.column(c) for c in ("q", "v", "radius_q", "radius_v")], pa.array(np.arccos(np.clip((a * b).sum(1), -1, 1)))], ["q", "v", "radius_q", "radius_v", "angle"])

    tried = found.select("q", "v")
    front = materialize(front.distinct().join(tried, ["q", "v"], "left_anti"))
    while front.limit(1).count():
        tried = materialize(tried.unionAll(front))
        met = map_arrow(front.join(side("q"), "q").join(side("v"), "v"), measure, "q long, v long, radius_q double, radius_v double, angle double")
        new = materialize(met.filter(F.col("angle") <= theta + EPS + F.col("radius_q") + F.col("radius_v")))
        found = materialize(found.unionAll(new.select("q", "v", "angle")))
        links = new.join(flat.select(F.col("node").alias("v"), F.explode("links").alias("l")), "v").filter((F.col("l.angle") - F.col("angle") <= theta + EPS + F.col("radius_q") + F.col("l.radius")) & (F.col("l.node") != F.col("q")))
        front = materialize(links.select("q", F.col("l.node").alias("v")).distinct().join(tried, ["q", "v"], "left_anti"))
    return found


def _true_pairs(pivots: DataFrame, theta: float) -> DataFrame:
    """q, v in range of AUDIT pivots (a bounded sample, sent to all tasks) and all pivots."""
    some = pivots.orderBy(F.xxhash64("node")).limit(AUDIT).select("node", "vec", "radius").toPandas()
    shared = pivots.sparkSession.sparkContext.broadcast((some["node"].to_numpy(), matrix(some["vec"]), some["radius"].to_numpy()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, u, radius = shared.value
        node, x, r = batch.column("node").to_numpy(), matrix(batch.column("vec")), batch.column("radius").to_numpy()
        i, j = np.nonzero((angles(u, x) <= theta + radius[:, None] + r) & (ids[:, None] != node))
        return pa.record_batch([pa.array(ids[i]), pa.array(node[j])], ["q", "v"])

    return materialize(map_arrow(pivots.select("node", "vec", "radius"), run, "q long, v long"))


KINDS = "kind string, node long, links long, ball long, other long, vec binary"


def _made(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in KINDS.split(", ")]).astype({"node": "Int64", "links": "Int64", "ball": "Int64", "other": "Int64"})


def _verify(pairs: DataFrame, balls: DataFrame, pivots: DataFrame, theta: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of nodes to other balls (node, links), and linked balls (a, b). pairs: q, v in both directions."""
    blocks = materialize(pairs.select(F.col("q").alias("pivot")).distinct().join(pivots.select("pivot", F.ceil(F.col("members") / BLOCK).alias("blocks")), "pivot"))
    inside = balls.select("pivot", "node", "n", "vec").join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("blocks")
    inside = materialize(inside)
    near = pairs.join(pivots.select(F.col("node").alias("v"), F.col("vec").alias("other"), "radius", "size", "members"), "v").join(blocks.withColumnRenamed("pivot", "q"), "q")
    near = near.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    near = materialize(near)  # of its own, so that both sides of the cogroup have different columns

    def whole(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(others):
            u, p = matrix(rows["vec"]), matrix(others["other"])
            cos, r, one = u @ p.T, others["radius"].to_numpy(), (others["members"] == 1).to_numpy()
            far = np.arccos(np.clip(cos, -1, 1))
            sure = np.where(one, cos >= threshold, far + r <= theta - EPS)
            doubt = ~sure & ~one & (far - r <= theta + EPS)
            links, ball = sure @ others["size"].to_numpy(), int(rows["pivot"].iloc[0])
            out += [("links", a, b, None, None, None) for a, b in zip(rows["node"].tolist(), links.tolist(), strict=True) if b]
            out += [("joined", None, None, ball, b, None) for b in others["v"].to_numpy()[sure.any(0)].tolist()]
            v, ids, vec = others["v"].tolist(), rows["node"].tolist(), rows["vec"].tolist()
            out += [("doubt", ids[i], None, ball, v[j], vec[i]) for i, j in zip(*np.nonzero(doubt), strict=True)]
        return _made(out)

    first = materialize(inside.groupBy("pivot", "block").cogroup(near.groupBy("q", "block")).applyInPandas(whole, KINDS))
    doubt = first.filter("kind = 'doubt'")
    turns = materialize(doubt.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("turns")).withColumnRenamed("other", "pivot"))
    sizes = blocks.join(turns, "pivot")
    left = doubt.join(sizes, F.col("other") == F.col("pivot")).withColumn("turn", F.pmod(F.xxhash64("node"), "turns")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = left.select("other", "block", "turn", "node", "ball", "vec")
    right = inside.join(turns, "pivot").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select("pivot", "block", "turn", "n", "vec")

    def single(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(others):
            linked = matrix(rows["vec"]) @ matrix(others["vec"]).T >= threshold
            links = linked @ others["n"].to_numpy()
            out += [("links", a, b, None, None, None) for a, b in zip(rows["node"].tolist(), links.tolist(), strict=True) if b]
            to = int(rows["other"].iloc[0])
            out += [("joined", None, None, a, to, None) for a in sorted(set(rows["ball"].to_numpy()[linked.any(1)].tolist()))]
        return _made(out)

    second = left.groupBy("other", "block", "turn").cogroup(right.groupBy("pivot", "block", "turn")).applyInPandas(single, KINDS)
    both = materialize(first.filter("kind <> 'doubt'").unionAll(second))
    links = both.filter("kind = 'links'").groupBy("node").agg(F.sum("links").alias("links"))
    return links, both.filter("kind = 'joined'").select(F.col("ball").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = 0.995, probes: int = 2) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row, and recall: what the audit of the last search found."""
    spark = vectors.sparkSession
    tune(spark)
    theta = math.acos(threshold)
    rows, dim = _nodes(vectors, id_col, vector_col)
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"))  # only counts rows of one id
    rows = materialize(rows)
    nodes = rows.groupBy("digest").agg(F.min(F.struct("vec_id", "vec")).alias("m"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.select("digest", F.col("m.vec_id").alias("first"), F.col("m.vec").alias("vec"), "n").withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    counted = every.groupBy("vec_id").agg(F.count(F.lit(1)).alias("all"))
    if total:
        share = int(min(1.0, 1.1 * SAMPLE / total) * (1 << 30)) + 1
        sample = nodes.filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < share).limit(SAMPLE).select("vec").toPandas()
        sample = sample if len(sample) else nodes.limit(SAMPLE).select("vec").toPandas()
        book = kmeans(matrix(sample["vec"]), max(1, min(MAX_CELLS, round(2 * total / SHARD))))
        cells, sizes = spark.sparkContext.broadcast(Cells(book)), len(book)
        balls = _balls(nodes.select("node", "first", "n", "vec"), cells, sizes, theta / 2 - EPS)
        pivots = materialize(balls.filter("node = pivot"))
        placed, parts = _shards(pivots, cells, sizes)
        flat = placed.select("node", "links").dropDuplicates(["node"])
        true = _true_pairs(pivots, theta)
        wanted, found, done = true.count(), None, 0
        while True:
            last = min(max(probes, 2 * done), sizes)
            got = _search(_celled(pivots.select("node", "vec", "radius"), cells, done, last), placed, parts, theta)
            met = got.filter("angle IS NOT NULL").dropDuplicates(["q", "v"])
            found = materialize(met if found is None else found.unionByName(met).dropDuplicates(["q", "v"]))
            found = _followed(found, got.filter("angle IS NULL").select("q", "v"), pivots, flat, theta)
            both = materialize(found.select("q", "v").unionAll(found.select(F.col("v").alias("q"), F.col("q").alias("v"))).distinct())
            recall = true.join(both, ["q", "v"], "left_semi").count() / wanted if wanted else 1.0
            done = last
            if recall >= reach or done == sizes:
                break
        links, joined = _verify(both, balls, pivots, theta, threshold)
        comps = components(joined)
        of = balls.select("node", "pivot", "first", "n").join(pivots.select("pivot", "size"), "pivot").join(comps.withColumnRenamed("node", "pivot"), "pivot", "left")
        of = of.join(links, "node", "left").withColumn("component", F.coalesce("component", "pivot"))
        of = materialize(of.select("node", "component", "first", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
        least = materialize(of.groupBy("component").agg(F.min("first").alias("component_id")))
        known = materialize(of.join(least, "component").join(nodes.select("node", "digest"), "node").select("digest", "n_links", "component_id"))
        linked = rows.select("vec_id", "digest").join(known, "digest").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    else:
        recall, linked = 1.0, spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    # rows that take no part: what of each id's rows isn't among those that do
    part = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("in"))
    rest = counted.join(part, "vec_id", "left").withColumn("left", F.col("all") - F.coalesce("in", F.lit(0))).filter("left > 0")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.explode(F.array_repeat(F.lit(0), F.col("left").cast("int")))).drop("col")
    out = linked.unionByName(rest)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))
