"""Ordered state machines over long keys, cut into blocks.

A state machine is a small Python function over the arrays of one block.  All blocks of all keys run
in parallel from a guessed arrival state; then only the blocks whose guess differs from the departure
state of the block before are run again, until nothing changes.  The fixpoint is the sequential
result.  Positions close, bands flip and smoothers contract, so guesses meet the true path quickly and
a few rounds are enough; no task ever holds more than one block.

Rounds keep only one state row per block, written with ``checkpoint`` so that a lost executor does not
restart the chain.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

BLOCK = 8192
BLK = "_blk"

# machine(arrays, params, state, last_block, emit) -> state; emit is None when only the state is wanted
Machine = Callable[[dict, dict, list | None, bool, list | None], list]


def _sorted_arrays(rows: pd.DataFrame, idx: str) -> dict:
    rows = rows.sort_values(idx, kind="stable")
    return {n: rows[n].to_numpy() for n in rows.columns}


def _state_fn(machine: Machine, keys: list[str], idx: str, param_cols: list[str]):
    def run(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        out = plan[[*keys, *param_cols, BLK, "_last", "_arrive"]].copy()
        if rows.empty:
            out["_depart"] = out["_arrive"]
            return out
        arrays = _sorted_arrays(rows, idx)
        out["_depart"] = [
            [float(v) for v in machine(arrays, p, None if p["_arrive"] is None else list(p["_arrive"]), False, None)]
            for p in plan.to_dict("records")]
        return out
    return run


def _emit_fn(machine: Machine, keys: list[str], idx: str, param_keys: list[str], out_cols: list[str]):
    def run(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if not rows.empty:
            arrays = _sorted_arrays(rows, idx)
            for p in plan.to_dict("records"):
                emitted: list = []
                machine(arrays, p, None if p["_arrive"] is None else list(p["_arrive"]), bool(p["_last"]), emitted)
                if emitted:
                    part = pd.DataFrame(emitted, columns=out_cols)
                    for k in [*keys, *param_keys]:
                        part[k] = p[k]
                    parts.append(part)
        cols = [*keys, *param_keys, *out_cols]
        return pd.concat(parts)[cols] if parts else pd.DataFrame({c: pd.Series(dtype=object) for c in cols})
    return run


def relay(df: DataFrame, machine: Machine, out_schema: str, keys: tuple[str, ...] = ("symbol",), idx: str = "bar_idx",
          params: DataFrame | None = None, param_keys: tuple[str, ...] = (), block: int = BLOCK,
          tolerance: float = 1e-12) -> DataFrame:
    """Run ``machine`` over ``df`` ordered by ``idx`` per ``keys``.

    ``params`` multiplies every key by its parameter rows (joined on the shared key columns, identified
    by ``param_keys``); the bars of a block are shipped once for all of them.  ``out_schema`` describes
    the emitted tuples.
    """
    keys_l, pk = list(keys), list(param_keys)
    data = materialize(df.withColumn(BLK, F.expr(f"{idx} div {block}")))
    blocks = data.groupBy(*keys_l).agg(F.max(BLK).alias("_hi"))
    plan = blocks.select(*keys_l, "_hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_hi"))).alias(BLK))
    plan = plan.select(*keys_l, BLK, (F.col(BLK) == F.col("_hi")).alias("_last"))
    if params is not None:
        shared = [c for c in params.columns if c in keys_l]
        plan = plan.join(params, shared) if shared else plan.crossJoin(params)
    param_cols = [c for c in plan.columns if c not in (*keys_l, BLK, "_last")]
    plan = plan.withColumn("_arrive", F.lit(None).cast("array<double>"))

    plan = plan.select(*[F.col(c).alias(c) for c in plan.columns])  # fresh attributes for the cogroup with data
    many = blocks.filter(F.col("_hi") > 0).limit(1).count() > 0
    if many:
        plan = _settle(data, plan, machine, keys_l, idx, param_cols, pk, tolerance)
    out_cols = [p.strip().split(" ")[0] for p in out_schema.split(",")]
    types = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in [*keys_l, *pk]] + [out_schema])
    return (
        data.groupBy(*keys_l, BLK).cogroup(plan.groupBy(*keys_l, BLK))
        .applyInPandas(_emit_fn(machine, keys_l, idx, pk, out_cols), schema)
    )


def _settle(data: DataFrame, plan: DataFrame, machine: Machine, keys: list[str], idx: str, param_cols: list[str],
            pk: list[str], tolerance: float) -> DataFrame:
    """Iterate arrival states to the fixpoint. Each round settles at least one more block of a key, so this ends."""
    types = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
    cols = [*keys, *param_cols, BLK, "_last", "_arrive"]
    schema = ", ".join([f"`{c}` {types[c]}" for c in cols] + ["`_depart` array<double>"])
    fn = _state_fn(machine, keys, idx, param_cols)

    def run(todo: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, BLK).cogroup(todo.select(*cols).groupBy(*keys, BLK)).applyInPandas(fn, schema)

    states = materialize(run(plan, data))
    before = Window.partitionBy(*keys, *pk).orderBy(BLK)
    same = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x))), lambda ok: ok)
    while True:
        nxt = states.withColumn("_want", F.lag("_depart").over(before))
        stale = F.col("_want").isNotNull() & (F.col("_arrive").isNull() | ~same(F.col("_arrive"), F.col("_want")))
        marked = nxt.withColumn("_stale", F.coalesce(stale, F.lit(False)))
        todo = marked.filter("_stale").withColumn("_arrive", F.col("_want")).select(*cols)
        if todo.limit(1).count() == 0:
            return states.select(*cols)
        again = run(todo, data.join(todo.select(*keys, BLK).distinct(), [*keys, BLK], "left_semi"))
        states = materialize(marked.filter(~F.col("_stale")).select(*cols, "_depart").unionByName(again.select(*cols, "_depart")))


def first_at_or_after(sorted_idx: np.ndarray, pos: int) -> int | None:
    """Smallest element of a sorted array that is >= pos."""
    k = int(np.searchsorted(sorted_idx, pos))
    return int(sorted_idx[k]) if k < len(sorted_idx) else None
