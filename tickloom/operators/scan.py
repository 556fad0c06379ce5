"""Linear recursions ``y_t = a_t * y_{t-1} + b_t`` as a block-parallel affine scan.

Inside a segment of a few hundred bars the recursion has the closed form
``y_t = P_t * (carry + sum(b_i / P_i))`` with ``P_t`` the product of the factors so far, which is an
ordinary window sum.  Affine maps compose: each segment is summarised by its end row, each group by
the composition of its segments, ``Grid.fan`` groups by the composition of theirs, and ordered folds
down these levels yield the carry of every group.  A recursion may be fed by another one (an EMA of an EMA); the response of the
later state to the earlier carry is itself a window sum, so a whole chain costs one pass.
Segment length bounds ``1 / P``: with 256 bars a constant factor may be as small as 0.07.

No row holds more than ``Grid.fan`` groups, and the last fold per symbol sees one entry for each of
those (four million bars at the defaults).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import CORE, GRID, GROUP_KEY, Grid

SEG = "_seg"
SUPER = "_super"


@dataclass(frozen=True)
class Scan:
    """One recursion.

    ``factor``: number, or column for a bar-dependent factor.  ``inject``: ``b_t`` from data, or a
    gain applied to the sum of ``feeds`` (name, coefficient) of states of the same bar.  Before row
    ``first``, and where ``valid`` is false, the state passes through.  ``seed``: state before the
    first bar (first non-null value in the symbol); a fed scan is seeded by its input at ``first``.
    """

    name: str
    factor: float | Column
    inject: Column | float
    seed: Column | None = None
    valid: Column | None = None
    first: int = 0
    feeds: tuple = ()


@dataclass(frozen=True)
class RunLength:
    """Consecutive-true counter: the state resets to zero where ``cond`` is false."""

    name: str
    cond: Column
    feeds: tuple = ()


def _ancestors(scans: list) -> dict[str, list[str]]:
    """States each state depends on, itself last."""
    out: dict[str, list[str]] = {}
    for s in scans:
        deps: list[str] = []
        for u, _ in s.feeds:
            deps += [m for m in out[u] if m not in deps]
        out[s.name] = [*deps, s.name]
    return out


def _depth(scans: list) -> dict[str, int]:
    out: dict[str, int] = {}
    for s in scans:
        out[s.name] = 1 + max((out[u] for u, _ in s.feeds), default=-1)
    return out


def _resp(k: str, m: str) -> str:
    """Column with the response of state k to a unit carry of state m."""
    return f"_h_{k}__{m}"


def _local(df: DataFrame, scans: list, keys: tuple[str, ...], idx: str, grid: Grid) -> DataFrame:
    """Per row: ``_l_k`` (value with zero carry) and the responses ``_h_k__m`` within the segment."""
    anc, depth = _ancestors(scans), _depth(scans)
    seg_w = Window.partitionBy(*keys, GROUP_KEY, SEG).orderBy(idx)
    upto = seg_w.rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col(idx) % grid.segment + 1
    seeded = {s.name for s in scans if isinstance(s, Scan) and (s.seed is not None or s.feeds)}
    first: dict[str, Column] = {}
    for s in scans:
        own = _resp(s.name, s.name)
        if isinstance(s, RunLength):
            first[f"_z_{s.name}"] = F.max(F.when(~s.cond, F.col(idx))).over(upto)
            first[f"_b_{s.name}"] = F.min(idx).over(upto)
            continue
        ok = F.col(idx) >= s.first if s.valid is None else F.coalesce(s.valid, F.lit(False))
        if isinstance(s.factor, Column):
            first[own] = F.exp(F.sum(F.when(ok, F.ln(s.factor)).otherwise(F.lit(0.0))).over(upto))
        elif s.factor == 1.0:
            first[own] = F.lit(1.0)
        elif s.valid is None:
            steps = pos if s.first == 0 else F.greatest(F.lit(0), F.least(pos, F.col(idx) - s.first + 1))
            first[own] = F.pow(F.lit(float(s.factor)), steps)
        else:
            first[own] = F.pow(F.lit(float(s.factor)), F.sum(ok.cast("int")).over(upto))
        if not s.feeds:
            first[f"_b_{s.name}"] = F.when(ok, s.inject).otherwise(F.lit(0.0))
    df = df.withColumns(first)
    for d in range(max(depth.values()) + 1):
        level: dict[str, Column] = {}
        for s in scans:
            if depth[s.name] != d:
                continue
            own = _resp(s.name, s.name)
            if isinstance(s, RunLength):
                z = F.col(f"_z_{s.name}")
                level[own] = F.when(z.isNull(), 1.0).otherwise(0.0)
                level[f"_l_{s.name}"] = (F.col(idx) - F.coalesce(z, F.col(f"_b_{s.name}") - 1)).cast("double")
                continue
            spread = lambda x: F.col(own) * F.sum(x / F.col(own)).over(upto)
            if not s.feeds:
                level[f"_l_{s.name}"] = spread(F.col(f"_b_{s.name}"))
                if s.seed is not None:
                    level[f"_s_{s.name}"] = F.first(s.seed, ignorenulls=True).over(upto)
                continue
            ok = F.col(idx) >= s.first
            fed = lambda pick: F.when(ok, F.lit(float(s.inject)) * sum(
                (F.lit(float(k)) * pick(u) for u, k in s.feeds), F.lit(0.0))).otherwise(F.lit(0.0))
            level[f"_l_{s.name}"] = spread(fed(lambda u: F.col(f"_l_{u}")))
            for m in anc[s.name][:-1]:
                level[_resp(s.name, m)] = spread(fed(lambda u: F.col(_resp(u, m)) if m in anc[u] else F.lit(0.0)))
            # inside segment 0 every earlier carry is its seed, so the fed value at `first` is known
            whole = sum((F.lit(float(k)) * (F.col(f"_l_{u}") + sum(
                (F.col(_resp(u, m)) * F.coalesce(F.col(f"_s_{m}"), F.lit(0.0)) for m in anc[u] if m in seeded), F.lit(0.0)))
                for u, k in s.feeds), F.lit(0.0))
            level[f"_s_{s.name}"] = F.first(F.when(F.col(idx) == s.first, whole), ignorenulls=True).over(upto)
        df = df.withColumns(level)
    return df


def run_scans(df: DataFrame, scans: list, keys: tuple[str, ...] = ("symbol",), idx: str = "bar_idx",
              halo: int = 0, grid: Grid = GRID) -> DataFrame:
    """Add one column per scan to a frame already split by :func:`with_halo`.

    Halo rows get exact values too, provided their inputs are exact, so windows may follow.
    """
    for s in scans:
        if s.feeds and s.first >= grid.segment:
            raise ValueError(f"{s.name}: warm-up of {s.first} bars exceeds the segment of {grid.segment}")
    anc = _ancestors(scans)
    names = [s.name for s in scans]
    seeded = [s.name for s in scans if isinstance(s, Scan) and (s.seed is not None or s.feeds)]
    pairs = [(k, m) for k in names for m in anc[k]]
    local = _local(df.withColumn(SEG, F.expr(f"{idx} div {grid.segment}")), scans, keys, idx, grid)

    # group summaries: segment end rows, already co-located by (keys, group)
    last_in_seg = F.lead(SEG).over(Window.partitionBy(*keys, GROUP_KEY, SEG).orderBy(idx)).isNull()
    summary = F.struct(SEG, *[F.col(f"_l_{n}") for n in names], *[F.col(_resp(k, m)) for k, m in pairs])
    ends = (
        local.withColumn("_end", last_in_seg).filter(F.col(CORE) & F.col("_end"))
        .groupBy(*keys, GROUP_KEY)
        .agg(F.sort_array(F.collect_list(summary)).alias("_segs"),
             *[F.min_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(SEG))).alias(f"_s_{n}") for n in seeded])
    )

    def compose(acc: Column, x: Column) -> Column:
        fields = []
        for k in names:
            fields.append((x[f"_l_{k}"] + sum((x[_resp(k, m)] * acc[f"_l_{m}"] for m in anc[k]), F.lit(0.0))).alias(f"_l_{k}"))
        for k, m in pairs:
            via = [j for j in anc[k] if m in anc[j]]
            fields.append(sum((x[_resp(k, j)] * acc[_resp(j, m)] for j in via), F.lit(0.0)).alias(_resp(k, m)))
        return F.struct(*fields)

    unit = F.struct(*[F.lit(0.0).alias(f"_l_{k}") for k in names],
                    *[F.lit(1.0 if k == m else 0.0).alias(_resp(k, m)) for k, m in pairs])
    per_key = ends.select(*keys, GROUP_KEY, F.aggregate("_segs", unit, compose).alias("_tot"), *[f"_s_{n}" for n in seeded])
    # two levels: at most `fan` groups meet in one row, and one row for each `fan` groups of a key in another
    mid = per_key.groupBy(*keys, F.expr(f"{GROUP_KEY} div {grid.fan}").alias(SUPER)).agg(
        F.sort_array(F.collect_list(F.struct(GROUP_KEY, "_tot"))).alias("_all"),
        *[F.min_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(GROUP_KEY))).alias(f"_s_{n}") for n in seeded])
    top = mid.select(*keys, SUPER, F.aggregate("_all", unit, lambda acc, x: compose(acc, x["_tot"])).alias("_tot"), *[f"_s_{n}" for n in seeded])
    top = top.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(SUPER, "_tot"))).alias("_supers"),
        *[F.min_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(SUPER))).alias(f"_s_{n}") for n in seeded])

    def push(state: Column, x: Column) -> Column:
        return F.struct(*[
            (x[f"_l_{k}"] + sum((x[_resp(k, m)] * state[m] for m in anc[k]), F.lit(0.0))).alias(k) for k in names])

    state_type = "struct<" + ",".join(f"`{n}`:double" for n in names) + ">"

    def carried(arr: Column, start: Column, pick, label: str) -> Column:
        """Array of (label, state before the element) along an ordered array."""
        empty = F.array().cast(f"array<struct<`{label}`:bigint,c:{state_type}>>")
        return F.aggregate(
            arr, F.struct(start.alias("st"), empty.alias("out")),
            lambda acc, x: F.struct(
                push(acc["st"], pick(x)).alias("st"),
                F.concat(acc["out"], F.array(F.struct(x[label].alias(label), acc["st"].alias("c")))).alias("out")),
            lambda acc: acc["out"])

    start = F.struct(*[(F.coalesce(F.col(f"_s_{n}"), F.lit(0.0)) if n in seeded else F.lit(0.0)).alias(n) for n in names])
    first = top.select(*keys, F.explode(carried(F.col("_supers"), start, lambda x: x["_tot"], SUPER)).alias("_e"))
    first = first.select(*keys, F.col(f"_e.{SUPER}").alias(SUPER), F.col("_e.c").alias("_first"))
    entry = mid.select(*keys, SUPER, "_all").join(first, [*keys, SUPER]).select(*keys, F.explode(carried(F.col("_all"), F.col("_first"), lambda x: x["_tot"], GROUP_KEY)).alias("_e"))
    entry = entry.select(*keys, F.col(f"_e.{GROUP_KEY}").alias(GROUP_KEY), F.col("_e.c").alias("_in"))
    carry = ends.join(entry, [*keys, GROUP_KEY]).select(
        *keys, GROUP_KEY, carried(F.col("_segs"), F.col("_in"), lambda x: x, SEG).alias("_cs"))
    reach, per_group = halo // grid.segment, grid.group // grid.segment
    if reach:
        hops = -(-reach // per_group)
        carry = (
            carry.withColumn("_to", F.explode(F.sequence(F.col(GROUP_KEY), F.col(GROUP_KEY) + hops)))
            .select(*keys, F.col("_to").alias(GROUP_KEY), F.filter("_cs", lambda e: e[SEG] >= F.col("_to") * per_group - reach).alias("_cs"))
            .groupBy(*keys, GROUP_KEY).agg(F.flatten(F.collect_list("_cs")).alias("_cs"))
        )
    by_seg = carry.select(*keys, GROUP_KEY, F.map_from_entries("_cs").alias("_by_seg"))
    out = local.join(by_seg, [*keys, GROUP_KEY])
    helper = [c for c in out.columns if c.startswith(("_l_", "_h_", "_b_", "_z_", "_s_"))]
    cy = F.try_element_at("_by_seg", F.col(SEG))
    keep = [c for c in out.columns if c not in helper and c not in (SEG, "_by_seg")]
    out = out.select(*[F.col(f"`{c}`") for c in keep], cy.alias("_cy"), *helper)
    value = lambda k: F.col(f"_l_{k}") + sum((F.col(_resp(k, m)) * F.col(f"_cy.{m}") for m in anc[k]), F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[value(n).alias(n) for n in names])
