"""Ordered computation over a symbol without ever putting the whole symbol in one task.

A symbol may hold a third of all bars, so nothing here windows over a whole symbol.
Bars are numbered densely (``bar_idx``) and cut into groups; bounded frames run inside a group
that carries a halo of preceding rows, unbounded prefixes are combined from one row per group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Rows per segment (scan unit) and per group (window unit); groups folded together in one row."""

    segment: int = 256
    group: int = 4096
    fan: int = 1024

    def halo_for(self, parts: list[int]) -> int:
        """Halo rows for consecutive lookbacks separated by scans, whole segments each."""
        return sum(-(-max(p, 0) // self.segment) * self.segment for p in parts)


GRID = Grid()
GROUP_KEY = "_grp"
CORE = "_core"


def with_bar_idx(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts",
                 slot: Column | None = None) -> DataFrame:
    """Dense 0-based position of each bar in its symbol.

    Rows are ranked inside (symbol, time slot) and offset by the number of rows in earlier
    slots; only the slot counts (one row per symbol and slot) are ordered per symbol.
    """
    slot = F.date_trunc("week", F.col(ts)) if slot is None else slot
    tagged = df.withColumn("_slot", slot)
    counts = tagged.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot")
    offsets = counts.select(*keys, "_slot", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts)
    return (
        tagged.join(offsets, [*keys, "_slot"])
        .withColumn("bar_idx", F.row_number().over(inside) - 1 + F.col("_off"))
        .drop("_slot", "_off")
    )


def with_halo(df: DataFrame, halo: int, grid: Grid = GRID, idx: str = "bar_idx") -> DataFrame:
    """Assign rows to groups, repeating the last ``halo`` rows of a group in the next one(s)."""
    own = F.expr(f"{idx} div {grid.group}")
    if halo <= 0:
        return df.withColumn(GROUP_KEY, own).withColumn(CORE, F.lit(True))
    return (
        df.withColumn("_own", own)
        .withColumn(GROUP_KEY, F.explode(F.sequence(F.col("_own"), F.expr(f"({idx} + {halo}) div {grid.group}"))))
        .withColumn(CORE, F.col(GROUP_KEY) == F.col("_own"))
        .drop("_own")
    )


def with_lookahead(df: DataFrame, rows: int, grid: Grid = GRID, idx: str = "bar_idx") -> DataFrame:
    """Mirror of :func:`with_halo`: the first ``rows`` rows of a group are repeated in the previous one(s)."""
    own = F.expr(f"{idx} div {grid.group}")
    low = F.expr(f"greatest(0L, {idx} - {rows}) div {grid.group}")
    return (
        df.withColumn("_own", own)
        .withColumn(GROUP_KEY, F.explode(F.sequence(low, F.col("_own"))))
        .withColumn(CORE, F.col(GROUP_KEY) == F.col("_own"))
        .drop("_own")
    )


def core_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(GROUP_KEY, CORE)


def group_window(keys: tuple[str, ...] = ("symbol",), idx: str = "bar_idx") -> Window:
    return Window.partitionBy(*keys, GROUP_KEY).orderBy(idx)


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "first": lambda a, b: F.coalesce(a, b),
}


def _agg(kind: str, col: Column, idx: Column) -> Column:
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), idx))
    if kind == "first":
        return F.min_by(col, F.when(col.isNotNull(), idx))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col)


def _over(kind: str, col: Column, w) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    if kind == "first":
        return F.first(col, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col).over(w)


def running(df: DataFrame, specs: dict[str, tuple[str, Column]], keys: tuple[str, ...] = ("symbol",),
            idx: str = "bar_idx", grid: Grid = GRID, reverse: bool = False) -> DataFrame:
    """Running sum / max / min / last / first from the start of a symbol (or back from its end).

    Two levels: one row per group is prefix-combined per symbol, then joined to the running value
    inside the group.
    """
    names = list(specs)
    g = df.withColumn(GROUP_KEY, F.expr(f"{idx} div {grid.group}"))
    g = g.withColumns({f"_in_{n}": specs[n][1] for n in names})
    order = F.col(idx).desc() if reverse else F.col(idx)
    gorder = F.col(GROUP_KEY).desc() if reverse else F.col(GROUP_KEY)
    rank = -F.col(idx) if reverse else F.col(idx)
    totals = g.groupBy(*keys, GROUP_KEY).agg(
        *[_agg(specs[n][0], F.col(f"_in_{n}"), rank).alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(gorder).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, GROUP_KEY, *[_over(specs[n][0], F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n in names])
    inside = Window.partitionBy(*keys, GROUP_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = g.join(carried, [*keys, GROUP_KEY])
    out = out.withColumns({f"_l_{n}": _over(specs[n][0], F.col(f"_in_{n}"), inside) for n in names})
    out = out.withColumns({n: _COMBINE[specs[n][0]](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n in names})
    return out.drop(GROUP_KEY, *[f"_{k}_{n}" for n in names for k in ("in", "c", "l")])
