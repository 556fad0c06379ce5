"""Element-wise and shift helpers on ordered series, and the in-house indicator family.

The in-house family shows partial values while its window fills, unlike the registry features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import c, div
from tickloom.operators.blocks import GRID, GROUP_KEY, Grid, core_only, with_lookahead
from tickloom.operators.features import Scope


def add(a, b) -> Column:
    return c(a) + c(b)


def subtract(a, b) -> Column:
    return c(a) - c(b)


def multiply(a, b) -> Column:
    return c(a) * c(b)


def divide(a, b) -> Column:
    return div(a, b)


def power(a, n) -> Column:
    return F.pow(c(a), F.lit(float(n)))


def extract_signs(x) -> Column:
    return F.when(c(x) >= 0, 1).otherwise(-1)


def shift_right(s: Scope, x, n: int, fill: float = 0.0) -> Column:
    return F.when(F.col("bar_idx") < n, F.lit(fill)).otherwise(s.lag(x, n))


def changes(s: Scope, x, n: int) -> Column:
    return c(x) - shift_right(s, x, n)


def shift_left(df: DataFrame, name: str, col: str, n: int, fill: float = 0.0, grid: Grid = GRID) -> DataFrame:
    """Value n bars later, ``fill`` at the end: a group looks ahead into copies of the next rows."""
    ahead = with_lookahead(df, n, grid)
    w = Window.partitionBy("symbol", GROUP_KEY).orderBy("bar_idx")
    return core_only(ahead.withColumn(name, F.coalesce(F.lead(col, n).over(w), F.lit(fill))))


# -- in-house indicators ---------------------------------------------------------------------

def sma(s: Scope, x, n: int) -> Column:
    return F.avg(c(x)).over(s.frame(n))


def msum(s: Scope, x, n: int) -> Column:
    return F.sum(c(x)).over(s.frame(n))


def mstd(s: Scope, x, n: int) -> Column:
    return F.coalesce(s.pstd(x, n), F.lit(0.0))


def ema(s: Scope, name: str, x, n: int):
    return s.ema(name, x, n, guard=False)


def rma(s: Scope, name: str, x, n: int) -> Column:
    return s.wilder(name, x, n, guard=False)


def macd(s: Scope, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, Column]:
    line = ema(s, "f", "close", fast) - ema(s, "s", "close", slow)
    return {"macd_line": line.col, "signal_line": ema(s, "g", line, signal).col}


def rsi(s: Scope, n: int = 14) -> Column:
    """First value 0; no losses gives 100."""
    d = s.let("d", s.diff("close"))
    up = rma(s, "u", F.when(d > 0, d).otherwise(0.0), n)
    dn = rma(s, "v", F.when(d <= 0, -d).otherwise(0.0), n)
    return F.when(F.col("bar_idx") == 0, 0.0).when(dn == 0, 100.0).otherwise(100 - 100 / (1 + div(up, dn)))


def true_range(s: Scope) -> Column:
    pc = F.coalesce(s.lag("close"), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr(s: Scope, n: int = 14) -> dict[str, Column]:
    tr = s.let("tr", true_range(s))
    return {"tr_line": tr, "atr_line": s.let("atr", sma(s, tr, n))}


def bollinger(s: Scope, n: int = 20) -> dict[str, Column]:
    mid, sd = s.let("mid", sma(s, "close", n)), s.let("sd", mstd(s, "close", n))
    return {"upper": mid + 2 * sd, "middle": mid, "lower": mid - 2 * sd}


def vwap(s: Scope, n: int = 14) -> Column:
    return div(msum(s, F.col("close") * F.col("volume"), n), msum(s, "volume", n))


def obv(s: Scope) -> Column:
    d = s.diff("close")
    return s.cumsum("c", F.when(d > 0, F.col("volume")).when(d < 0, -F.col("volume")).otherwise(0.0))


def mfi(s: Scope, n: int = 14) -> Column:
    """Money flow signed by its own change; the missing past counts as 0."""
    flow = s.let("flow", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    signed = s.let("signed", extract_signs(changes(s, flow, 1)) * flow)
    pos = msum(s, F.when(signed >= 0, signed).otherwise(0.0), n)
    neg = msum(s, F.when(signed < 0, -signed).otherwise(0.0), n)
    return 100 - 100 / (1 + div(pos, neg))
