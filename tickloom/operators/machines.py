"""Features that are state machines over bars: Supertrend, parabolic SAR, adaptive Kalman filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import GRID
from tickloom.operators.features import Scope, apply_layers, column_name, float_param, int_param, native_feature
from tickloom.operators.indicators import atr_of, median_price
from tickloom.operators.relay import BLOCK, relay


def _attach(bars: DataFrame, out: DataFrame, fid: str, names: list[str]) -> DataFrame:
    renamed = out.select("symbol", "bar_idx", *[F.col(n).alias(column_name(fid, n)) for n in names])
    return bars.join(renamed, ["symbol", "bar_idx"], "left")


def _prepared(bars: DataFrame, cols: dict, grid) -> DataFrame:
    """bars keys plus expressions built on a scope."""
    scope = Scope("prep")
    exprs = {n: scope.let(n, fn(scope)) for n, fn in cols.items()}
    df = apply_layers(bars.select("symbol", "bar_idx", "open", "high", "low", "close"), [scope], grid)
    return df.select("symbol", "bar_idx", *[e.alias(n) for n, e in exprs.items()])


def supertrend_machine(a: dict, p: dict, state, last: bool, emit):
    """Bands only tighten until price closes beyond them; the trend flips when the close crosses the active band."""
    up, dn, close, idx = a["up"], a["dn"], a["close"], a["bar_idx"]
    start = 0
    if state is None:
        state = [up[0], dn[0], 1.0, close[0]]
        start = 1
        if emit is not None:
            emit.append((int(idx[0]), 1.0, float(up[0]), float(dn[0])))
    top, bottom, trend, prev = state
    for i in range(start, len(close)):
        top = up[i] if up[i] < top or prev > top else top
        bottom = dn[i] if dn[i] > bottom or prev < bottom else bottom
        if trend > 0:
            trend = -1.0 if close[i] <= bottom else 1.0
        else:
            trend = 1.0 if close[i] >= top else -1.0
        prev = close[i]
        if emit is not None:
            emit.append((int(idx[i]), trend, float(top), float(bottom)))
    return [top, bottom, trend, prev]


@native_feature("TREND_SUPER_V1", "TREND", {"value": "trend", "upper": "upper", "lower": "lower"},
                int_param("length", 5, 20, 1, 7), float_param("multiplier", 1.0, 4.0, 0.5, 3.0))
def supertrend(bars, fid, grid=GRID, length=7, multiplier=3.0, block=BLOCK):
    """ATR counts as 0 until it is defined."""
    band = lambda k: lambda s: median_price() + k * multiplier * F.coalesce(atr_of(s, length), F.lit(0.0))
    df = _prepared(bars, {"up": band(1), "dn": band(-1), "close": lambda s: F.col("close")}, grid)
    out = relay(df, supertrend_machine, "bar_idx bigint, trend double, upper double, lower double", block=block)
    return _attach(bars, out, fid, ["trend", "upper", "lower"])


def psar_machine(a: dict, p: dict, state, last: bool, emit):
    """Wilder's stop-and-reverse.  State: up flag, acceleration, extreme, stop, two previous lows and highs, bars seen."""
    hi, lo, close, idx = a["high"], a["low"], a["close"], a["bar_idx"]
    step, cap = float(p["step"]), float(p["max_step"])
    if state is None:
        state = [1.0, step, hi[0], lo[0], close[0], lo[0], lo[0], hi[0], hi[0], 0.0]
    rising, acc, top, bottom, sar, low1, low2, high1, high2, seen = state
    for i in range(len(close)):
        if seen < 2:
            sar = close[i]
        elif rising:
            sar = sar + acc * (top - sar)
            if lo[i] < sar:
                rising, sar, bottom, acc = 0.0, top, lo[i], step
            else:
                if hi[i] > top:
                    top, acc = hi[i], min(acc + step, cap)
                sar = low2 if low2 < sar else (low1 if low1 < sar else sar)
        else:
            sar = sar - acc * (sar - bottom)
            if hi[i] > sar:
                rising, sar, top, acc = 1.0, bottom, hi[i], step
            else:
                if lo[i] < bottom:
                    bottom, acc = lo[i], min(acc + step, cap)
                sar = high2 if high2 > sar else (high1 if high1 > sar else sar)
        if emit is not None:
            shown = seen >= 2
            emit.append((int(idx[i]), float(sar), float(sar) if shown and rising else None, float(sar) if shown and not rising else None))
        low2, low1, high2, high1, seen = low1, lo[i], high1, hi[i], min(seen + 1, 2)
    return [rising, acc, top, bottom, sar, low1, low2, high1, high2, seen]


@native_feature("TREND_PSAR_V1", "TREND", {"value": "psar", "up": "up", "down": "down"},
                float_param("step", 0.01, 0.05, 0.01, 0.02), float_param("max_step", 0.1, 0.5, 0.1, 0.2))
def psar(bars, fid, grid=GRID, step=0.02, max_step=0.2, block=BLOCK):
    params = bars.sparkSession.range(1).select(F.lit(step).alias("step"), F.lit(max_step).alias("max_step"))
    out = relay(bars.select("symbol", "bar_idx", "high", "low", "close"), psar_machine,
                "bar_idx bigint, psar double, up double, down double", params=params, block=block)
    return _attach(bars, out, fid, ["psar", "up", "down"])


def kalman_machine(a: dict, p: dict, state, last: bool, emit):
    """One-dimensional Kalman filter with a bar-dependent measurement variance."""
    z, r, idx = a["close"], a["r"], a["bar_idx"]
    q, start = float(p["q"]), 0
    if state is None:
        state, start = [z[0], 1.0], 1
        if emit is not None:
            emit.append((int(idx[0]), float(z[0])))
    x, cov = state
    for i in range(start, len(z)):
        pred = cov + q
        gain = pred / (pred + r[i])
        x, cov = x + gain * (z[i] - x), (1.0 - gain) * pred
        if emit is not None:
            emit.append((int(idx[i]), float(x)))
    return [x, cov]


@native_feature("ADAPTIVE_KALMAN_V1", "ADAPTIVE", {"value": "adapt_kalman"},
                float_param("q", 1e-6, 1e-3, 1e-6, 1e-5), float_param("r", 0.001, 0.1, 0.001, 0.01))
def adaptive_kalman(bars, fid, grid=GRID, q=1e-5, r=0.01, block=BLOCK):
    """Measurement variance r * (1 + 100 * rolling deviation of returns); the deviation is 0.01 until defined."""
    noise = lambda s: F.lit(r) * (1 + 100 * F.coalesce(s.std(s.let("ret", s.pct("close")), 20), F.lit(0.01)))
    df = _prepared(bars, {"r": noise, "close": lambda s: F.col("close")}, grid)
    params = bars.sparkSession.range(1).select(F.lit(q).alias("q"))
    out = relay(df, kalman_machine, "bar_idx bigint, adapt_kalman double", params=params, block=block)
    return _attach(bars, out, fid, ["adapt_kalman"])
