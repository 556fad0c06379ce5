"""Null-safe arithmetic.  Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str | float | int) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def div(num, den) -> Column:
    """Division that yields NULL on a zero denominator (ANSI mode raises)."""
    return F.try_divide(c(num).cast("double"), c(den).cast("double"))


def clip(x, lo: float | None, hi: float | None) -> Column:
    """Clamp that keeps NULL."""
    out = c(x)
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(float(hi))).otherwise(out)
    return out


def sign(x) -> Column:
    x = c(x)
    return F.when(x > 0, 1.0).when(x < 0, -1.0).when(x == 0, 0.0)


NUDGE = 0.0131719


def rnd(x, digits: int = 6) -> Column:
    """Rounded double for reports.  A fixed nudge keeps decimal ties off the rounding edge."""
    return F.round(c(x).cast("double") + F.lit(NUDGE * 10.0 ** -digits), digits) + F.lit(0.0)


def exact_mean(x, scale: int = 1) -> Column:
    """Aggregate: ``scale`` (below 100,000) times the mean, from a sum in decimals of 12 digits after the point, so the order of the rows never shows.

    A group with a value that is no such decimal (NaN, infinite, a billion or more) is summed in doubles.
    """
    x = c(x)
    d = x.try_cast("decimal(21,12)")
    total = F.when(F.count(d) == F.count(x), (F.sum(d) * F.lit(scale).cast("decimal(5,0)")).cast("double")).otherwise(F.sum(x) * scale)
    return div(total, F.count(x))


def flag(x) -> Column:
    """NULL condition counts as false."""
    return F.coalesce(c(x), F.lit(False))


def uniform(*key: Column) -> Column:
    """Uniform [0, 1) number derived from the md5 of the key, portable across engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
