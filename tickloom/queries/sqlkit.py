"""Small text helpers for the DuckDB side of the registered queries."""

from __future__ import annotations

from dataclasses import dataclass

from tickloom.functions.num import NUDGE

BARS_H = """bars_raw AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open,
         max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY ALL),
bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars_raw)"""

BARS_D = """ticks AS (
  SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, l_extendedprice / l_quantity AS p, l_quantity AS v,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem),
bars_raw AS MATERIALIZED (
  SELECT symbol, ts::TIMESTAMP AS ts, first(p ORDER BY o) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY o) AS close,
         sum(v) AS volume FROM ticks GROUP BY ALL),
bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars_raw)"""

CONTEXT = """context AS MATERIALIZED (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
    avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / 1000.0 AS spy_close,
    avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 6500.0 AS vix_close,
    avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') / 36000.0 AS us10y_close,
    avg(o_totalprice) FILTER (o_orderpriority = '4-NOT SPECIFIED') / 2000.0 AS hyg_close,
    avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') / 1500.0 AS dx_close,
    avg(o_totalprice) FILTER (o_orderstatus = 'O') / 5.0 AS btc_close, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 2500.0 AS uso_close
  FROM orders GROUP BY 1)"""

CONTEXT_COLS = ("spy_close", "vix_close", "us10y_close", "hyg_close", "dx_close", "btc_close", "uso_close")
_FILL = ", ".join(f"coalesce(last_value(c.{n} IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx), 0.0) AS {n}"
                  for n in CONTEXT_COLS)
BARS_C = f"""{BARS_D},
{CONTEXT},
bars_ctx AS MATERIALIZED (SELECT b.*, {_FILL} FROM bars b LEFT JOIN context c USING (ts))"""


@dataclass(frozen=True)
class Rec:
    """Columns defined by a row-by-row recursion: name -> (value at bar 0, step using r.* and x.*)."""

    cols: dict
    key: str = "symbol"


def ema(name: str, x: str, alpha: str | float) -> Rec:
    """Exponential smoother; leading NULLs are skipped, later NULLs keep the state."""
    return Rec({name: (x, f"CASE WHEN r.{name} IS NULL THEN x.{x} WHEN x.{x} IS NULL THEN r.{name} "
                          f"ELSE r.{name} * (1 - {alpha}) + x.{x} * {alpha} END")})


def emas(**specs) -> Rec:
    """Several smoothers in one recursion: name=(column, alpha)."""
    cols = {}
    for name, (x, alpha) in specs.items():
        cols.update(ema(name, x, alpha).cols)
    return Rec(cols)


def wilders(n: int, lead: int = 0, **specs) -> Rec:
    """Mean of the first n inputs, then (prev * (n - 1) + x) / n."""
    cols = {}
    for name, x in specs.items():
        k = f"least(x.bar_idx - {lead} + 1, {n})"
        init = x if lead == 0 else "0.0::DOUBLE"
        cols[name] = (init, f"CASE WHEN x.bar_idx < {lead} THEN r.{name} WHEN x.bar_idx = {lead} THEN x.{x} "
                            f"ELSE (r.{name} * ({k} - 1) + x.{x}) / {k} END")
    return Rec(cols)


def span(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


def over(n: int | None = None) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY symbol ORDER BY bar_idx{frame})"


def win(agg: str, x: str, n: int) -> str:
    """Aggregate over the last n rows, NULL until n values are there.  ``agg`` may be a template with {}."""
    call = agg.format(x) if "{}" in agg else f"{agg}({x})"
    return f"(CASE WHEN count({x}) {over(n)} = {n} THEN {call} {over(n)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {over()}"


def pct(x: str, n: int = 1) -> str:
    return f"(({x} - {lag(x, n)}) / nullif({lag(x, n)}, 0))"


def mask(x: str, first: int) -> str:
    return f"(CASE WHEN bar_idx >= {first} THEN {x} END)"


def chain(prefix: str, *layers, source: str = "bars", tag: str = "t") -> tuple[str, str]:
    """(CTE text, name of the last CTE) for a sequence of column layers and recursions."""
    ctes, prev = [prefix.removeprefix("WITH RECURSIVE ")], source
    for i, layer in enumerate(layers):
        cur, rec = f"{tag}{i}", f"{tag}r{i}"
        if isinstance(layer, Rec):
            init = ", ".join(f"({a})::DOUBLE AS {n}" for n, (a, _) in layer.cols.items())
            step = ", ".join(f"({b})::DOUBLE AS {n}" for n, (_, b) in layer.cols.items())
            names = ", ".join(f"r.{n}" for n in layer.cols)
            ctes.append(f"{rec} AS (SELECT symbol, bar_idx, {init} FROM {prev} WHERE bar_idx = 0 UNION ALL "
                        f"SELECT x.symbol, x.bar_idx, {step} FROM {rec} r JOIN {prev} x ON x.symbol = r.symbol AND x.bar_idx = r.bar_idx + 1)")
            ctes.append(f"{cur} AS MATERIALIZED (SELECT x.*, {names} FROM {prev} x JOIN {rec} r USING (symbol, bar_idx))")
        else:
            cols = ", ".join(f"{e} AS {n}" for n, e in layer.items())
            ctes.append(f"{cur} AS MATERIALIZED (SELECT *, {cols} FROM {prev})")
        prev = cur
    return "WITH RECURSIVE " + ",\n".join(ctes), prev


def r6(expr: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE * 10.0 ** -digits!r}::DOUBLE, {digits}) + 0.0"


def select(prefix: str, *layers, out: dict, digits: int = 6, keys: str = "symbol, bar_idx::BIGINT AS bar_idx",
           source: str = "bars", where: str = "") -> str:
    ctes, last = chain(prefix, *layers, source=source)
    cols = ", ".join(f"{r6(e, digits)} AS {n}" for n, e in out.items())
    return f"{ctes}\nSELECT {keys}, {cols} FROM {last} {where}"
