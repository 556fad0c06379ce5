"""Backtest engines and the signal state gate as block machines (see ``relay``).

Machines emit trades or events only; curves, statistics and equity are derived relationally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.relay import BLOCK, first_at_or_after, relay


def _opt(v) -> float | None:
    return None if v is None or v != v else float(v)


def _first_price_hit(close: np.ndarray, lo: int, hi: int, up: float | None, down: float | None) -> tuple[int, str] | None:
    """First position in [lo, hi] where the close reaches the target or the stop (target checked first)."""
    for a in range(lo, hi + 1, 512):
        part = close[a:min(a + 512, hi + 1)]
        tp = part >= up if up is not None else np.zeros(len(part), bool)
        sl = part <= down if down is not None else np.zeros(len(part), bool)
        hit = np.flatnonzero(tp | sl)
        if len(hit):
            k = int(hit[0])
            return a + k, "TP" if tp[k] else "SL"
    return None


def _hold_until_exit(close, exits, base, entry, price, min_hold, max_hold, start, tp, sl):
    """(local position, reason) of the exit of a position entered at absolute bar ``entry``, or None."""
    end = len(close) - 1
    sig = first_at_or_after(exits, max(entry + 1 + max(min_hold, 0) - base, start))
    horizon = None if max_hold is None else max(entry + max(max_hold, 1) - base, start)
    stop_at = min(x for x in (sig, horizon, end) if x is not None)
    hit = _first_price_hit(close, start, stop_at, None if tp is None else price * (1.0 + tp), None if sl is None else price * (1.0 - sl))
    if sig is not None and sig <= stop_at and (hit is None or sig <= hit[0]):
        return sig, "AGENT_EXIT"
    if hit is not None:
        return hit
    if horizon is not None and horizon <= end:
        return horizon, "HORIZON"
    return None


def close_machine(a: dict, p: dict, state, last: bool, emit):
    """Long-only fills at the close.  State: long flag, entry bar, entry price, min hold, max hold (-1 = none).

    A bar with entry and exit signals does nothing, but an open position keeps ageing on it.
    """
    close, idx = a["close"], a["bar_idx"]
    base = int(idx[0])
    conflict = a["entry"] & a["exit"]
    entries, exits = np.flatnonzero(a["entry"] & ~conflict), np.flatnonzero(a["exit"] & ~conflict)
    tp, sl, horizon = _opt(p.get("tp_pct")), _opt(p.get("sl_pct")), _opt(p.get("max_hold"))
    cost = float(p.get("cost_bps") or 0.0) / 10000.0
    own_hold = "hold_min" in a
    pos, e, price, lo_hold, hi_hold = (0, 0, 0.0, 0, -1) if state is None else state
    at = 0

    def record(exit_abs, exit_price, reason, still_open=False):
        if emit is not None:
            net = (exit_price * (1.0 - cost)) / (price * (1.0 + cost)) - 1.0
            emit.append((int(e), int(exit_abs), float(price), float(exit_price), net * 100.0, reason, int(exit_abs - e), still_open))

    while True:
        if not pos:
            i = first_at_or_after(entries, at)
            if i is None:
                break
            pos, e, price = 1, base + i, float(close[i])
            lo_hold, hi_hold = 0, -1 if horizon is None else int(horizon)
            if own_hold:
                lo_hold, hi_hold = max(int(a["hold_min"][i]), 0), int(a["hold_max"][i])
            if hi_hold >= 0:
                hi_hold = max(hi_hold, lo_hold)
            at = i + 1
        if at >= len(close):
            break
        out = _hold_until_exit(close, exits, base, int(e), price, int(lo_hold), None if hi_hold < 0 else int(hi_hold), at, tp, sl)
        if out is None:
            break
        record(base + out[0], float(close[out[0]]), out[1])
        pos, at = 0, out[0] + 1
    if last and pos:
        record(base + len(close) - 1, float(close[-1]), "HORIZON", True)
    return [pos, e, price, lo_hold, hi_hold] if pos else [0, 0, 0.0, 0, -1]


TRADES = ("entry_idx bigint, exit_idx bigint, entry_price double, exit_price double, return_pct double, "
          "exit_reason string, bars int, open_at_end boolean")


def close_engine(signals: DataFrame, params: DataFrame, keys=("policy_id", "symbol"), param_keys=("sample_id",),
                 block: int = BLOCK) -> DataFrame:
    """Trades of the close-fill engine.

    ``signals``: keys, bar_idx, close, entry, exit (optionally hold_min, hold_max).  ``params``: some of the
    keys, param_keys, tp_pct, sl_pct, max_hold, cost_bps (NULL = rule off).
    """
    cols = [*keys, "bar_idx", "close", "entry", "exit", *[c for c in ("hold_min", "hold_max") if c in signals.columns]]
    return relay(signals.select(*cols), close_machine, TRADES, keys, params=params, param_keys=param_keys, block=block)


def gate_machine(a: dict, p: dict, state, last: bool, emit):
    """Keep entries while flat and exits while long; target, stop and maximum hold move the state silently."""
    close, idx = a["close"], a["bar_idx"]
    base = int(idx[0])
    entries, exits = np.flatnonzero(a["entry"]), np.flatnonzero(a["exit"])
    tp, sl = _opt(p.get("tp_pct")), _opt(p.get("sl_pct"))
    pos, e, price, lo_hold, hi_hold = (0, 0, 0.0, 0, -1) if state is None else state
    at = 0
    while True:
        if not pos:
            i = first_at_or_after(entries, at)
            if i is None:
                break
            lo_hold, hi_hold = int(a["hold_min"][i]), int(a["hold_max"][i])
            pos, e, price, hi_hold, at = 1, base + i, float(close[i]), max(hi_hold, lo_hold), i + 1
            if emit is not None:
                emit.append((int(e), True, False))
        if at >= len(close):
            break
        out = _hold_until_exit(close, exits, base, int(e), price, int(lo_hold), int(hi_hold), at, tp, sl)
        if out is None:
            break
        if out[1] == "AGENT_EXIT" and emit is not None:
            emit.append((base + out[0], False, True))
        pos, at = 0, out[0] + 1
    return [pos, e, price, lo_hold, hi_hold] if pos else [0, 0, 0.0, 0, -1]


def state_gate(signals: DataFrame, params: DataFrame, keys=("policy_id", "symbol"), block: int = BLOCK) -> DataFrame:
    """Signals with gated ``entry`` and ``exit``; input needs close, entry, exit, hold_min, hold_max."""
    cols = [*keys, "bar_idx", "close", "entry", "exit", "hold_min", "hold_max"]
    kept = relay(signals.select(*cols), gate_machine, "bar_idx bigint, g_entry boolean, g_exit boolean", keys,
                 params=params, block=block)
    return (
        signals.join(kept, [*keys, "bar_idx"], "left")
        .withColumn("entry", F.coalesce("g_entry", F.lit(False))).withColumn("exit", F.coalesce("g_exit", F.lit(False)))
        .drop("g_entry", "g_exit")
    )


def _slip(price: float, p: dict) -> float:
    mode, v = p.get("slippage_mode", "ticks"), float(p.get("slippage_value") or 0.0)
    return {"ticks": v * float(p.get("tick_size") or 0.01), "bps": price * v / 1e4, "percent": price * v / 100.0}[mode]


def intrabar_machine(a: dict, p: dict, state, last: bool, emit):
    """Next-open or close fills with intrabar target and stop.

    State: long flag, entry bar, fill price, entry slippage, bars held, pending entry, pending exit.
    Decisions do not depend on the account equity, which is derived from the trades afterwards.
    """
    o, h, l, c = a["open"], a["high"], a["low"], a["close"]
    ent, ext, base = a["entry"], a["exit"], int(a["bar_idx"][0])
    tp, sl, horizon = _opt(p.get("tp_pct")), _opt(p.get("sl_pct")), _opt(p.get("max_hold"))
    on_close, stop_first = p["timing"] == "close", p["priority"] != "target_first"
    again = bool(p.get("same_bar_reentry"))
    pos, e, price, eslip, held, pend_in, pend_out = (0, 0, 0.0, 0.0, 0, 0, 0) if state is None else state
    n = len(c)
    entry_at = np.flatnonzero(ent)

    def leave(i, raw, reason):
        s = _slip(raw, p)
        if emit is not None:
            emit.append((int(e), base + i, float(price), float(raw - s), float(eslip), float(s), reason))

    i = 0
    while i < n:
        if not pos and not pend_in:
            nxt = first_at_or_after(entry_at, i)
            if nxt is None:
                break
            i = nxt
        done, end_of_data = False, last and i == n - 1
        if not pos and pend_in:
            eslip = _slip(o[i], p)
            pos, e, price, held = 1, base + i, o[i] + eslip, 0
        pend_in = 0
        if pos and pend_out:
            leave(i, o[i], "signal")
            pos, done = 0, True
        pend_out = 0
        if pos:
            held += 1
            if tp and sl:
                top, bottom = price * (1.0 + tp), price * (1.0 - sl)
                up, dn = h[i] >= top, l[i] <= bottom
                if up or dn:
                    stop = dn and (stop_first or not up)
                    leave(i, bottom if stop else top, "sl" if stop else "tp")
                    pos, done = 0, True
        if pos and horizon is not None and held >= horizon:
            leave(i, c[i], "time")
            pos, done = 0, True
        if pos and ext[i]:
            if on_close:
                leave(i, c[i], "signal")
                pos, done = 0, True
            elif not end_of_data:
                pend_out = 1
        if not pos and ent[i] and (again or not done):
            if on_close:
                eslip = _slip(c[i], p)
                pos, e, price, held = 1, base + i, c[i] + eslip, 0
            elif not end_of_data:
                pend_in = 1
        i += 1
    if last and pos:
        leave(n - 1, c[-1], "eod")
    return [pos, e, price, eslip, held, pend_in, pend_out] if pos else [0, 0, 0.0, 0.0, 0, pend_in, 0]


INTRABAR = ("entry_idx bigint, exit_idx bigint, entry_price double, exit_price double, entry_slip double, "
            "exit_slip double, reason string")


def intrabar_engine(signals: DataFrame, params: DataFrame, keys=("policy_id", "symbol"), param_keys=("sample_id",),
                    block: int = BLOCK) -> DataFrame:
    """Trades of the intrabar engine.  ``params`` adds timing, priority, slippage_mode, slippage_value, tick_size."""
    cols = [*keys, "bar_idx", "open", "high", "low", "close", "entry", "exit"]
    return relay(signals.select(*cols), intrabar_machine, INTRABAR, keys, params=params, param_keys=param_keys, block=block)


def signal_machine(a: dict, p: dict, state, last: bool, emit):
    """Long/short fills at the next open; stop before target inside a bar, then horizon, then signal change.

    State: direction, entry bar, entry price, bars held, pending direction.  A filled order is cleared.
    """
    o, h, l, c, sig = a["open"], a["high"], a["low"], a["close"], a["signal"]
    base, n = int(a["bar_idx"][0]), len(c)
    tp, sl, horizon = float(p["tp_pct"]), float(p["sl_pct"]), int(p["max_hold"])
    cost = 2.0 * float(p["cost_bps"]) / 10000.0
    regime, target = a.get("regime"), p.get("target_regime")
    pos, e, price, held, pend = (0, 0, 0.0, 0, 0) if state is None else state
    active = np.flatnonzero(sig != 0)

    def leave(i, px, reason):
        if emit is not None:
            ok = regime is None or target is None or regime[i] == target
            ret = (px / price - 1.0) * pos - cost
            emit.append((int(e), base + i, int(pos), float(price), float(px), ret * 100.0, reason, int(held), bool(ok)))

    i = 0
    while i < n:
        if not pos and not pend:
            nxt = first_at_or_after(active, i)
            if nxt is None:
                break
            i = nxt
        if pend:
            pos, e, price, held, pend = pend, base + i, float(o[i]), 0, 0
        if not pos:
            if sig[i] != 0 and not (last and i == n - 1):
                pend = int(np.sign(sig[i]))
            i += 1
            continue
        held += 1
        goal, stop = price * (1.0 + pos * tp), price * (1.0 - pos * sl)
        won = h[i] >= goal if pos > 0 else l[i] <= goal
        lost = l[i] <= stop if pos > 0 else h[i] >= stop
        if lost:
            leave(i, stop, "SL")
        elif won:
            leave(i, goal, "TP")
        elif held >= horizon:
            leave(i, c[i], "HORIZON")
        elif sig[i] == 0 or sig[i] != pos:
            leave(i, c[i], "AGENT_EXIT")
        else:
            i += 1
            continue
        pos = 0
        i += 1
    if last and pos:
        leave(n - 1, c[-1], "HORIZON")
    return [pos, e, price, held, pend] if pos else [0, 0, 0.0, 0, pend]


SIGNAL_TRADES = ("entry_idx bigint, exit_idx bigint, direction int, entry_price double, exit_price double, "
                 "return_pct double, exit_reason string, bars int, is_valid boolean")


def signal_engine(signals: DataFrame, params: DataFrame, keys=("policy_id", "symbol"), param_keys=("sample_id",),
                  block: int = BLOCK) -> DataFrame:
    cols = [*keys, "bar_idx", "open", "high", "low", "close", "signal", *[c for c in ("regime",) if c in signals.columns]]
    return relay(signals.select(*cols), signal_machine, SIGNAL_TRADES, keys, params=params, param_keys=param_keys, block=block)
