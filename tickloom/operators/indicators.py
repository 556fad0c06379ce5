"""Registry features.  Warm-up rows are NULL; definitions are the published indicator definitions.

Where published definitions differ in seeding, the docstring of the helper states the choice:
EMA is seeded by its first input and shown once n inputs exist, Wilder smoothing is seeded by the
mean of its first n inputs, RSI uses an exponential mean with alpha 1/n of gains and losses.

Parameter names, ranges, steps and defaults are fixed values: genomes are validated and mutated by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.num import c, clip, div
from tickloom.operators.features import Scope, State, feature, float_param, int_param

EPS = 1e-9


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def median_price() -> Column:
    return (F.col("high") + F.col("low")) / 2


def true_range(s: Scope) -> Column:
    """max(H-L, |H-pc|, |L-pc|); the first bar has only H-L."""
    pc = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def rsi_of(s: Scope, n: int, name: str = "rsi") -> Column:
    d = s.let(name + "_d", s.diff("close"))
    gain = s.ewm(name + "_g", F.when(d > 0, d).otherwise(0.0), 1.0 / n).col
    loss = s.ewm(name + "_l", F.when(d < 0, -d).otherwise(0.0), 1.0 / n).col
    return s.let(name, s.mask(F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + div(gain, loss))), n - 1))


def atr_of(s: Scope, n: int, name: str = "atr") -> Column:
    return s.let(name, s.wilder(name + "_w", true_range(s), n))


def rank_last(s: Scope, x, n: int) -> Column:
    """Percent rank of the last element of the frame, ties averaged."""
    arr = s.array(x, n)
    less = F.size(F.filter(arr, lambda v: v < c(x)))
    same = F.size(F.filter(arr, lambda v: v == c(x)))
    return F.when(arr.isNotNull(), (less + (same + 1) / 2.0) / float(n))


def money_flow_value() -> Column:
    """Close location value times volume; 0 on a flat bar."""
    h, l, cl = F.col("high"), F.col("low"), F.col("close")
    return F.coalesce(div((cl - l) - (h - cl), h - l), F.lit(0.0)) * F.col("volume")


# -- volatility ------------------------------------------------------------------------------

@feature("VOLATILITY_ATR_V1", "VOLATILITY", {"value": "atr", "atr_norm": "atr_norm", "velocity": "velocity", "persist_low": "persist_low"},
         int_param("window", 5, 50, 1, 14))
def atr(s: Scope, window):
    a = atr_of(s, window)
    norm = s.let("norm", div(a, "close") * 100)
    low = s.let("low", F.coalesce(norm < s.quantile(norm, 0.2, 100), F.lit(False)))
    return {"atr": a, "atr_norm": norm, "velocity": s.let("vel", s.diff(a, 5)), "persist_low": s.run_length("run", low)}


def bands(s: Scope, n: int, dev: float):
    m, sd = s.let("m", s.avg("close", n)), s.let("sd", s.pstd("close", n))
    return m, m + dev * sd, m - dev * sd


@feature("VOLATILITY_BB_V1", "VOLATILITY", {"upper": "upper", "lower": "lower", "width": "width", "squeeze": "squeeze"},
         int_param("window", 10, 50, 1, 20), float_param("std_dev", 1.0, 3.0, 0.1, 2.0))
def bb(s: Scope, window, std_dev):
    m, up, lo = bands(s, window, std_dev)
    width = s.let("width", div(up - lo, m) * 100)
    return {"upper": up, "lower": lo, "width": width, "squeeze": s.let("squeeze", rank_last(s, width, 100))}


@feature("VOLATILITY_BB_ADV_V1", "VOLATILITY", {"value": "pct_b", "width": "width"},
         int_param("window", 10, 50, 1, 20), float_param("std_dev", 1.5, 3.0, 0.1, 2.0))
def bb_adv(s: Scope, window, std_dev):
    m, up, lo = bands(s, window, std_dev)
    return {"pct_b": div(F.col("close") - lo, up - lo), "width": div(up - lo, m) * 100}


@feature("VOLATILITY_KC_V1", "VOLATILITY", {"value": "upper", "upper": "upper", "lower": "lower"},
         int_param("length", 10, 50, 1, 20), float_param("scalar", 1.0, 3.0, 0.1, 2.0))
def keltner(s: Scope, length, scalar):
    mid, a = s.ema("mid", "close", length).col, atr_of(s, length)
    return {"upper": mid + scalar * a, "lower": mid - scalar * a}


@feature("VOLATILITY_KC_WIDTH_V1", "VOLATILITY", {"high": "high", "low": "low", "width": "width"}, int_param("length", 10, 50, 1, 20))
def keltner_width(s: Scope, length):
    h, l, cl = F.col("high"), F.col("low"), F.col("close")
    mid = s.let("mid", s.avg(typical(), length))
    up = s.let("up", s.avg((4 * h - 2 * l + cl) / 3, length))
    lo = s.let("lo", s.avg((-2 * h + 4 * l + cl) / 3, length))
    return {"high": up, "low": lo, "width": div(up - lo, mid) * 100}


@feature("VOLATILITY_DONCHIAN_V1", "VOLATILITY", {"value": "high", "upper": "high", "lower": "low"},
         int_param("lower_length", 10, 50, 1, 20), int_param("upper_length", 10, 50, 1, 20))
def donchian(s: Scope, lower_length, upper_length):
    n = max(lower_length, upper_length)
    return {"high": s.let("h", s.max("high", n)), "low": s.let("l", s.min("low", n))}


@feature("VOLATILITY_DC_V1", "VOLATILITY", {"high": "dc_high", "low": "dc_low", "mid": "dc_mid", "width": "dc_width"}, int_param("window", 10, 50, 1, 20))
def donchian_full(s: Scope, window):
    h, l, m = s.let("h", s.max("high", window)), s.let("l", s.min("low", window)), s.let("m", s.avg("close", window))
    return {"dc_high": h, "dc_low": l, "dc_mid": (h + l) / 2, "dc_width": div(h - l, m) * 100}


@feature("VOLATILITY_UI_V1", "VOLATILITY", {"value": "ui"}, int_param("length", 5, 30, 1, 14))
def ulcer(s: Scope, length):
    peak = s.let("peak", s.max("close", length))
    dd = s.let("dd", F.pow(div(100 * (F.col("close") - peak), peak), 2))
    return {"ui": F.sqrt(s.let("ms", s.avg(dd, length)))}


@feature("VOLATILITY_CV_V1", "VOLATILITY", {"value": "cv"}, int_param("window", 5, 30, 1, 10), int_param("roc_window", 5, 30, 1, 10))
def chaikin_volatility(s: Scope, window, roc_window):
    e = s.let("e", s.ema("ema", F.col("high") - F.col("low"), window, guard=False).col)
    return {"cv": s.let("cv", s.pct(e, roc_window) * 100)}


@feature("VOLATILITY_RVI_V1", "VOLATILITY", {"value": "rvi"}, int_param("height", 5, 50, 1, 14), int_param("length", 10, 30, 1, 14))
def relative_volatility(s: Scope, height, length):
    """Rows whose 10-bar deviation is not defined yet count as 0."""
    sd, d = s.let("sd", s.std("close", 10)), s.let("d", s.diff("close"))
    up = s.ewm("up", F.when(d > 0, F.coalesce(sd, F.lit(0.0))).otherwise(0.0), 1.0 / length).col
    dn = s.ewm("dn", F.when(d < 0, F.coalesce(sd, F.lit(0.0))).otherwise(0.0), 1.0 / length).col
    return {"rvi": 100 * up / (up + dn + EPS)}


@feature("VOLATILITY_ENV_V1", "VOLATILITY", {"value": "upper", "upper": "upper", "lower": "lower"},
         int_param("length", 10, 50, 1, 20), float_param("pct", 0.01, 0.1, 0.01, 0.05))
def envelope(s: Scope, length, pct):
    m = s.let("m", s.avg("close", length))
    return {"upper": m * (1 + pct), "lower": m * (1 - pct)}


@feature("VOLATILITY_STD_V1", "VOLATILITY", {"value": "std"}, int_param("length", 10, 50, 1, 20))
def std_dev(s: Scope, length):
    return {"std": s.let("sd", s.std("close", length))}


@feature("VOLATILITY_KALMAN_V1", "VOLATILITY", {"value": "kalman"}, float_param("r_ratio", 0.01, 0.5, 0.01, 0.1))
def kalman(s: Scope, r_ratio):
    """The covariance follows a Moebius map with constant coefficients, so the gain of bar t is closed form."""
    q, r = 1e-5, r_ratio ** 2
    root = math.sqrt(q * q + 4 * q * r)
    hi, lo = (q + root) / 2, (q - root) / 2
    ratio, start = (r + lo) / (r + hi), (1.0 + q - hi) / (1.0 + q - lo)
    m = F.lit(start) * F.pow(F.lit(ratio), F.col("bar_idx") - 1)
    pred = (F.lit(hi) - F.lit(lo) * m) / (1 - m)
    gain = pred / (pred + r)
    return {"kalman": s.scan("x", 1 - gain, gain * F.col("close"), seed=F.when(F.col("bar_idx") == 0, F.col("close")),
                             valid=F.col("bar_idx") >= 1)}


# -- momentum --------------------------------------------------------------------------------

@feature("MOMENTUM_RSI_V1", "MOMENTUM", {"value": "rsi", "velocity": "velocity", "persist_os": "persist_os", "persist_ob": "persist_ob"},
         int_param("window", 5, 50, 1, 14))
def rsi(s: Scope, window):
    r = rsi_of(s, window)
    return {"rsi": r, "velocity": s.let("vel", s.diff(r, 3)), "persist_os": s.run_length("os", r < 30),
            "persist_ob": s.run_length("ob", r > 70)}


def _macd(s: Scope, fast, slow, signal):
    macd = s.ema("f", "close", fast) - s.ema("s", "close", slow)
    line, sig = macd.col, s.ema("g", macd, signal, lead=slow - 1).col
    return {"line": line, "diff": line - sig, "signal": sig}


_MACD_PARAMS = (int_param("fast", 5, 20, 1, 12), int_param("slow", 21, 50, 1, 26), int_param("signal", 5, 15, 1, 9))
_MACD_OUT = {"value": "line", "diff": "diff", "signal": "signal"}
feature("MOMENTUM_MACD_V1", "MOMENTUM", _MACD_OUT, *_MACD_PARAMS)(_macd)
feature("TREND_MACD_V1", "TREND", _MACD_OUT, *_MACD_PARAMS)(_macd)


def _stoch(s: Scope, window, smooth_k, smooth_d):
    lo, hi = s.let("lo", s.min("low", window)), s.let("hi", s.max("high", window))
    k = s.let("k", 100 * div(F.col("close") - lo, hi - lo))
    return {"k": k, "d": s.let("d", s.avg(k, smooth_k))}


_STOCH = (int_param("window", 5, 50, 1, 14), int_param("smooth_k", 1, 10, 1, 3), int_param("smooth_d", 1, 10, 1, 3))
feature("MEANREV_STOCH_V1", "MEANREV", {"value": "k", "signal": "d"}, *_STOCH)(_stoch)
feature("MOMENTUM_STOCH_V1", "MOMENTUM", {"value": "k", "signal": "d"}, *_STOCH)(_stoch)


@feature("MOMENTUM_CCI_V1", "MOMENTUM", {"value": "cci"}, int_param("length", 10, 100, 1, 20), float_param("c", 0.01, 0.05, 0.001, 0.015))
def cci(s: Scope, length, c):  # noqa: A002
    tp = s.let("tp", typical())
    m, arr = s.let("m", s.avg(tp, length)), s.let("arr", s.array(tp, length))
    mad = F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + F.abs(v - m)) / length
    return {"cci": div(tp - m, c * mad)}


def _roc(s: Scope, length):
    return {"roc": s.let("roc", s.pct("close", length) * 100)}


feature("MOMENTUM_ROC_V1", "MOMENTUM", {"value": "roc"}, int_param("length", 1, 30, 1, 10))(_roc)
feature("MOMENTUM_ROC12_V1", "MOMENTUM", {"value": "roc"}, int_param("length", 1, 50, 1, 12))(_roc)


@feature("MOMENTUM_WILLR_V1", "MOMENTUM", {"value": "willr"}, int_param("length", 5, 30, 1, 14))
def williams(s: Scope, length):
    hi, lo = s.let("hi", s.max("high", length)), s.let("lo", s.min("low", length))
    return {"willr": -100 * div(hi - F.col("close"), hi - lo)}


@feature("MOMENTUM_MOM_V1", "MOMENTUM", {"value": "mom"}, int_param("length", 1, 50, 1, 10))
def momentum(s: Scope, length):
    return {"mom": s.let("mom", s.diff("close", length))}


@feature("MOMENTUM_CMO_V1", "MOMENTUM", {"value": "cmo"}, int_param("length", 5, 30, 1, 14))
def cmo(s: Scope, length):
    return {"cmo": (rsi_of(s, length) - 50) * 2}


@feature("MOMENTUM_CMO_SUM_V1", "MOMENTUM", {"value": "cmo"}, int_param("length", 5, 50, 1, 14))
def cmo_sum(s: Scope, length):
    d = s.let("d", s.diff("close"))
    up = s.let("up", s.sum(F.greatest(d, F.lit(0.0) * d), length))
    dn = s.let("dn", s.sum(-F.least(d, F.lit(0.0) * d), length))
    return {"cmo": 100 * (up - dn) / (up + dn + EPS)}


@feature("MOMENTUM_AO_V1", "MOMENTUM", {"value": "ao"}, int_param("fast", 2, 10, 1, 5), int_param("slow", 20, 50, 1, 34))
def awesome(s: Scope, fast, slow):
    return {"ao": s.let("ao", s.avg(median_price(), fast) - s.avg(median_price(), slow))}


@feature("MOMENTUM_TSI_V1", "MOMENTUM", {"value": "tsi"}, int_param("high_len", 15, 40, 1, 25), int_param("low_len", 5, 20, 1, 13))
def tsi(s: Scope, high_len, low_len):
    d = s.let("d", s.diff("close"))
    one, two = s.ema("a", d, high_len, 1), s.ema("b", F.abs(d), high_len, 1)
    num, den = s.ema("c", one, low_len, high_len), s.ema("e", two, low_len, high_len)
    return {"tsi": 100 * div(num.col, den.col)}


def _kst(s: Scope, r1, r2, r3, r4):
    terms = [s.let(f"r{i}", s.avg(s.let(f"p{i}", s.pct("close", r)), w))
             for i, (r, w) in enumerate(((r1, 10), (r2, 10), (r3, 10), (r4, 15)), 1)]
    k = s.let("k", 100 * (terms[0] + 2 * terms[1] + 3 * terms[2] + 4 * terms[3]))
    sig = s.let("sig", s.avg(k, 9))
    return {"kst": k, "signal": sig, "diff": k - sig}


_KST = (int_param("r1", 5, 15, 1, 10), int_param("r2", 10, 20, 1, 15), int_param("r3", 15, 25, 1, 20), int_param("r4", 20, 40, 1, 30))
feature("MOMENTUM_KST_V1", "MOMENTUM", {"value": "kst", "signal": "signal"}, *_KST)(_kst)
feature("TREND_KST_V1", "TREND", {"value": "kst", "signal": "signal", "diff": "diff"}, *_KST)(_kst)


def _vortex(s: Scope, length):
    tr = s.let("tr", true_range(s))
    up = s.let("up", F.abs(F.col("high") - s.lag("low")))
    dn = s.let("dn", F.abs(F.col("low") - s.lag("high")))
    total = s.let("total", s.sum(tr, length))
    pos, neg = div(s.let("sp", s.sum(up, length)), total), div(s.let("sn", s.sum(dn, length)), total)
    return {"pos": pos, "neg": neg, "diff": pos - neg}


feature("MOMENTUM_VORTEX_V1", "MOMENTUM", {"value": "diff", "pos": "pos", "neg": "neg"}, int_param("length", 5, 50, 1, 14))(_vortex)
feature("TREND_VORTEX_V1", "TREND", {"value": "diff", "pos": "pos", "neg": "neg"}, int_param("length", 5, 50, 1, 14))(_vortex)


@feature("MOMENTUM_PMO_V1", "MOMENTUM", {"value": "pmo", "signal": "signal"}, int_param("len1", 20, 50, 1, 35), int_param("len2", 10, 30, 1, 20))
def pmo(s: Scope, len1, len2):
    one = s.ema("a", F.coalesce(s.pct("close") * 100, F.when(F.col("bar_idx") > 0, 0.0)), len1, 1, guard=False)
    two = s.ema("b", one, len2, 1, guard=False)
    return {"pmo": two.col, "signal": s.ema("c", two, 10, 1, guard=False).col}


def _force(s: Scope, length):
    return {"efi": s.ema("f", s.diff("close") * F.col("volume"), length, 1).col}


feature("MOMENTUM_EFI_V1", "MOMENTUM", {"value": "efi"}, int_param("length", 5, 30, 1, 13))(_force)
feature("VOLUME_FI_V1", "VOLUME", {"value": "efi"}, int_param("length", 5, 50, 1, 13))(_force)


@feature("MOMENTUM_PAM_V1", "MOMENTUM", {"value": "pam"}, int_param("length", 5, 30, 1, 10))
def pam(s: Scope, length):
    return {"pam": s.let("z", (F.col("close") - s.avg("close", length)) / (s.std("close", length) + EPS))}


@feature("MOMENTUM_UO_V1", "MOMENTUM", {"value": "uo"})
def ultimate(s: Scope):
    pc = s.let("pc", s.lag("close"))
    bp = s.let("bp", F.col("close") - F.least("low", pc))
    tr = s.let("tr", F.greatest("high", pc) - F.least("low", pc))
    ratio = {n: div(s.let(f"b{n}", s.sum(bp, n)), s.let(f"t{n}", s.sum(tr, n))) for n in (7, 14, 28)}
    return {"uo": 100 * (4 * ratio[7] + 2 * ratio[14] + ratio[28]) / 7}


def _percent_oscillator(s: Scope, col: str):
    f, sl = s.ema("f", col, 12).col, s.ema("s", col, 26).col
    line = s.let("line", div(f - sl, sl) * 100)
    sig = s.ema("g", line, 9, lead=25, gaps=True).col
    return line, sig


@feature("MOMENTUM_PPO_V1", "MOMENTUM", {"value": "ppo", "signal": "ppo_signal", "hist": "ppo_hist"})
def ppo(s: Scope):
    line, sig = _percent_oscillator(s, "close")
    return {"ppo": line, "ppo_signal": sig, "ppo_hist": line - sig}


@feature("MOMENTUM_PVO_V1", "MOMENTUM", {"value": "pvo", "signal": "pvo_signal", "hist": "pvo_hist"})
def pvo(s: Scope):
    line, sig = _percent_oscillator(s, "volume")
    return {"pvo": line, "pvo_signal": sig, "pvo_hist": line - sig}


# -- trend -----------------------------------------------------------------------------------

@feature("TREND_MACROSS_V1", "TREND", {"value": "spread"}, int_param("fast", 5, 50, 1, 20), int_param("slow", 20, 200, 1, 60),
         ("ma_type", "category", None, None, "sma"))
def ma_cross(s: Scope, fast, slow, ma_type):
    if ma_type == "ema":
        f, sl = s.ema("f", "close", fast).col, s.ema("s", "close", slow).col
    else:
        f, sl = s.let("f", s.avg("close", fast)), s.let("s", s.avg("close", slow))
    return {"spread": (f - sl) / (sl + 1e-6)}


@feature("TREND_SMA_V1", "TREND", {"value": "sma"}, int_param("window", 5, 50, 5, 20))
def sma(s: Scope, window):
    return {"sma": s.let("m", s.avg("close", window))}


@feature("TREND_EMA_V1", "TREND", {"value": "ema"}, int_param("window", 5, 50, 5, 20))
def ema(s: Scope, window):
    return {"ema": s.ema("e", "close", window, guard=False).col}


@feature("TREND_WMA_V1", "TREND", {"value": "wma"}, int_param("window", 5, 50, 5, 20))
def wma(s: Scope, window):
    arr = s.let("arr", s.array("close", window))
    total = F.aggregate(F.transform(arr, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return {"wma": total / (window * (window + 1) / 2)}


def adx_of(s: Scope, n: int, name: str = "adx"):
    """Wilder ADX; a bar without any directional movement has DX 0."""
    up, dn = s.let(name + "_u", s.diff("high")), s.let(name + "_v", -s.diff("low"))
    tr = s.let(name + "_t", F.when(s.lag("close").isNotNull(), true_range(s)))
    plus = F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0))
    minus = F.when(dn.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0))
    atr_ = s.wilder(name + "_wt", tr, n, 1)
    pos = s.let(name + "_p", 100 * div(s.wilder(name + "_wp", plus, n, 1), atr_))
    neg = s.let(name + "_n", 100 * div(s.wilder(name + "_wn", minus, n, 1), atr_))
    dx = s.let(name + "_dx", s.mask(F.coalesce(100 * div(F.abs(pos - neg), pos + neg), F.lit(0.0)), n))
    return s.let(name, s.wilder(name + "_wd", dx, n, n)), pos, neg


@feature("TREND_ADX_V1", "TREND", {"value": "adx", "pos": "pos", "neg": "neg"}, int_param("length", 5, 50, 1, 14))
def adx(s: Scope, length):
    a, pos, neg = adx_of(s, length)
    return {"adx": a, "pos": pos, "neg": neg}


def _trix(s: Scope, length):
    e = s.ema("c", s.ema("b", s.ema("a", "close", length), length, length - 1), length, 2 * (length - 1))
    e = s.let("e3", e.col)
    return {"trix": s.let("t", s.pct(e) * 100)}


feature("TREND_TRIX_V1", "TREND", {"value": "trix"}, int_param("length", 10, 50, 1, 30))(_trix)
feature("TREND_TRIX15_V1", "TREND", {"value": "trix"}, int_param("length", 5, 50, 1, 15))(_trix)


@feature("TREND_ICHIMOKU_V1", "TREND", {"value": "conv", "conv": "conv", "base": "base", "spanA": "spanA", "spanB": "spanB"},
         int_param("tenkan", 5, 20, 1, 9), int_param("kijun", 20, 40, 1, 26), int_param("senkou", 40, 60, 1, 52))
def ichimoku(s: Scope, tenkan, kijun, senkou):
    mid = lambda name, n: s.let(name, (s.max("high", n) + s.min("low", n)) / 2)
    conv, base = mid("conv", tenkan), mid("base", kijun)
    return {"conv": conv, "base": base, "spanA": (conv + base) / 2, "spanB": mid("b", senkou)}


@feature("TREND_SUPER_DIST_V1", "TREND", {"up": "dist_up", "down": "dist_down"}, int_param("length", 5, 30, 1, 7), float_param("multiplier", 1.0, 5.0, 0.1, 3.0))
def super_distance(s: Scope, length, multiplier):
    a, hl2, cl = atr_of(s, length), median_price(), F.col("close")
    return {"dist_up": div(cl - (hl2 + multiplier * a), cl), "dist_down": div(cl - (hl2 - multiplier * a), cl)}


@feature("TREND_AROON_V1", "TREND", {"value": "ind", "up": "up", "down": "down"}, int_param("length", 10, 50, 1, 25))
def aroon(s: Scope, length):
    """Position of the earliest extreme among the last length + 1 bars, in percent."""
    w = s.frame(length + 1)
    n = F.count(F.lit(1)).over(w)
    hi = F.max_by("bar_idx", F.struct(F.col("high"), -F.col("bar_idx"))).over(w)
    lo = F.min_by("bar_idx", F.struct(F.col("low"), F.col("bar_idx"))).over(w)
    since = lambda at: F.when(n == length + 1, 100.0 * (length - (F.col("bar_idx") - at)) / length)
    up, dn = s.let("up", since(hi)), s.let("dn", since(lo))
    return {"up": up, "down": dn, "ind": up - dn}


@feature("TREND_MASS_V1", "TREND", {"value": "mass_index"})
def mass(s: Scope):
    one = s.ema("a", F.col("high") - F.col("low"), 9)
    two = s.ema("b", one, 9, 8)
    ratio = s.let("ratio", div(one.col, two.col))
    return {"mass_index": s.let("m", s.sum(ratio, 25))}


@feature("TREND_DPO_V1", "TREND", {"value": "dpo"}, int_param("window", 10, 50, 1, 20))
def dpo(s: Scope, window):
    return {"dpo": s.let("d", s.lag("close", window // 2 + 1) - s.avg("close", window))}


@feature("TREND_STC_V1", "TREND", {"value": "stc"})
def stc(s: Scope):
    """Flat stochastic ranges leave the smoother unchanged."""
    line = s.let("line", (s.ema("f", "close", 23) - s.ema("s", "close", 50)).col)
    lo, hi = s.let("lo", s.min(line, 10)), s.let("hi", s.max(line, 10))
    d = s.let("d", s.ema("k", 100 * div(line - lo, hi - lo), 3, 58, gaps=True).col)
    lo2, hi2 = s.let("lo2", s.min(d, 10)), s.let("hi2", s.max(d, 10))
    return {"stc": s.ema("kd", 100 * div(d - lo2, hi2 - lo2), 3, 69, gaps=True).col}


# -- adaptive --------------------------------------------------------------------------------

def efficiency(s: Scope, n: int, vol_n: int, eps: float) -> Column:
    d = s.let("ad", F.abs(s.diff("close")))
    vol = s.let("vol", s.sum(d, vol_n))
    change = s.let("chg", F.abs(s.diff("close", n)))
    return change / (vol + eps) if eps else F.when(change.isNotNull(), F.coalesce(div(change, vol), F.lit(0.0)))


def _kama(s: Scope, length):
    sc = s.let("sc", F.pow(efficiency(s, length, length, 0.0) * (2 / 3 - 2 / 31) + 2 / 31, 2))
    start = F.col("bar_idx") >= length
    y = s.scan("y", 1 - sc, sc * F.col("close"), seed=F.when(start, F.col("close")), valid=start)
    return {"kama": s.mask(y, length)}


feature("ADAPTIVE_KAMA_V1", "ADAPTIVE", {"value": "kama"}, int_param("length", 5, 50, 1, 10))(_kama)
feature("MOMENTUM_KAMA_V1", "MOMENTUM", {"value": "kama"}, int_param("length", 5, 50, 1, 10))(_kama)


@feature("ADAPTIVE_RAVI_V1", "ADAPTIVE", {"value": "ravi"}, int_param("short_len", 5, 20, 1, 7), int_param("long_len", 30, 100, 1, 65))
def ravi(s: Scope, short_len, long_len):
    f, sl = s.let("f", s.avg("close", short_len)), s.let("s", s.avg("close", long_len))
    return {"ravi": F.abs(f - sl) / (sl + EPS) * 100}


@feature("VMA", "TREND", {"value": "VMA"}, int_param("window", 5, 50, 1, 10), int_param("vi_window", 5, 50, 1, 10))
def vma(s: Scope, window, vi_window):
    start = max(window, vi_window)
    alpha = s.let("alpha", F.coalesce(efficiency(s, window, vi_window, EPS), F.lit(0.0)) * (2.0 / (window + 1)))
    y = s.scan("y", 1 - alpha, alpha * F.col("close"), seed=F.when(F.col("bar_idx") == start - 1, F.col("close")),
               valid=F.col("bar_idx") >= start)
    return {"VMA": s.mask(y, start - 1)}


# -- volume ----------------------------------------------------------------------------------

@feature("VOLUME_OBV_V1", "VOLUME", {"value": "OBV"})
def obv(s: Scope):
    d = s.diff("close")
    return {"OBV": s.cumsum("c", F.when(d > 0, F.col("volume")).when(d < 0, -F.col("volume")).otherwise(0.0))}


@feature("VOLUME_MFI_V1", "VOLUME", {"value": "mfi"}, int_param("length", 5, 30, 1, 14))
def mfi(s: Scope, length):
    tp = s.let("tp", typical())
    flow, d = tp * F.col("volume"), s.let("d", s.diff(tp))
    pos = s.let("p", s.sum(F.when(d > 0, flow).otherwise(0.0), length))
    neg = s.let("n", s.sum(F.when(d < 0, flow).otherwise(0.0), length))
    return {"mfi": 100 * div(pos, pos + neg)}


@feature("VOLUME_CMF_V1", "VOLUME", {"value": "cmf"}, int_param("length", 10, 30, 1, 20))
def cmf(s: Scope, length):
    return {"cmf": s.let("c", div(s.sum(money_flow_value(), length), s.sum("volume", length)))}


@feature("VOLUME_EOM_V1", "VOLUME", {"value": "eom", "sma": "eom_sma"}, int_param("length", 5, 30, 1, 14))
def eom(s: Scope, length):
    move = s.diff("high") + s.diff("low")
    e = s.let("e", div(move * (F.col("high") - F.col("low")), 2 * F.col("volume")) * 100000000.0)
    return {"eom": e, "eom_sma": s.let("m", s.avg(e, length))}


@feature("VOLUME_ADL_V1", "VOLUME", {"value": "ADL"})
def adl(s: Scope):
    return {"ADL": s.cumsum("c", money_flow_value())}


@feature("VOLUME_CHO_V1", "VOLUME", {"value": "cho"}, int_param("fast", 2, 10, 1, 3), int_param("slow", 10, 30, 1, 10))
def cho(s: Scope, fast, slow):
    s.cumsum("c", money_flow_value())
    a = State(s, ((f"{s.prefix}_zc_z", 1.0),), 0)
    return {"cho": (s.ema("f", a, fast) - s.ema("s", a, slow)).col}


def _pvt(s: Scope):
    return {"PVT": s.mask(s.cumsum("c", s.pct("close") * F.col("volume")), 1)}


feature("VOLUME_PVT_V1", "VOLUME", {"value": "PVT"})(_pvt)
feature("VOLUME_VPT_V1", "VOLUME", {"value": "PVT"})(_pvt)


@feature("VOLUME_VROC_V1", "VOLUME", {"value": "vroc"}, int_param("length", 5, 50, 1, 14))
def vroc(s: Scope, length):
    return {"vroc": s.let("v", s.pct("volume", length) * 100)}


@feature("VOLUME_NVI_V1", "VOLUME", {"value": "nvi"})
def nvi(s: Scope):
    """Starts at 1000; multiplied by close / previous close when volume falls."""
    step = s.let("step", F.when(F.col("volume") < s.lag("volume"), div("close", s.lag("close"))))
    return {"nvi": s.scan("y", step, F.lit(0.0), seed=F.lit(1000.0), valid=step.isNotNull())}


@feature("VOLUME_VWAP_V1", "VOLUME", {"value": "vwap"}, int_param("window", 5, 50, 1, 14))
def vwap(s: Scope, window):
    return {"vwap": s.let("v", div(s.sum(typical() * F.col("volume"), window), s.sum("volume", window)))}


# -- price action ----------------------------------------------------------------------------

@feature("PA_PIVOT_V1", "PRICE_ACTION", {"value": "dist", "level": "level", "r1": "r1", "s1": "s1"}, int_param("window", 5, 60, 1, 20))
def pivot(s: Scope, window):
    hi, lo = s.let("hi", s.max("high", window)), s.let("lo", s.min("low", window))
    ph, pl = s.let("ph", s.lag(hi)), s.let("pl", s.lag(lo))
    # the back-filled first `window` closes fall in the warm-up of ph except the last of them
    back = F.when(F.col("bar_idx") == window - 1, s.lag("close", window - 1)).otherwise(s.lag("close", window))
    pp = s.let("pp", (ph + pl + s.let("pc", back)) / 3)
    return {"level": pp, "dist": div(F.col("close") - pp, pp) * 100, "r1": 2 * pp - pl, "s1": 2 * pp - ph}


@feature("PA_FIBO_V1", "PRICE_ACTION", {"value": "pos", "dist": "dist_618"}, int_param("window", 20, 200, 1, 50))
def fibo(s: Scope, window):
    hi, lo = s.let("hi", s.max("high", window)), s.let("lo", s.min("low", window))
    pos = (F.col("close") - lo) / (hi - lo + EPS)
    return {"pos": pos, "dist_618": pos - 0.618}


@feature("PA_SR_V1", "PRICE_ACTION", {"value": "dist_res", "upper": "dist_res", "lower": "dist_sup"}, int_param("window", 10, 100, 1, 20))
def support_resistance(s: Scope, window):
    hi, lo = s.let("hi", s.max("high", window)), s.let("lo", s.min("low", window))
    res, sup = s.let("res", s.lag(hi)), s.let("sup", s.lag(lo))
    return {"dist_res": div(res - F.col("close"), "close") * 100, "dist_sup": div(F.col("close") - sup, "close") * 100}


@feature("PA_VP_V1", "PRICE_ACTION", {"value": "dist_poc", "intensity": "vol_intensity"}, int_param("window", 20, 100, 1, 50), int_param("bins", 5, 20, 1, 10))
def volume_profile(s: Scope, window, bins):
    vw = s.let("vw", s.sum(F.col("close") * F.col("volume"), window) / (s.sum("volume", window) + EPS))
    return {"dist_poc": div(F.col("close") - vw, vw) * 100, "vol_intensity": div("volume", s.let("mv", s.avg("volume", window)))}


@feature("PA_FAKE_OUT_V1", "PRICE_ACTION", {"value": "signal", "bull": "bull_fake", "bear": "bear_fake"},
         int_param("window", 10, 100, 1, 20), int_param("lookback", 2, 10, 1, 5))
def fake_out(s: Scope, window, lookback):
    hi, lo = s.let("hi", s.max("high", window)), s.let("lo", s.min("low", window))
    ph, pl = s.let("ph", s.lag(hi)), s.let("pl", s.lag(lo))
    bh = s.let("bh", F.coalesce((F.col("high") > ph).cast("int"), F.lit(0)))
    bl = s.let("bl", F.coalesce((F.col("low") < pl).cast("int"), F.lit(0)))
    rh = s.let("rh", F.coalesce(((F.col("close") < ph) & (s.max(bh, lookback) > 0)).cast("int"), F.lit(0)))
    rl = s.let("rl", F.coalesce(((F.col("close") > pl) & (s.max(bl, lookback) > 0)).cast("int"), F.lit(0)))
    return {"signal": rl - rh, "bull_fake": rl, "bear_fake": rh}


@feature("PATTERN_HEIKIN_V1", "PATTERN", {"value": "HA_Close", "close": "HA_Close", "open": "HA_Open", "high": "HA_High", "low": "HA_Low"})
def heikin(s: Scope):
    hc = s.let("hc", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    prev = s.let("prev", s.lag(hc))
    ho = s.scan("ho", 0.5, 0.5 * prev, seed=F.when(F.col("bar_idx") == 0, (F.col("open") + F.col("close")) / 2),
                valid=F.col("bar_idx") >= 1)
    return {"HA_Close": hc, "HA_Open": ho, "HA_High": F.greatest("high", ho, hc), "HA_Low": F.least("low", ho, hc)}


# -- constants, custom, context --------------------------------------------------------------

feature("TRUE", "CONSTANT", {"value": "value"})(lambda s: {"value": F.lit(True)})
feature("FALSE", "CONSTANT", {"value": "value"})(lambda s: {"value": F.lit(False)})


@feature("CUSTOM_RETURN_V1", "CUSTOM", {"value": "ret_1d", "ret_5d": "ret_5d", "ret_20d": "ret_20d"})
def returns(s: Scope):
    return {f"ret_{n}d": s.let(f"r{n}", s.pct("close", n)) for n in (1, 5, 20)}


@feature("CUSTOM_VOLATILITY_V1", "CUSTOM", {"value": "rvol"}, int_param("window", 5, 60, 1, 20))
def realized_vol(s: Scope, window):
    r = s.let("r", s.pct("close"))
    return {"rvol": s.let("v", s.std(r, window) * math.sqrt(252))}


@feature("CUSTOM_RANGE_V1", "CUSTOM", {"value": "range_pct", "avg": "range_20d_avg"})
def price_range(s: Scope):
    r = s.let("r", div(F.col("high") - F.col("low"), "close"))
    return {"range_pct": r, "range_20d_avg": s.let("m", s.avg(r, 20))}


@feature("CUSTOM_GAP_V1", "CUSTOM", {"value": "gap", "up": "gap_up", "down": "gap_down"})
def gap(s: Scope):
    pc = s.let("pc", s.lag("close"))
    g = div(F.col("open") - pc, pc)
    hit = lambda cond: F.coalesce(cond.cast("int"), F.lit(0))
    return {"gap": g, "gap_up": hit(g > 0.01), "gap_down": hit(g < -0.01)}


@feature("CUSTOM_MOMENTUM_RANK_V1", "CUSTOM", {"value": "mom_rank"}, int_param("window", 20, 120, 1, 60))
def momentum_rank(s: Scope, window):
    m = s.let("m", s.pct("close", 20))
    return {"mom_rank": s.let("rank", rank_last(s, m, window))}


@feature("CUSTOM_ZSCORE_V1", "CUSTOM", {"value": "zscore"}, int_param("window", 5, 60, 1, 20))
def zscore(s: Scope, window):
    return {"zscore": s.let("z", (F.col("close") - s.avg("close", window)) / (s.std("close", window) + EPS))}


def _time(s: Scope):
    ts, tau = F.col("ts"), 2 * math.pi
    cyc = {"dow": (F.weekday(ts), 7), "month": (F.month(ts) - 1, 12), "doy": (F.dayofyear(ts) - 1, 365)}
    return {f"time_{k}_{f}": fn(tau * v / n) for k, (v, n) in cyc.items() for f, fn in (("sin", F.sin), ("cos", F.cos))}


_TIME_OUT = {f"{k}_{f}": f"time_{k}_{f}" for k in ("dow", "month", "doy") for f in ("sin", "cos")}
feature("CONTEXT_TIME", "CONTEXT", _TIME_OUT)(_time)


@feature("CONTEXT_TIME_V1", "CONTEXT", {k: v for k, v in _TIME_OUT.items() if "doy" not in k})
def time_short(s: Scope):
    return {k: v for k, v in _time(s).items() if "doy" not in k}


def moments(s: Scope, x: str, n: int):
    """Bias-corrected rolling skewness and excess kurtosis; 0 when undefined or flat."""
    sd = s.let(f"sd{n}", s.pstd(x, n))
    flat = F.coalesce(sd, F.lit(0.0)) <= 1e-12
    sk = s.let(f"sk{n}", s.full(F.skewness, x, n))
    ku = s.let(f"ku{n}", s.full(F.kurtosis, x, n))
    g1 = sk * math.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ku + 6)
    return F.when(flat, 0.0).otherwise(g1), F.when(flat, 0.0).otherwise(g2)


@feature("CONTEXT_STAT", "CONTEXT", {"skew": "stat_skew", "kurt": "stat_kurt", "value": "stat_zscore"}, int_param("window", 10, 60, 10, 20))
def stat(s: Scope, window):
    sk, ku = moments(s, "close", window)
    z = s.let("z", (F.col("close") - s.avg("close", window)) / (s.std("close", window) + EPS))
    return {"stat_skew": sk, "stat_kurt": ku, "stat_zscore": F.coalesce(z, F.lit(0.0))}


@feature("CONTEXT_STAT_V1", "CONTEXT", {"value": "skew", "kurt": "kurt"}, int_param("window", 10, 60, 10, 20))
def stat_short(s: Scope, window):
    sk, ku = moments(s, "close", window)
    return {"skew": sk, "kurt": ku}


@feature("REL_SPY", "CONTEXT", {"value": "rel_spy_close_ratio"}, context=("spy_close",))
def relative_spy(s: Scope):
    """Context closes come forward-filled from the context join; a zero counts as missing."""
    return {"rel_spy_close_ratio": F.col("close") / (F.when(F.col("spy_close") != 0, F.col("spy_close")) + EPS)}


def _macro(col: str):
    return lambda s: {col: F.col(col)}


# Macro feature ids and the context column each selects.
MACRO_COLUMNS = {"VIX": "vix_close", "US10Y": "us10y_close", "DX": "dx_close", "BTC": "btc_close", "USO": "uso_close", "HYG": "hyg_close"}
for _key, _col in MACRO_COLUMNS.items():
    feature(f"MACRO_{_key}", "MACRO", {"value": _col}, context=(_col,))(_macro(_col))
