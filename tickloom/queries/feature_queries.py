"""One query per registry feature with default parameters."""

from __future__ import annotations

import math

import tickloom.operators.indicators  # noqa: F401  (fills the registry)
from tickloom.operators.features import REGISTRY, compute_genome
from tickloom.queries.base import bars_c, bars_h, register, rounded
from tickloom.queries.sqlkit import BARS_C, BARS_H, Rec, emas, ema, lag, mask, over, pct, select, span, wilders, win

TP = "((high + low + close) / 3)"
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
MFV = "(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume)"
EPS = "1e-9::DOUBLE"


def rank_last(x: str, n: int) -> str:
    """Average percent rank of the current value within the last n values."""
    arr = f"list({x}) {over(n)}"
    return (f"(CASE WHEN count({x}) {over(n)} = {n} THEN (len(list_filter({arr}, lambda v: v < {x})) "
            f"+ (len(list_filter({arr}, lambda v: v = {x})) + 1) / 2.0) / {n}.0 END)")


def run_length(name: str, cond: str) -> Rec:
    return Rec({name: (f"CASE WHEN {cond.format('')} THEN 1 ELSE 0 END",
                       f"CASE WHEN {cond.format('x.')} THEN r.{name} + 1 ELSE 0 END")})


def rsi_layers(n: int) -> list:
    return [{"d": f"close - {lag('close')}"},
            {"gain": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "loss": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"},
            emas(g=("gain", f"(1.0::DOUBLE / {n})"), l=("loss", f"(1.0::DOUBLE / {n})")),
            {"rsi": mask("CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END", n - 1)}]


def band_layers(n: int) -> list:
    return [{"m": win("avg", "close", n), "sd": win("stddev_pop", "close", n)}]


def macd_layers() -> list:
    return [emas(f=("close", span(12)), s=("close", span(26))), {"line": mask("f - s", 25)}, ema("g", "line", span(9)),
            {"sig": mask("g", 33)}]


def percent_osc(col: str) -> list:
    return [emas(f=(col, span(12)), s=(col, span(26))), {"line": mask("(f - s) / nullif(s, 0) * 100", 25)},
            ema("g", "line", span(9)), {"sig": mask("g", 33)}]


def trix_layers(n: int) -> list:
    return [ema("a", "close", span(n)), {"am": mask("a", n - 1)}, ema("b", "am", span(n)), {"bm": mask("b", 2 * (n - 1))},
            ema("c", "bm", span(n)), {"cm": mask("c", 3 * (n - 1))}]


def adx_layers(n: int = 14) -> list:
    return [
        {"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low", "tr": f"CASE WHEN bar_idx > 0 THEN {TR} END"},
        {"plus": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", "minus": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END"},
        wilders(n, 1, wt="tr", wp="plus", wn="minus"),
        {"pos": mask("100 * wp / nullif(wt, 0)", n), "neg": mask("100 * wn / nullif(wt, 0)", n)},
        {"dx": mask("coalesce(100 * abs(pos - neg) / nullif(pos + neg, 0), 0)", n)},
        wilders(n, n, wd="dx"),
        {"adx": mask("wd", 2 * n - 1)},
    ]


def cumulative(expr: str) -> str:
    return f"sum({expr}) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"


def kama_layers() -> list:
    sc = "pow(coalesce(chg / nullif(vol, 0), 0) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2)"
    return [{"ad": f"abs(close - {lag('close')})", "chg": f"abs(close - {lag('close', 10)})"}, {"vol": win("sum", "ad", 10)}, {"sc": sc},
            Rec({"y": ("NULL", "CASE WHEN x.bar_idx < 10 THEN NULL WHEN x.bar_idx = 10 THEN x.close ELSE r.y + x.sc * (x.close - r.y) END")})]


KST = [{f"p{i}": pct("close", r) for i, r in enumerate((10, 15, 20, 30), 1)},
       {f"r{i}": win("avg", f"p{i}", w) for i, w in enumerate((10, 10, 10, 15), 1)},
       {"k": "100 * (r1 + 2 * r2 + 3 * r3 + 4 * r4)"}, {"sig": win("avg", "k", 9)}]
VORTEX = [{"tr": TR, "up": f"abs(high - {lag('low')})", "dn": f"abs(low - {lag('high')})"},
          {"p": f"{win('sum', 'up', 14)} / nullif({win('sum', 'tr', 14)}, 0)", "n": f"{win('sum', 'dn', 14)} / nullif({win('sum', 'tr', 14)}, 0)"}]
STOCH = [{"lo": win("min", "low", 14), "hi": win("max", "high", 14)}, {"k": "100 * (close - lo) / nullif(hi - lo, 0)"}, {"d": win("avg", "k", 3)}]
FORCE = [{"x": f"(close - {lag('close')}) * volume"}, ema("f", "x", span(13))]
PREV_HL = [{"hi": win("max", "high", 20), "lo": win("min", "low", 20)}, {"ph": lag("hi"), "pl": lag("lo")}]
TAU = "2 * pi()"
CYC = {"dow": ("(isodow(ts) - 1)", 7), "month": ("(month(ts) - 1)", 12), "doy": ("(dayofyear(ts) - 1)", 365)}


def cyc(*keys: str) -> dict:
    return {f"time_{k}_{f}": f"{f}({TAU} * {CYC[k][0]} / {CYC[k][1]}.0)" for k in keys for f in ("sin", "cos")}


def flat(expr: str) -> str:
    return f"CASE WHEN coalesce(sd, 0) <= 1e-12 THEN 0 ELSE {expr} END"


STAT = [{"sd": win("stddev_pop", "close", 20), "sk": win("skewness", "close", 20), "ku": win("kurtosis", "close", 20),
         "z": f"(close - {win('avg', 'close', 20)}) / ({win('stddev_samp', 'close', 20)} + {EPS})"}]
UO = [{"pc": lag("close")}, {"bp": "close - least(low, pc)", "tr": "greatest(high, pc) - least(low, pc)"},
      {f"a{n}": f"{win('sum', 'bp', n)} / nullif({win('sum', 'tr', n)}, 0)" for n in (7, 14, 28)}]
KALMAN_STEP = "(r.p + 1e-5::DOUBLE) / (r.p + 1e-5::DOUBLE + 0.1::DOUBLE * 0.1::DOUBLE)"
AROON = [{"hs": f"CASE WHEN bar_idx >= 25 THEN list(high) {over(26)} END", "ls": f"CASE WHEN bar_idx >= 25 THEN list(low) {over(26)} END"},
         {"up": "100.0 * (list_position(hs, list_max(hs)) - 1) / 25", "dn": "100.0 * (list_position(ls, list_min(ls)) - 1) / 25"}]
RVI = [{"sd": win("stddev_samp", "close", 10), "d": f"close - {lag('close')}"},
       {"u": "CASE WHEN d > 0 THEN coalesce(sd, 0) ELSE 0.0 END", "v": "CASE WHEN d < 0 THEN coalesce(sd, 0) ELSE 0.0 END"},
       emas(ua=("u", "(1.0::DOUBLE / 14)"), va=("v", "(1.0::DOUBLE / 14)"))]
STC = [emas(f=("close", span(23)), s=("close", span(50))), {"line": mask("f - s", 49)},
       {"lo": win("min", "line", 10), "hi": win("max", "line", 10)}, {"k": "100 * (line - lo) / nullif(hi - lo, 0)"},
       ema("dd", "k", span(3)), {"d": mask("dd", 60)}, {"lo2": win("min", "d", 10), "hi2": win("max", "d", 10)},
       {"kd": "100 * (d - lo2) / nullif(hi2 - lo2, 0)"}, ema("st", "kd", span(3)), {"stc": mask("st", 71)}]
VMA = [{"ad": f"abs(close - {lag('close')})", "chg": f"abs(close - {lag('close', 10)})"}, {"vol": win("sum", "ad", 10)},
       {"al": f"coalesce(chg / (vol + {EPS}), 0) * (2.0::DOUBLE / 11)"},
       Rec({"y": ("NULL", "CASE WHEN x.bar_idx < 9 THEN NULL WHEN x.bar_idx = 9 THEN x.close ELSE r.y + x.al * (x.close - r.y) END")})]

# feature id -> (layers, outputs, digits)
SPECS: dict[str, tuple] = {
    "VOLATILITY_ATR_V1": ([{"tr": TR}, wilders(14, w="tr"), {"atr": mask("w", 13)}, {"nrm": "atr / nullif(close, 0) * 100"},
                           {"low_q": f"coalesce(nrm < {win('quantile_cont({}, 0.2)', 'nrm', 100)}, false)"}, run_length("pl", "{}low_q")],
                          {"atr": "atr", "atr_norm": "nrm", "velocity": f"atr - {lag('atr', 5)}", "persist_low": "pl"}),
    "VOLATILITY_BB_V1": ([*band_layers(20), {"w": "4 * sd / nullif(m, 0) * 100"}],
                         {"upper": "m + 2 * sd", "lower": "m - 2 * sd", "width": "w", "squeeze": rank_last("w", 100)}),
    "VOLATILITY_BB_ADV_V1": (band_layers(20), {"pct_b": "(close - (m - 2 * sd)) / nullif(4 * sd, 0)", "width": "4 * sd / nullif(m, 0) * 100"}),
    "VOLATILITY_KC_V1": ([{"tr": TR}, wilders(20, w="tr"), ema("e", "close", span(20))],
                         {"upper": mask("e + 2 * w", 19), "lower": mask("e - 2 * w", 19)}),
    "VOLATILITY_KC_WIDTH_V1": ([{"m": win("avg", TP, 20), "u": win("avg", "((4 * high - 2 * low + close) / 3)", 20),
                                 "l": win("avg", "((-2 * high + 4 * low + close) / 3)", 20)}],
                               {"high": "u", "low": "l", "width": "(u - l) / nullif(m, 0) * 100"}),
    "VOLATILITY_DONCHIAN_V1": ([], {"high": win("max", "high", 20), "low": win("min", "low", 20)}),
    "VOLATILITY_DC_V1": ([{"h": win("max", "high", 20), "l": win("min", "low", 20), "m": win("avg", "close", 20)}],
                         {"dc_high": "h", "dc_low": "l", "dc_mid": "(h + l) / 2", "dc_width": "(h - l) / nullif(m, 0) * 100"}),
    "VOLATILITY_UI_V1": ([{"pk": win("max", "close", 14)}, {"dd": "pow(100 * (close - pk) / nullif(pk, 0), 2)"}], {"ui": f"sqrt({win('avg', 'dd', 14)})"}),
    "VOLATILITY_CV_V1": ([{"hl": "high - low"}, ema("e", "hl", span(10))], {"cv": f"{pct('e', 10)} * 100"}),
    "VOLATILITY_RVI_V1": (RVI, {"rvi": f"100 * ua / (ua + va + {EPS})"}),
    "VOLATILITY_ENV_V1": ([{"m": win("avg", "close", 20)}], {"upper": "m * 1.05", "lower": "m * 0.95"}),
    "VOLATILITY_STD_V1": ([], {"std": win("stddev_samp", "close", 20)}),
    "VOLATILITY_KALMAN_V1": ([Rec({"xe": ("close", f"r.xe + {KALMAN_STEP} * (x.close - r.xe)"),
                                   "p": ("1.0", f"(1 - {KALMAN_STEP}) * (r.p + 1e-5::DOUBLE)")})], {"kalman": "xe"}),
    "MOMENTUM_RSI_V1": ([*rsi_layers(14), run_length("os", "coalesce({}rsi < 30, false)"), run_length("ob", "coalesce({}rsi > 70, false)")],
                        {"rsi": "rsi", "velocity": f"rsi - {lag('rsi', 3)}", "persist_os": "os", "persist_ob": "ob"}),
    "MOMENTUM_MACD_V1": (macd_layers(), {"line": "line", "diff": "line - sig", "signal": "sig"}),
    "TREND_MACD_V1": (macd_layers(), {"line": "line", "diff": "line - sig", "signal": "sig"}),
    "MEANREV_STOCH_V1": (STOCH, {"k": "k", "d": "d"}),
    "MOMENTUM_STOCH_V1": (STOCH, {"k": "k", "d": "d"}),
    "MOMENTUM_CCI_V1": ([{"tp": TP}, {"m": win("avg", "tp", 20), "arr": f"list(tp) {over(20)}"}],
                        {"cci": "(tp - m) / nullif(0.015 * list_sum(list_transform(arr, lambda v: abs(v - m))) / 20, 0)"}),
    "MOMENTUM_ROC_V1": ([], {"roc": f"{pct('close', 10)} * 100"}),
    "MOMENTUM_ROC12_V1": ([], {"roc": f"{pct('close', 12)} * 100"}),
    "MOMENTUM_WILLR_V1": ([{"h": win("max", "high", 14), "l": win("min", "low", 14)}], {"willr": "-100 * (h - close) / nullif(h - l, 0)"}),
    "MOMENTUM_MOM_V1": ([], {"mom": f"close - {lag('close', 10)}"}),
    "MOMENTUM_CMO_V1": (rsi_layers(14), {"cmo": "(rsi - 50) * 2"}),
    "MOMENTUM_CMO_SUM_V1": ([{"d": f"close - {lag('close')}"}, {"up": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END",
                                                               "dn": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"},
                             {"u": win("sum", "up", 14), "v": win("sum", "dn", 14)}], {"cmo": f"100 * (u - v) / (u + v + {EPS})"}),
    "MOMENTUM_AO_V1": ([{"mp": "(high + low) / 2"}], {"ao": f"{win('avg', 'mp', 5)} - {win('avg', 'mp', 34)}"}),
    "MOMENTUM_TSI_V1": ([{"d": f"close - {lag('close')}"}, {"a": "abs(d)"}, emas(p=("d", span(25)), q=("a", span(25))),
                         {"pm": mask("p", 25), "qm": mask("q", 25)}, emas(u=("pm", span(13)), v=("qm", span(13)))],
                        {"tsi": mask("100 * u / nullif(v, 0)", 37)}),
    "MOMENTUM_KST_V1": (KST, {"kst": "k", "signal": "sig", "diff": "k - sig"}),
    "TREND_KST_V1": (KST, {"kst": "k", "signal": "sig", "diff": "k - sig"}),
    "MOMENTUM_VORTEX_V1": (VORTEX, {"pos": "p", "neg": "n", "diff": "p - n"}),
    "TREND_VORTEX_V1": (VORTEX, {"pos": "p", "neg": "n", "diff": "p - n"}),
    "MOMENTUM_PMO_V1": ([{"x": f"CASE WHEN bar_idx > 0 THEN coalesce({pct('close')} * 100, 0) END"}, ema("a", "x", span(35)), ema("b", "a", span(20)),
                         ema("c", "b", span(10))], {"pmo": "b", "signal": "c"}),
    "MOMENTUM_EFI_V1": (FORCE, {"efi": mask("f", 13)}),
    "VOLUME_FI_V1": (FORCE, {"efi": mask("f", 13)}),
    "MOMENTUM_PAM_V1": ([], {"pam": f"(close - {win('avg', 'close', 10)}) / ({win('stddev_samp', 'close', 10)} + {EPS})"}),
    "MOMENTUM_UO_V1": (UO, {"uo": "100 * (4 * a7 + 2 * a14 + a28) / 7"}),
    "MOMENTUM_PPO_V1": (percent_osc("close"), {"ppo": "line", "ppo_signal": "sig", "ppo_hist": "line - sig"}),
    "MOMENTUM_PVO_V1": (percent_osc("volume"), {"pvo": "line", "pvo_signal": "sig", "pvo_hist": "line - sig"}),
    "TREND_MACROSS_V1": ([{"f": win("avg", "close", 20), "s": win("avg", "close", 60)}], {"spread": "(f - s) / (s + 1e-6::DOUBLE)"}),
    "TREND_SMA_V1": ([], {"sma": win("avg", "close", 20)}),
    "TREND_EMA_V1": ([ema("e", "close", span(20))], {"ema": "e"}),
    "TREND_WMA_V1": ([{"arr": f"CASE WHEN bar_idx >= 19 THEN list(close) {over(20)} END"}],
                     {"wma": "list_sum(list_transform(arr, lambda v, i: v * i)) / 210.0"}),
    "TREND_ADX_V1": (adx_layers(), {"adx": "adx", "pos": "pos", "neg": "neg"}),
    "TREND_TRIX_V1": (trix_layers(30), {"trix": f"{pct('cm')} * 100"}),
    "TREND_TRIX15_V1": (trix_layers(15), {"trix": f"{pct('cm')} * 100"}),
    "TREND_ICHIMOKU_V1": ([{k: f"({win('max', 'high', n)} + {win('min', 'low', n)}) / 2" for k, n in (("cv", 9), ("bs", 26), ("sb", 52))}],
                          {"conv": "cv", "base": "bs", "spanA": "(cv + bs) / 2", "spanB": "sb"}),
    "TREND_SUPER_DIST_V1": ([{"tr": TR}, wilders(7, w="tr"), {"a": mask("w", 6)}],
                            {"dist_up": "(close - ((high + low) / 2 + 3 * a)) / nullif(close, 0)",
                             "dist_down": "(close - ((high + low) / 2 - 3 * a)) / nullif(close, 0)"}),
    "TREND_AROON_V1": (AROON, {"up": "up", "down": "dn", "ind": "up - dn"}),
    "TREND_MASS_V1": ([{"hl": "high - low"}, ema("a", "hl", span(9)), {"am": mask("a", 8)}, ema("b", "am", span(9)), {"bm": mask("b", 16)},
                       {"q": "am / nullif(bm, 0)"}], {"mass_index": win("sum", "q", 25)}),
    "TREND_DPO_V1": ([], {"dpo": f"{lag('close', 11)} - {win('avg', 'close', 20)}"}),
    "TREND_STC_V1": (STC, {"stc": "stc"}),
    "ADAPTIVE_KAMA_V1": (kama_layers(), {"kama": "y"}),
    "MOMENTUM_KAMA_V1": (kama_layers(), {"kama": "y"}),
    "ADAPTIVE_RAVI_V1": ([{"f": win("avg", "close", 7), "s": win("avg", "close", 65)}], {"ravi": f"abs(f - s) / (s + {EPS}) * 100"}),
    "VMA": (VMA, {"VMA": "y"}),
    "VOLUME_OBV_V1": ([{"d": f"close - {lag('close')}"}], {"OBV": cumulative("CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0.0 END")}),
    "VOLUME_MFI_V1": ([{"tp": TP}, {"d": f"tp - {lag('tp')}", "fl": "tp * volume"},
                       {"p": win("sum", "(CASE WHEN d > 0 THEN fl ELSE 0.0 END)", 14), "n": win("sum", "(CASE WHEN d < 0 THEN fl ELSE 0.0 END)", 14)}],
                      {"mfi": "100 * p / nullif(p + n, 0)"}),
    "VOLUME_CMF_V1": ([{"mfv": MFV}], {"cmf": f"{win('sum', 'mfv', 20)} / nullif({win('sum', 'volume', 20)}, 0)"}),
    "VOLUME_EOM_V1": ([{"e": f"(high - {lag('high')} + low - {lag('low')}) * (high - low) / nullif(2 * volume, 0) * 100000000.0"}],
                      {"eom": "e", "eom_sma": win("avg", "e", 14)}, 2),
    "VOLUME_ADL_V1": ([{"mfv": MFV}], {"ADL": cumulative("mfv")}),
    "VOLUME_CHO_V1": ([{"mfv": MFV}, {"adl": cumulative("mfv")}, emas(f=("adl", span(3)), s=("adl", span(10)))], {"cho": mask("f - s", 9)}),
    "VOLUME_PVT_V1": ([{"q": f"{pct('close')} * volume"}], {"PVT": mask(cumulative("coalesce(q, 0)"), 1)}, 4),
    "VOLUME_VPT_V1": ([{"q": f"{pct('close')} * volume"}], {"PVT": mask(cumulative("coalesce(q, 0)"), 1)}, 4),
    "VOLUME_VROC_V1": ([], {"vroc": f"{pct('volume', 14)} * 100"}),
    "VOLUME_NVI_V1": ([{"st": f"CASE WHEN volume < {lag('volume')} THEN close / nullif({lag('close')}, 0) END"},
                       Rec({"y": ("1000.0", "r.y * coalesce(x.st, 1)")})], {"nvi": "y"}, -4),
    "VOLUME_VWAP_V1": ([{"tv": f"{TP} * volume"}], {"vwap": f"{win('sum', 'tv', 14)} / nullif({win('sum', 'volume', 14)}, 0)"}),
    "PA_PIVOT_V1": ([*PREV_HL, {"pc": f"coalesce({lag('close', 20)}, CASE WHEN bar_idx < 20 THEN first(close) {over()} END)"},
                     {"pp": "(ph + pl + pc) / 3"}],
                    {"level": "pp", "dist": "(close - pp) / nullif(pp, 0) * 100", "r1": "2 * pp - pl", "s1": "2 * pp - ph"}),
    "PA_FIBO_V1": ([{"hi": win("max", "high", 50), "lo": win("min", "low", 50)}, {"q": f"(close - lo) / (hi - lo + {EPS})"}],
                   {"pos": "q", "dist_618": "q - 0.618"}),
    "PA_SR_V1": (PREV_HL, {"dist_res": "(ph - close) / nullif(close, 0) * 100", "dist_sup": "(close - pl) / nullif(close, 0) * 100"}),
    "PA_VP_V1": ([{"cv": "close * volume"}, {"vw": f"{win('sum', 'cv', 50)} / ({win('sum', 'volume', 50)} + {EPS})", "mv": win("avg", "volume", 50)}],
                 {"dist_poc": "(close - vw) / nullif(vw, 0) * 100", "vol_intensity": "volume / nullif(mv, 0)"}),
    "PA_FAKE_OUT_V1": ([*PREV_HL, {"bh": "coalesce((high > ph)::INT, 0)", "bl": "coalesce((low < pl)::INT, 0)"},
                        {"rh": f"coalesce((close < ph AND {win('max', 'bh', 5)} > 0)::INT, 0)",
                         "rl": f"coalesce((close > pl AND {win('max', 'bl', 5)} > 0)::INT, 0)"}],
                       {"signal": "rl - rh", "bull_fake": "rl", "bear_fake": "rh"}),
    "PATTERN_HEIKIN_V1": ([{"hc": "(open + high + low + close) / 4"}, {"pv": lag("hc")},
                           Rec({"ho": ("(open + close) / 2", "(r.ho + x.pv) / 2")})],
                          {"HA_Close": "hc", "HA_Open": "ho", "HA_High": "greatest(high, ho, hc)", "HA_Low": "least(low, ho, hc)"}),
    "CUSTOM_RETURN_V1": ([], {f"ret_{n}d": pct("close", n) for n in (1, 5, 20)}),
    "CUSTOM_VOLATILITY_V1": ([{"q": pct("close")}], {"rvol": f"{win('stddev_samp', 'q', 20)} * sqrt(252)"}),
    "CUSTOM_RANGE_V1": ([{"q": "(high - low) / nullif(close, 0)"}], {"range_pct": "q", "range_20d_avg": win("avg", "q", 20)}),
    "CUSTOM_GAP_V1": ([{"pc": lag("close")}, {"g": "(open - pc) / nullif(pc, 0)"}],
                      {"gap": "g", "gap_up": "coalesce((g > 0.01)::INT, 0)", "gap_down": "coalesce((g < -0.01)::INT, 0)"}),
    "CUSTOM_MOMENTUM_RANK_V1": ([{"q": pct("close", 20)}], {"mom_rank": rank_last("q", 60)}),
    "CUSTOM_ZSCORE_V1": ([], {"zscore": f"(close - {win('avg', 'close', 20)}) / ({win('stddev_samp', 'close', 20)} + {EPS})"}),
    "CONTEXT_TIME": ([], cyc("dow", "month", "doy")),
    "CONTEXT_TIME_V1": ([], cyc("dow", "month")),
    "CONTEXT_STAT": (STAT, {"stat_skew": flat("sk"), "stat_kurt": flat("ku"), "stat_zscore": "coalesce(z, 0)"}),
    "CONTEXT_STAT_V1": (STAT, {"skew": flat("sk"), "kurt": flat("ku")}),
}

CONTEXT_SPECS = {
    "REL_SPY": {"rel_spy_close_ratio": f"close / (nullif(spy_close, 0) + {EPS})"},
    "MACRO_VIX": {"vix_close": "vix_close"},
    "MACRO_US10Y": {"us10y_close": "us10y_close"},
    "MACRO_HYG": {"hyg_close": "hyg_close"},
    "MACRO_DX": {"dx_close": "dx_close"},
    "MACRO_BTC": {"btc_close": "btc_close"},
    "MACRO_USO": {"uso_close": "uso_close"},
}


def _feature_query(fid: str, outs: list[str], digits: int, source):
    def run(spark, sf_dir):
        df = compute_genome(source(spark, sf_dir), {fid: {}})
        return rounded(df, [f"{fid}__{o}" for o in outs], digits)
    return run


for _fid, _spec in SPECS.items():
    _layers, _outs, _digits = (*_spec, 6)[:3]
    register(_fid, _feature_query(_fid, list(_outs), _digits, bars_h), select(BARS_H, *_layers, out=_outs, digits=_digits))
for _fid, _outs in CONTEXT_SPECS.items():
    register(_fid, _feature_query(_fid, list(_outs), 6, bars_c), select(BARS_C, out=_outs, source="bars_ctx"))

for _const, _val in (("TRUE", True), ("FALSE", False)):
    def _constant(spark, sf_dir, fid=_const):
        df = compute_genome(bars_h(spark, sf_dir), {fid: {}})
        return df.select("symbol", "bar_idx", df[f"{fid}__value"].alias("value"))
    register(_const, _constant, f"WITH {BARS_H} SELECT symbol, bar_idx::BIGINT AS bar_idx, {_const}::BOOLEAN AS value FROM bars")
