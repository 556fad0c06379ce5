"""Sources and preparation, vector helpers, in-house indicators, shared window operators, context and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

import tickloom.operators.machines  # noqa: F401  (registers the state-machine features)
from tickloom.functions.num import rnd
from tickloom.operators import context as C
from tickloom.operators import vectors as V
from tickloom.operators.features import REGISTRY, FeatureDef, Scope, compute_genome
from tickloom.operators.indicators import rank_last
from tickloom.queries.base import bars_c, bars_d, bars_h, context, query, register, rounded, table
from tickloom.queries.feature_queries import TR, adx_layers, rank_last as rank_last_sql, rsi_layers
from tickloom.queries.sqlkit import (BARS_C, BARS_D, BARS_H, CONTEXT, Rec, chain, emas, ema, lag, mask, over, pct, r6, select, span,
                                     wilders, win)
from tickloom.sources import bars as B

OHLCV_SQL = {c: c for c in ("open", "high", "low", "close", "volume")}
NULLED = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END"


def ohlcv(df, keys=("symbol", "ts"), digits=6):
    return df.select(*keys, *[rnd(c, digits).alias(c) for c in B.OHLCV])


# -- 2.1 sources and preparation ----------------------------------------------------------------

@query("prep.bars", f"WITH {BARS_D} SELECT symbol, ts, bar_idx::BIGINT AS bar_idx, {', '.join(f'{r6(c)} AS {c}' for c in OHLCV_SQL)} FROM bars")
def prep_bars(spark, sf):
    return ohlcv(bars_d(spark, sf), ("symbol", "ts", "bar_idx"))


@query("src.ohlcv", f"WITH {BARS_H} SELECT symbol, ts, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, "
       f"{r6('CASE WHEN bar_idx % 7 = 0 THEN 0 ELSE volume END')} AS volume FROM bars")
def src_ohlcv(spark, sf):
    raw = bars_h(spark, sf).withColumn("volume", F.when(F.col("bar_idx") % 7 != 0, F.col("volume")))
    return ohlcv(B.read_ohlcv(raw.select(*[F.col(c).alias(c.upper()) for c in raw.columns])))


@query("src.klines", f"WITH {BARS_H} SELECT symbol, ts, {', '.join(f'{r6(c)} AS {c}' for c in OHLCV_SQL)} FROM bars")
def src_klines(spark, sf):
    b = bars_h(spark, sf)
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    arr = F.array(ms, *[F.col(c).cast("string") for c in B.OHLCV])
    payload = b.select("symbol", F.to_json(F.array(arr)).alias("body"))
    return ohlcv(B.parse_klines(payload))


CSV_SQL = """SELECT event_type AS symbol, ts, round(value + 0.0131719e-6, 6) + 0.0 AS open, round(value + 0.0131719e-6, 6) + 0.0 AS high,
  round(value + 0.0131719e-6, 6) + 0.0 AS low, round(value + 0.0131719e-6, 6) + 0.0 AS close, 0.0 + round(0.0131719e-6, 6) AS volume
  FROM (SELECT event_type, date_trunc('second', ts) AS ts, value FROM events WHERE event_id % 11 <> 0)"""


def csv_lines(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.when(F.col("event_id") % 11 == 0, "not a date").otherwise(F.date_trunc("second", "ts").cast("string")).alias("Date"),
                     F.col("value").cast("string").alias("Close"), F.col("event_type").alias("symbol"))


@query("src.csv_bars", CSV_SQL)
def src_csv_bars(spark, sf):
    return ohlcv(B.parse_csv_bars(csv_lines(spark, sf)))


@query("src.csv_file", CSV_SQL)
def src_csv_file(spark, sf):
    """The same lines through CSV files with a header, one folder for each symbol."""
    import uuid

    from tickloom.session import shared_folder
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    lines = csv_lines(spark, sf)
    lines.write.partitionBy("symbol").option("header", True).csv(path)
    symbols = [r.symbol for r in lines.select("symbol").distinct().collect()]  # the few event types
    parts = [B.read_csv_bars(spark, f"{path}/symbol={s}", s) for s in sorted(symbols)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ohlcv(out)


@query("prep.union_ranges", f"""WITH {BARS_H}, parts AS (
  SELECT 0 AS part, symbol, ts, open, high, low, close, volume FROM bars WHERE bar_idx < 400
  UNION ALL SELECT 1, symbol, ts, open + 1, high + 1, low + 1, close + 1, volume FROM bars WHERE bar_idx >= 300),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY part) AS rn FROM parts)
  SELECT symbol, ts, {', '.join(f'{r6(c)} AS {c}' for c in OHLCV_SQL)} FROM ranked WHERE rn = 1""")
def prep_union(spark, sf):
    b = bars_h(spark, sf)
    shifted = b.withColumns({c: F.col(c) + 1 for c in B.OHLCV[:4]})
    cols = ["symbol", "ts", *B.OHLCV]
    return ohlcv(B.union_ranges([b.filter("bar_idx < 400").select(*cols), shifted.filter("bar_idx >= 300").select(*cols)]))


CLEAN_SQL = ", ".join(
    r6(f"coalesce(last_value({c}_n IGNORE NULLS) {over()}, 0)") + f" AS {c}" for c in OHLCV_SQL)


@query("prep.clean", f"""WITH {BARS_H}, holes AS (SELECT symbol, bar_idx, {', '.join(f'CASE WHEN bar_idx % 5 < 2 THEN NULL ELSE {c} END AS {c}_n' for c in OHLCV_SQL)} FROM bars)
  SELECT symbol, bar_idx::BIGINT AS bar_idx, {CLEAN_SQL} FROM holes""")
def prep_clean(spark, sf):
    b = bars_h(spark, sf)
    holes = b.withColumns({c: F.when(F.col("bar_idx") % 5 >= 2, F.col(c).cast("string")) for c in B.OHLCV})
    return ohlcv(B.clean(holes), ("symbol", "bar_idx"))


CTX_COLS = ("spy_close", "vix_close", "us10y_close", "hyg_close", "dx_close", "btc_close", "uso_close")


@query("prep.context_join", f"WITH {BARS_C} SELECT symbol, bar_idx::BIGINT AS bar_idx, {', '.join(f'{r6(c)} AS {c}' for c in CTX_COLS)} FROM bars_ctx")
def prep_context_join(spark, sf):
    return rounded(bars_c(spark, sf), list(CTX_COLS))


@query("prep.asof", f"""WITH {BARS_D}, {CONTEXT}, monthly AS (
  SELECT date_trunc('month', ts)::TIMESTAMP AS ts, avg(vix_close) AS macro FROM context GROUP BY 1 HAVING avg(vix_close) IS NOT NULL)
  SELECT b.symbol, b.bar_idx::BIGINT AS bar_idx, {r6('m.macro')} AS macro FROM bars b ASOF LEFT JOIN monthly m ON b.ts >= m.ts""")
def prep_asof(spark, sf):
    monthly = context(spark, sf).groupBy(F.date_trunc("month", "ts").alias("ts")).agg(F.avg("vix_close").alias("macro"))
    return rounded(B.asof_join(bars_d(spark, sf), monthly), ["macro"])


@query("prep.feature_clean", select(BARS_H, *rsi_layers(14), {"m": win("avg", "close", 20)},
                                    out={"rsi": f"coalesce(last_value(rsi IGNORE NULLS) {over()}, 0)", "sma": f"coalesce(last_value(m IGNORE NULLS) {over()}, 0)"}))
def prep_feature_clean(spark, sf):
    df = compute_genome(bars_h(spark, sf), {"MOMENTUM_RSI_V1": {}, "TREND_SMA_V1": {}}, warmup="zero")
    return rounded(df, ["MOMENTUM_RSI_V1__rsi", "TREND_SMA_V1__sma"])


@query("prep.recent", f"WITH {BARS_H}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) "
       f"SELECT symbol, ts, {', '.join(f'{r6(c)} AS {c}' for c in OHLCV_SQL)} FROM r WHERE rn <= 100")
def prep_recent(spark, sf):
    return ohlcv(B.last_bars(bars_h(spark, sf), 100))


@query("prep.reduced", f"""WITH {BARS_D}, n AS (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY 1),
  s AS (SELECT DISTINCT symbol, floor(i * greatest(n - 500, 0) / 2.0)::BIGINT AS st FROM n, range(3) t(i))
  SELECT DISTINCT b.symbol, b.bar_idx::BIGINT AS bar_idx, {r6('close')} AS close FROM bars b JOIN s ON b.symbol = s.symbol AND b.bar_idx >= s.st AND b.bar_idx < s.st + 500""")
def prep_reduced(spark, sf):
    return rounded(B.reduced_bars(bars_d(spark, sf), 3, 500), ["close"])


@query("prep.scenario_data", f"""WITH {BARS_H}, n AS (SELECT symbol, max(bar_idx) AS last FROM bars GROUP BY 1)
  SELECT symbol, bar_idx::BIGINT AS bar_idx, {r6('100.0 + coalesce(bar_idx * 100.0 / nullif(last, 0), 0)')} AS close, {r6('0')} AS volume FROM bars JOIN n USING (symbol)""")
def prep_scenario(spark, sf):
    return rounded(B.zero_volume_scenario(B.uptrend_scenario(bars_h(spark, sf))), ["close", "volume"])


SIGNED = ["symbol", "ts", "bar_idx", "open", "high", "low", "close", "volume"]
_text = {c: f"coalesce(round({c} * 1000000)::DECIMAL(38,0)::VARCHAR, '')" for c in SIGNED[3:]} | {"symbol": "coalesce(symbol, '')", "ts": "coalesce(epoch(ts)::BIGINT::VARCHAR, '')", "bar_idx": "coalesce(bar_idx::VARCHAR, '')"}


@query("prep.signature", f"""WITH {BARS_H}, s AS (SELECT coalesce(sum(concat('0x', substr(md5({" || '|' || ".join(_text[c] for c in SIGNED)}), 1, 15))::BIGINT::HUGEINT), 0) AS s, count(*) AS n FROM bars)
  SELECT sha256('{','.join(SIGNED)}|' || s) AS signature, n AS rows FROM s""")
def prep_signature(spark, sf):
    return B.signature(bars_h(spark, sf).select(*SIGNED))


# -- 2.2 vector helpers ------------------------------------------------------------------------

def scoped(spark, sf, build, names, source=bars_h, digits=6):
    return rounded(C.with_columns_on(source(spark, sf), build), names, digits)


register("vec.arith", lambda spark, sf: bars_h(spark, sf).select(
    "symbol", "bar_idx", *[rnd(fn("high", "low")).alias(n) for n, fn in
                           (("added", V.add), ("subtracted", V.subtract), ("multiplied", V.multiply), ("divided", V.divide))]),
    select(BARS_H, out={"added": "high + low", "subtracted": "high - low", "multiplied": "high * low", "divided": "high / nullif(low, 0)"}))
register("vec.arith_scalar", lambda spark, sf: bars_h(spark, sf).select(
    "symbol", "bar_idx", rnd(V.add("close", 3)).alias("add3"), rnd(V.subtract("close", 3)).alias("sub3"), rnd(V.multiply("close", 3)).alias("mul3"),
    rnd(V.divide("close", 3)).alias("div3"), rnd(V.power("close", 2)).alias("pow2")),
    select(BARS_H, out={"add3": "close + 3", "sub3": "close - 3", "mul3": "close * 3", "div3": "close / 3", "pow2": "pow(close, 2)"}))


@query("vec.shift", select(BARS_H, out={"right2": f"coalesce({lag('close', 2)}, 0)", "left2": f"coalesce(lead(close, 2) {over()}, 0)"}))
def vec_shift(spark, sf):
    df = C.with_columns_on(bars_h(spark, sf), lambda s: {"right2": V.shift_right(s, "close", 2)})
    return rounded(V.shift_left(df, "left2", "close", 2), ["right2", "left2"])


register("vec.changes", lambda spark, sf: scoped(spark, sf, lambda s: {"change": V.changes(s, "close", 3)}, ["change"]),
         select(BARS_H, out={"change": f"close - coalesce({lag('close', 3)}, 0)"}))
register("vec.signs", lambda spark, sf: bars_h(spark, sf).select("symbol", "bar_idx", V.extract_signs(F.col("close") - F.col("open")).cast("bigint").alias("sgn")),
         f"WITH {BARS_H} SELECT symbol, bar_idx::BIGINT AS bar_idx, (CASE WHEN close - open >= 0 THEN 1 ELSE -1 END)::BIGINT AS sgn FROM bars")
register("vec.abs_max_round", lambda spark, sf: bars_h(spark, sf).select(
    "symbol", "bar_idx", rnd(F.abs(F.col("close") - F.col("open"))).alias("move"), rnd(F.greatest("open", "close")).alias("body_high"),
    rnd(F.round(F.col("close") / 3 + 0.0001, 2)).alias("rounded")),
    select(BARS_H, out={"move": "abs(close - open)", "body_high": "greatest(open, close)", "rounded": "round(close / 3 + 0.0001, 2)"}))

# -- 2.3 in-house indicators -------------------------------------------------------------------


def partial(agg: str, x: str, n: int) -> str:
    return f"{agg}({x}) {over(n)}"


TR0 = f"greatest(high - low, abs(high - coalesce({lag('close')}, close)), abs(low - coalesce({lag('close')}, close)))"
MFI_SQL = [{"flow": "(high + low + close) / 3 * volume"}, {"sg": f"CASE WHEN flow - coalesce({lag('flow')}, 0) >= 0 THEN flow ELSE -flow END"},
           {"p": partial("sum", "(CASE WHEN sg >= 0 THEN sg ELSE 0 END)", 14), "n": partial("sum", "(CASE WHEN sg < 0 THEN -sg ELSE 0 END)", 14)}]
IND = {
    "ind_sma": (lambda s: {"sma": V.sma(s, "close", 2)}, [], {"sma": partial("avg", "close", 2)}),
    "ind_ema": (lambda s: {"ema": V.ema(s, "e", "close", 12).col}, [ema("e", "close", span(12))], {"ema": "e"}),
    "ind_rma": (lambda s: {"rma": V.rma(s, "r", "close", 4)}, [wilders(4, w="close")], {"rma": "w"}),
    "ind_msum": (lambda s: {"msum": V.msum(s, "close", 4)}, [], {"msum": partial("sum", "close", 4)}),
    "ind_mstd": (lambda s: {"mstd": V.mstd(s, "close", 4)}, [], {"mstd": f"coalesce({win('stddev_pop', 'close', 4)}, 0)"}),
    "ind_typical_price": (lambda s: {"tp": (F.col("high") + F.col("low") + F.col("close")) / 3}, [], {"tp": "(high + low + close) / 3"}),
    "ind_macd": (lambda s: V.macd(s), [emas(f=("close", span(12)), q=("close", span(26))), {"line": "f - q"}, ema("g", "line", span(9))],
                 {"macd_line": "line", "signal_line": "g"}),
    "ind_rsi": (lambda s: {"rsi": V.rsi(s)},
                [{"d": f"close - {lag('close')}"}, {"u": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "v": "CASE WHEN d <= 0 THEN -d ELSE 0.0 END"},
                 wilders(14, wu="u", wv="v")],
                {"rsi": "CASE WHEN bar_idx = 0 THEN 0 WHEN wv = 0 THEN 100 ELSE 100 - 100 / (1 + wu / nullif(wv, 0)) END"}),
    "ind_true_range": (lambda s: {"tr": V.true_range(s)}, [], {"tr": TR0}),
    "ind_atr": (lambda s: V.atr(s), [{"tr": TR0}], {"tr_line": "tr", "atr_line": partial("avg", "tr", 14)}),
    "ind_bbands": (lambda s: V.bollinger(s), [{"m": partial("avg", "close", 20), "sd": f"coalesce({win('stddev_pop', 'close', 20)}, 0)"}],
                   {"upper": "m + 2 * sd", "middle": "m", "lower": "m - 2 * sd"}),
    "ind_vwap": (lambda s: {"vwap": V.vwap(s)}, [{"cv": "close * volume"}], {"vwap": f"{partial('sum', 'cv', 14)} / nullif({partial('sum', 'volume', 14)}, 0)"}),
    "ind_obv": (lambda s: {"obv": V.obv(s)}, [{"d": f"close - {lag('close')}"}],
                {"obv": "sum(CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"}),
    "ind_mfi": (lambda s: {"mfi": V.mfi(s)}, MFI_SQL, {"mfi": "100 - 100 / (1 + p / nullif(n, 0))"}),
}
for _name, (_build, _layers, _outs) in IND.items():
    register(_name, lambda spark, sf, b=_build, o=tuple(_outs): scoped(spark, sf, b, list(o)), select(BARS_H, *_layers, out=_outs))

# -- shared window operators -------------------------------------------------------------------

register("win.run_length", lambda spark, sf: scoped(spark, sf, lambda s: {"run": s.run_length("r", F.col("close") > F.col("open"))}, ["run"]),
         select(BARS_H, Rec({"run": ("CASE WHEN close > open THEN 1 ELSE 0 END", "CASE WHEN x.close > x.open THEN r.run + 1 ELSE 0 END")}), out={"run": "run"}))
register("win.pct_rank_last", lambda spark, sf: scoped(spark, sf, lambda s: {"rank": rank_last(s, "volume", 20)}, ["rank"]),
         select(BARS_H, out={"rank": rank_last_sql("volume", 20)}))
register("win.rolling_quantile", lambda spark, sf: scoped(spark, sf, lambda s: {"q20": s.quantile("close", 0.2, 30), "q90": s.quantile("close", 0.9, 30)}, ["q20", "q90"]),
         select(BARS_H, out={"q20": win("quantile_cont({}, 0.2)", "close", 30), "q90": win("quantile_cont({}, 0.9)", "close", 30)}))


def ewm_std(s: Scope, name: str, x, n: int):
    """Bias-corrected deviation with weights (1 - alpha)^age, normalised: four scans and a closed form."""
    v, a = s.let(name + "_v", x), 1 - 2.0 / (n + 1)
    ok = v.isNotNull()
    sw = s.scan(name + "_w", a, F.lit(1.0), valid=ok)
    sw2 = s.scan(name + "_w2", a * a, F.lit(1.0), valid=ok)
    sx = s.scan(name + "_x", a, v, valid=ok)
    sxx = s.scan(name + "_xx", a, v * v, valid=ok)
    mean = sx / F.when(sw != 0, sw)
    var = F.greatest(sxx / F.when(sw != 0, sw) - mean * mean, F.lit(0.0))
    bias = sw * sw - sw2
    return F.when(bias > 1e-12, F.sqrt(var * sw * sw / F.when(bias != 0, bias)))


def ewm_std_layers(n: int, t: str = "") -> list:
    a = f"(1 - 2.0::DOUBLE / {n + 1})"
    step = lambda k, add: f"CASE WHEN x.q{t} IS NULL THEN r.{k}{t} ELSE r.{k}{t} * {a if k != 'w2' else f'{a} * {a}'} + {add} END"
    w, w2, sx, sxx = f"w{t}", f"w2{t}", f"sx{t}", f"sxx{t}"
    rec = Rec({w: ("0.0", step("w", "1")), w2: ("0.0", step("w2", "1")), sx: ("0.0", step("sx", f"x.q{t}")), sxx: ("0.0", step("sxx", f"x.q{t} * x.q{t}"))})
    bias = f"{w} * {w} - {w2}"
    var = f"greatest({sxx} / nullif({w}, 0) - pow({sx} / nullif({w}, 0), 2), 0)"
    return [{f"q{t}": pct("close")}, rec, {f"vol{t}": f"CASE WHEN {bias} > 1e-12 THEN sqrt({var} * {w} * {w} / nullif({bias}, 0)) END"}]


register("scan.ewm_std", lambda spark, sf: scoped(spark, sf, lambda s: {"vol": ewm_std(s, "v", s.pct("close"), 100)}, ["vol"]),
         select(BARS_H, *ewm_std_layers(100), out={"vol": "vol"}))
register("lbl.vol", lambda spark, sf: scoped(spark, sf, lambda s: {"vol100": ewm_std(s, "a", s.pct("close"), 100), "vol50": ewm_std(s, "b", s.pct("close"), 50)},
                                             ["vol100", "vol50"], bars_d),
         select(BARS_D, *ewm_std_layers(100, "a"), *ewm_std_layers(50, "b"), out={"vol100": "vola", "vol50": "volb"}))

# -- features as a genome ----------------------------------------------------------------------

GENOME = {"MOMENTUM_RSI_V1": {"window": 10}, "TREND_SMA_V1": {"window": 30}, "VOLATILITY_STD_V1": {}, "TREND_EMA_V1": {"window": 15}}
GENOME_SQL = [*rsi_layers(10), ema("e", "close", span(15)), {"m": win("avg", "close", 30), "sd": win("stddev_samp", "close", 20)}]
GENOME_COLS = ["MOMENTUM_RSI_V1__rsi", "TREND_SMA_V1__sma", "VOLATILITY_STD_V1__std", "TREND_EMA_V1__ema"]


@query("feat.genome", select(BARS_D, *GENOME_SQL, out={"rsi": "rsi", "sma": "m", "std": "sd", "ema": "e"}))
def feat_genome(spark, sf):
    return rounded(compute_genome(bars_d(spark, sf), GENOME), GENOME_COLS)


@query("feat.preview", select(BARS_H, *rsi_layers(14), {"n": "count(*) OVER (PARTITION BY symbol)"}, out={"close": "close", "rsi": "rsi"},
                              where="WHERE bar_idx >= n - 500"))
def feat_preview(spark, sf):
    df = compute_genome(bars_h(spark, sf), {"MOMENTUM_RSI_V1": {}})
    return rounded(B.last_bars(df, 500), ["close", "MOMENTUM_RSI_V1__rsi"])


@query("feat.health", (lambda c: f"""{c[0]}
  SELECT feature, count(*)::BIGINT AS n_rows, count(*) FILTER (v IS NULL)::BIGINT AS n_null, (min(v) = max(v))::BOOLEAN AS is_constant,
    count(*) FILTER (isinf(v) OR isnan(v))::BIGINT AS n_nonfinite FROM (
    SELECT unnest([{{'feature': 'rsi', 'v': rsi::DOUBLE}}, {{'feature': 'sma', 'v': m}}, {{'feature': 'std', 'v': sd}}, {{'feature': 'ema', 'v': e}}], recursive := true) FROM {c[1]})
  GROUP BY feature""")(chain(BARS_D, *GENOME_SQL)))
def feat_health(spark, sf):
    df = compute_genome(bars_d(spark, sf), GENOME)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c.split("__")[1]).alias("feature"), F.col(c).alias("v")) for c in GENOME_COLS])).alias("e")).select("e.*")
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), (F.min("v") == F.max("v")).alias("is_constant"),
        F.count_if(odd).alias("n_nonfinite"))


@query("feat.resolve", "SELECT * FROM (VALUES ('MOMENTUM_RSI_V1', 'value', 'MOMENTUM_RSI_V1__rsi'), ('TREND_SMA_V1', 'value', 'TREND_SMA_V1__sma')) t(feature_id, output_key, column_name)"
       " WHERE (SELECT count(*) FROM events) > 0")
def feat_resolve(spark, sf):
    """Registry outputs joined to the columns of a computed feature frame."""
    cols = compute_genome(bars_h(spark, sf), {"MOMENTUM_RSI_V1": {}, "TREND_SMA_V1": {}}).columns
    from tickloom.operators.features import resolve
    rows = [(f, "value", resolve(cols, f)) for f in ("MOMENTUM_RSI_V1", "TREND_SMA_V1")]
    return spark.createDataFrame(rows, "feature_id string, output_key string, column_name string")


def user_spread(s: Scope, window: int):
    return {"spread": s.avg("high", window) - s.avg("low", window)}


@query("udf.custom_feature", select(BARS_H, out={"spread": f"{win('avg', 'high', 12)} - {win('avg', 'low', 12)}"}))
def custom_feature(spark, sf):
    reg = REGISTRY.copy()
    reg.add(FeatureDef("USER_SPREAD", "CUSTOM", user_spread, (("window", "int", 2.0, 50.0, 12),), {"value": "spread"}))
    return rounded(compute_genome(bars_h(spark, sf), {"USER_SPREAD": {}}, reg), ["USER_SPREAD__spread"])


# -- state-machine features --------------------------------------------------------------------

SUPER = [{"tr": TR}, wilders(7, w="tr"), {"a": f"coalesce({mask('w', 6)}, 0)"}, {"bu": "(high + low) / 2 + 3 * a", "bl": "(high + low) / 2 - 3 * a", "pc": lag("close")},
         Rec({"fu": ("bu", "CASE WHEN x.bu < r.fu OR x.pc > r.fu THEN x.bu ELSE r.fu END"), "fl": ("bl", "CASE WHEN x.bl > r.fl OR x.pc < r.fl THEN x.bl ELSE r.fl END")}),
         Rec({"tr_": ("1", "CASE WHEN r.tr_ > 0 THEN (CASE WHEN x.close <= x.fl THEN -1 ELSE 1 END) ELSE (CASE WHEN x.close >= x.fu THEN 1 ELSE -1 END) END")})]
_native = lambda fid, outs: lambda spark, sf: rounded(compute_genome(bars_h(spark, sf), {fid: {}}), [f"{fid}__{o}" for o in outs])
register("TREND_SUPER_V1", _native("TREND_SUPER_V1", ["trend", "upper", "lower"]), select(BARS_H, *SUPER, out={"trend": "tr_", "upper": "fu", "lower": "fl"}))

_GUESS = "CASE WHEN r.up > 0 THEN r.sar + r.af * (r.top - r.sar) ELSE r.sar - r.af * (r.sar - r.bot) END"
_FLIP = f"(x.bar_idx >= 2 AND ((r.up > 0 AND x.low < {_GUESS}) OR (r.up = 0 AND x.high > {_GUESS})))"
PSAR = [{"l1": lag("low"), "l2": lag("low", 2), "h1": lag("high"), "h2": lag("high", 2)}, Rec({
    "up": ("1", f"CASE WHEN {_FLIP} THEN 1 - r.up ELSE r.up END"),
    "af": ("0.02", f"CASE WHEN x.bar_idx < 2 THEN r.af WHEN {_FLIP} THEN 0.02 WHEN r.up > 0 AND x.high > r.top THEN least(r.af + 0.02::DOUBLE, 0.2) "
                   "WHEN r.up = 0 AND x.low < r.bot THEN least(r.af + 0.02::DOUBLE, 0.2) ELSE r.af END"),
    "top": ("high", f"CASE WHEN x.bar_idx < 2 THEN r.top WHEN {_FLIP} THEN (CASE WHEN r.up > 0 THEN r.top ELSE x.high END) WHEN r.up > 0 THEN greatest(r.top, x.high) ELSE r.top END"),
    "bot": ("low", f"CASE WHEN x.bar_idx < 2 THEN r.bot WHEN {_FLIP} THEN (CASE WHEN r.up > 0 THEN x.low ELSE r.bot END) WHEN r.up = 0 THEN least(r.bot, x.low) ELSE r.bot END"),
    "sar": ("close", f"CASE WHEN x.bar_idx < 2 THEN x.close WHEN {_FLIP} THEN (CASE WHEN r.up > 0 THEN r.top ELSE r.bot END) "
                     f"WHEN r.up > 0 THEN (CASE WHEN x.l2 < {_GUESS} THEN x.l2 WHEN x.l1 < {_GUESS} THEN x.l1 ELSE {_GUESS} END) "
                     f"ELSE (CASE WHEN x.h2 > {_GUESS} THEN x.h2 WHEN x.h1 > {_GUESS} THEN x.h1 ELSE {_GUESS} END) END")})]
register("TREND_PSAR_V1", _native("TREND_PSAR_V1", ["psar", "up", "down"]),
         select(BARS_H, *PSAR, out={"psar": "sar", "up": "CASE WHEN bar_idx >= 2 AND t1.up > 0 THEN sar END", "down": "CASE WHEN bar_idx >= 2 AND t1.up = 0 THEN sar END"}))
_K = "(r.p + 1e-5::DOUBLE) / (r.p + 1e-5::DOUBLE + x.rv)"
AKALMAN = [{"q": pct("close")}, {"rv": f"0.01::DOUBLE * (1 + 100 * coalesce({win('stddev_samp', 'q', 20)}, 0.01))"},
           Rec({"xe": ("close", f"r.xe + {_K} * (x.close - r.xe)"), "p": ("1.0", f"(1 - {_K}) * (r.p + 1e-5::DOUBLE)")})]
register("ADAPTIVE_KALMAN_V1", _native("ADAPTIVE_KALMAN_V1", ["adapt_kalman"]), select(BARS_H, *AKALMAN, out={"adapt_kalman": "xe"}))

# -- 2.5 context, regime, state ----------------------------------------------------------------


def cl(x: str, lo, hi) -> str:
    out = x
    if lo is not None:
        out = f"(CASE WHEN {x} < {lo} THEN {lo} ELSE {x} END)"
    return out if hi is None else f"(CASE WHEN {out} > {hi} THEN {hi} ELSE {out} END)"


SRSI = [{"d": f"close - {lag('close')}"}, {"g_": win("avg", "(CASE WHEN d > 0 THEN d ELSE 0 END)", 14), "l_": win("avg", "(CASE WHEN d < 0 THEN -d ELSE 0 END)", 14)},
        {"srsi": "100 - 100 / (1 + g_ / (l_ + 1e-8::DOUBLE))"}]
CTX_SQL = [
    *SRSI, {"ret": pct("close"), "nb": "count(*) OVER (PARTITION BY symbol)"},
    {"m20": win("avg", "close", 20), "m50": win("avg", "close", 50), "m200": win("avg", "close", 200), "roc5": pct("close", 5), "roc20": pct("close", 20)},
    {"base": "CASE WHEN nb > 200 THEN m200 ELSE m50 END", "vx": cl("((vix_close - 10) / 70)", 0, 1)},
    {"a1": cl("((close - m20) / (m20 + 1e-8::DOUBLE))", -0.5, 0.5), "a2": cl("((m20 - m50) / (m50 + 1e-8::DOUBLE))", -0.5, 0.5),
     "a3": cl("((close - base) / (base + 1e-8::DOUBLE))", -0.5, 0.5)},
    {"tr_": cl("((a1 * 2 + a2 * 2 + a3 * 2) / 3)", -1, 1), "mo": cl("((roc5 * 0.6 + roc20 * 0.4) / 0.2)", -1, 1)},
    {"rg": cl("((1 - vx) * 0.3 + tr_ * 0.4 + mo * 0.3)", -1, 1),
     "vr": cl(f"({win('stddev_samp', 'ret', 10)} / ({win('stddev_samp', 'ret', 50)} + 1e-8::DOUBLE))", 0.5, 2.0)},
]
CTX_OUT = {
    "CTX_VIX": "vx", "CTX_VIX_CHANGE": cl(pct("vix_close", 5), -0.5, 0.5), "CTX_TREND": "tr_", "CTX_TREND_DIR": "coalesce(sign(tr_), 0)", "CTX_MOMENTUM": "mo",
    "CTX_RSI_LEVEL": cl("(srsi / 100)", 0, 1), "CTX_REGIME": "rg", "CTX_REGIME_CAT": "CASE WHEN rg < -0.3 THEN -1 WHEN rg > 0.3 THEN 1 ELSE 0 END",
    "CTX_VOL_REGIME": cl("((vr - 1) / 0.5)", -1, 1), "CTX_VOLUME": cl(f"(volume / ({win('avg', 'volume', 20)} + 1e-8::DOUBLE) / 3)", 0, 1)}
FILLED = lambda cols: {c: f"coalesce(last_value({c} IGNORE NULLS) {over()}, 0)" for c in cols}
register("ctx.features", lambda spark, sf: rounded(C.context_features(bars_c(spark, sf)), C.CTX),
         select(BARS_C, *CTX_SQL, CTX_OUT, out=FILLED(CTX_OUT), source="bars_ctx"))

DIR = [{"m50": win("avg", "close", 50), "m200": win("avg", "close", 200), "nb": "count(*) OVER (PARTITION BY symbol)"},
       {"dir": "(CASE WHEN close > m50 THEN 0.5 WHEN close < m50 THEN -0.5 ELSE 0 END) + (CASE WHEN m50 > m200 THEN 0.5 WHEN m50 < m200 THEN -0.5 ELSE 0 END)"}]
CORR = win("corr({}, volume)", "close", 20)
NOCORR = f"(CASE WHEN isnan({CORR}) THEN NULL ELSE {CORR} END)"
register("ctx.injected", lambda spark, sf: C.injected_context(bars_d(spark, sf)).select("symbol", "bar_idx", *[rnd(c).alias(c.strip("_")) for c in C.INJECTED]),
         select(BARS_D, *DIR, {"lr": f"ln(close / {lag('close')})"},
                {"vr": cl(f"({win('stddev_samp', 'lr', 20)} / ({win('stddev_samp', 'lr', 100)} + 1e-9::DOUBLE))", 0, 5), "cr": NOCORR,
                 "sh": f"close < {win('avg', 'close', 20)} - 2.5 * {win('stddev_samp', 'close', 20)}"},
                out={"CTX_TrendScore": "CASE WHEN nb > 200 THEN dir END", "CTX_VolRatio": "coalesce(vr, 1)", "CTX_PVCorr": "coalesce(cr, 0)",
                     "CTX_ShockFlag": "coalesce(sh::INT, 0)"}))
REGIME_SQL = [
    *adx_layers(14), *DIR, {"ret": pct("close")},
    {"ts_": f"dir * {cl('(coalesce(adx, 0) / 50.0)', 0, 1)}", "vl": f"coalesce({win('stddev_samp', 'ret', 20)} / nullif({win('stddev_samp', 'ret', 100)}, 0), 1)",
     "sh": f"coalesce(close < {win('avg', 'close', 20)} - 2.5 * {win('stddev_pop', 'close', 20)}, false)", "hm": win("avg", "hyg_close", 50)},
    {"hy": "coalesce((hyg_close - hm) / nullif(hm, 0), 0)"},
    {"label": "CASE WHEN nb < 50 THEN 'SIDEWAYS' WHEN vix_close > 30 OR sh OR ts_ < -0.7 OR hy < -0.05 THEN 'PANIC' WHEN ts_ < -0.1 AND us10y_close > 4.2 THEN 'STAGFLATION' "
              "WHEN ts_ > 0.4 AND vix_close < 25 THEN 'BULL_RUN' WHEN ts_ > 0 AND vix_close < 20 AND us10y_close < 4.0 THEN 'GOLDILOCKS' WHEN vl > 1.5 THEN 'HIGH_VOL' "
              "WHEN ts_ < -0.2 THEN 'BEAR_TREND' ELSE 'SIDEWAYS' END"}]
_rg, _rl = chain(BARS_C, *REGIME_SQL, source="bars_ctx")
register("reg.series", lambda spark, sf: C.regime_series(bars_c(spark, sf)).select("symbol", "bar_idx", "regime_label"),
         f"{_rg} SELECT symbol, bar_idx::BIGINT AS bar_idx, label AS regime_label FROM {_rl}")
_cg, _clast = chain(BARS_C, *REGIME_SQL, {"cr": NOCORR}, source="bars_ctx")
register("reg.current", lambda spark, sf: C.regime_current(bars_c(spark, sf)).select(
    "symbol", rnd("trend_score").alias("trend_score"), rnd("vol_level").alias("vol_level"), rnd("corr_score").alias("corr_score"), "shock_flag", "label",
    F.col("hour").cast("bigint").alias("hour"), F.col("session_id").cast("bigint").alias("session_id")),
    f"{_cg} SELECT symbol, {r6('ts_')} AS trend_score, {r6('vl')} AS vol_level, {r6('coalesce(cr, 0)')} AS corr_score, sh AS shock_flag, label, hour(ts)::BIGINT AS hour, "
    f"(CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 14 THEN 1 WHEN hour(ts) < 22 THEN 2 ELSE 3 END)::BIGINT AS session_id FROM {_clast} WHERE bar_idx = nb - 1")
register("reg.session", lambda spark, sf: C.session(bars_h(spark, sf)).select("symbol", "bar_idx", F.col("hour").cast("bigint").alias("hour"), F.col("session_id").cast("bigint").alias("session_id")),
         f"WITH {BARS_H} SELECT symbol, bar_idx::BIGINT AS bar_idx, hour(ts)::BIGINT AS hour, (CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 14 THEN 1 WHEN hour(ts) < 22 THEN 2 ELSE 3 END)::BIGINT AS session_id FROM bars")
STATE_SQL = [
    *SRSI, {"ret": pct("close"), "mret": pct("spy_close"), "ma": win("avg", "close", 20), "sd": win("stddev_samp", "close", 20)},
    {"tr_": "(close - ma) / (ma + 1e-8::DOUBLE)", "mc": "CASE WHEN isnan(%s) THEN NULL ELSE %s END" % ((win("corr({}, ret)", "mret", 20),) * 2)},
    {"vix_norm": "vix_close", "vix_change": pct("vix_close", 5), "trend_score": "tr_", "momentum_rsi": "srsi", "return_5d": pct("close", 5), "return_20d": pct("close", 20),
     "realized_vol": f"{win('stddev_samp', 'ret', 20)} * sqrt(252)", "bb_position": "(close - ma) / (2 * sd + 1e-8::DOUBLE)",
     "volume_ratio": f"volume / ({win('avg', 'volume', 20)} + 1e-8::DOUBLE)", "yield_spread": "0.0", "market_corr": "mc",
     "regime_score": f"(1 - {cl('(vix_close / 50)', 0, 1)}) * 0.4 + {cl('tr_', -1, 1)} * 0.4 + coalesce(mc, 0) * 0.2"}]
register("state.features", lambda spark, sf: rounded(C.state_features(bars_c(spark, sf)), C.STATE), select(BARS_C, *STATE_SQL, out=FILLED(C.STATE), source="bars_ctx"))
_sg, _sl = chain(BARS_C, *STATE_SQL, source="bars_ctx")
_filled = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) {over()}, 0)::DOUBLE AS {c}" for c in C.STATE)
_long = f"sf AS MATERIALIZED (SELECT symbol, bar_idx, {_filled} FROM {_sl}), long AS (" + " UNION ALL ".join(
    f"SELECT symbol, bar_idx, {i} AS i, '{c}' AS feature, {c} AS v FROM sf" for i, c in enumerate(C.STATE)) + \
    "), scaler AS (SELECT symbol, feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, avg(v) AS mean, stddev_samp(v) AS std FROM long GROUP BY ALL)"
register("state.scaler", lambda spark, sf: C.state_scaler(C.state_features(bars_c(spark, sf))).select(
    "symbol", "feature", *[rnd(c).alias(c) for c in ("min", "max", "mean", "std")]),
    f"{_sg}, {_long} SELECT symbol, feature, {r6('lo')} AS min, {r6('hi')} AS max, {r6('mean')} AS mean, {r6('std')} AS std FROM scaler")
register("state.encode", lambda spark, sf: (lambda f: C.state_encode(f, C.state_scaler(f)).select(
    "symbol", F.posexplode("vector").alias("pos", "x")).select("symbol", F.col("pos").cast("bigint").alias("pos"), rnd("x").alias("x")))(C.state_features(bars_c(spark, sf))),
    f"{_sg}, {_long}, n AS (SELECT symbol, max(bar_idx) + 1 AS n FROM sf GROUP BY 1) SELECT l.symbol, ((bar_idx - (n - 20)) * 12 + i)::BIGINT AS pos, "
    f"{r6(cl('(2 * (v - lo) / (hi - lo + 1e-8::DOUBLE) - 1)', -1, 1))} AS x FROM long l JOIN n USING (symbol) JOIN scaler USING (symbol, feature) WHERE bar_idx >= n - 20")
register("state.position_bucket", lambda spark, sf: C.position_bucket(table(spark, sf, "lineitem").select(
    "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") - F.col("l_tax")).alias("pnl_pct"), F.col("l_quantity").alias("duration"), (F.col("l_tax") * 10).alias("confidence")))
    .groupBy("state_key").agg(F.count(F.lit(1)).alias("n")),
    """SELECT (CASE WHEN p < -0.02 THEN 'LOSS_BIG' WHEN p < 0 THEN 'LOSS_SMALL' WHEN p < 0.02 THEN 'PROFIT_SMALL' WHEN p < 0.05 THEN 'PROFIT_MED' ELSE 'PROFIT_BIG' END)
      || '_' || (CASE WHEN d < 5 THEN 'SHORT' WHEN d < 20 THEN 'MED' ELSE 'LONG' END) || '_' || (CASE WHEN c >= 0.6 THEN 'HIGH' ELSE 'LOW' END) AS state_key, count(*)::BIGINT AS n
      FROM (SELECT l_discount - l_tax AS p, l_quantity AS d, l_tax * 10 AS c FROM lineitem) GROUP BY 1""")
