import datetime as dt

import numpy as np
import pandas as pd


def make_bars(spark, closes, symbol="S", **cols):
    """Bars with open = high = low = close unless given."""
    rows = pd.DataFrame({"symbol": symbol, "ts": [dt.datetime(2023, 1, 1) + dt.timedelta(days=i) for i in range(len(closes))], "bar_idx": range(len(closes)),
                         "open": closes, "high": closes, "low": closes, "close": closes, "volume": 100.0})
    for k, v in cols.items():
        rows[k] = v
    names = {"symbol": "string", "ts": "timestamp_ntz", "bar_idx": "bigint"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {names.get(c, 'boolean' if rows[c].dtype == bool else 'double')}" for c in rows.columns))


def random_walk(n, seed=7):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    high, low = close * (1 + rng.uniform(0, 0.01, n)), close * (1 - rng.uniform(0, 0.01, n))
    return {"closes": close.tolist(), "open": (low + (high - low) * rng.uniform(0, 1, n)).tolist(), "high": high.tolist(), "low": low.tolist(), "volume": rng.integers(1, 1000, n).astype(float).tolist()}


def frame(df, *order):
    return df.toPandas().sort_values(list(order or ("symbol", "bar_idx"))).reset_index(drop=True)
