"""Sliced windows and carried scans against plain pandas over the whole series."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.operators import features as ft
from barloom.operators import signals as sg

RNG = np.random.default_rng(7)
N = 7000


def walk(n=N, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    opened = np.concatenate([[100.0], close[:-1]])
    high = np.maximum(opened, close) * (1 + rng.uniform(0, 0.01, n))
    low = np.minimum(opened, close) * (1 - rng.uniform(0, 0.01, n))
    return list(zip(opened, high, low, close, rng.integers(1, 50, n)))


def test_number_rows_and_scans_cross_slices(spark):
    rows = [("hot", i, float(v)) for i, v in enumerate(RNG.normal(size=500))]
    rows += [("cold", i, float(v)) for i, v in enumerate(RNG.normal(size=20))]
    df = spark.createDataFrame(rows, "asset string, t long, v double")
    cell = F.floor(F.col("t") / 37)
    numbered = s.number_rows(df, ["asset"], ["t"], cell)
    assert numbered.filter("pos <> t").count() == 0
    out = s.scan(df, ["asset"], ["t"], cell, {
        "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")),
        "known": ("last", F.when(F.col("v") > 0.5, F.col("v"))), "prod": ("product", 1 + F.col("v") / 100)})
    got = out.toPandas().sort_values(["asset", "t"])
    for _, g in got.groupby("asset"):
        assert np.allclose(g.total, g.v.cumsum())
        assert np.allclose(g.top, g.v.cummax()) and np.allclose(g.low, g.v.cummin())
        assert np.allclose(g["prod"], (1 + g.v / 100).cumprod())
        pd.testing.assert_series_equal(g.known, g.v.where(g.v > 0.5).ffill(), check_names=False)
    before = s.scan(df, ["asset"], ["t"], cell, {"prev": ("last", F.col("v"))}, exclusive=True).toPandas().sort_values(["asset", "t"])
    for _, g in before.groupby("asset"):
        pd.testing.assert_series_equal(g.prev, g.v.shift(1), check_names=False)


def test_features_do_not_depend_on_slice_borders(spark, make_bars):
    bars = make_bars({"A": walk()})
    cols = ["pos", *ft.PRICE_FEATURES, *ft.VOLUME_FEATURES, "obv"]
    whole = ft.features(bars, slice_rows=28_000).select(*cols).toPandas().sort_values("pos").reset_index(drop=True)
    cut = ft.features(bars, slice_rows=2_800).select(*cols).toPandas().sort_values("pos").reset_index(drop=True)
    assert len(whole) == N - ft.WARMUP_BARS
    for c in cols:
        assert np.allclose(whole[c], cut[c], rtol=1e-9, atol=1e-9), c


def test_features_match_pandas(spark, make_bars):
    raw = walk(3500, seed=3)
    got = ft.features(make_bars({"A": raw})).toPandas().sort_values("pos").reset_index(drop=True)
    df = pd.DataFrame(raw, columns=["open", "high", "low", "close", "volume"])
    diff = df.close.diff()
    up, down = diff.clip(lower=0), -diff.clip(upper=0)
    rsi = lambda com: 100 - 100 / (1 + up.ewm(com=com, adjust=False).mean() / (down.ewm(com=com, adjust=False).mean() + 1e-9))
    macd = (df.close.ewm(span=12, adjust=False).mean() - df.close.ewm(span=26, adjust=False).mean()) / (df.close + 1e-9)
    tr = pd.concat([df.high - df.low, (df.high - df.close.shift()).abs(), (df.low - df.close.shift()).abs()], axis=1).max(axis=1)
    obv = (np.sign(diff) * df.volume).fillna(0).cumsum()
    want = pd.DataFrame({
        "RSI_14": rsi(13), "RSI_70": rsi(69), "MACDs_12_26_9": macd.ewm(span=9, adjust=False).mean(),
        "ATR_14": tr.rolling(14).mean() / (df.close + 1e-9), "OBV_sma_70": obv.rolling(70).mean(),
        "realized_vol_30": np.log(df.close / df.close.shift()).rolling(30).std() * np.sqrt(365)})
    want = want.iloc[69:].reset_index(drop=True)
    for c in want:
        assert np.allclose(got[c], want[c], rtol=1e-8), c


def test_adx_matches_pandas(spark, make_bars):
    raw = walk(3200, seed=5)
    got = ft.average_directional_index(make_bars({"A": raw})).toPandas().sort_values("pos").reset_index(drop=True)
    df = pd.DataFrame(raw, columns=["open", "high", "low", "close", "volume"])
    tr = pd.concat([df.high - df.low, (df.high - df.close.shift()).abs(), (df.low - df.close.shift()).abs()], axis=1).max(axis=1)
    up, dn = df.high.diff(), -df.low.diff()
    e = lambda x: pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean()
    p = 100 * e(np.where((up > dn) & (up > 0), up, 0.0)) / e(tr)
    m = 100 * e(np.where((dn > up) & (dn > 0), dn, 0.0)) / e(tr)
    adx = e(100 * (p - m).abs() / (p + m + 1e-9))
    assert np.allclose(got.adx, adx, rtol=1e-8) and np.allclose(got.adx_prior, adx.shift(1).fillna(0), rtol=1e-8)


def test_signals_restart_on_trimmed_bars(spark, make_bars):
    raw = walk(400, seed=9)
    sides = sg.signal_sides(ft.feature_frame(make_bars({"A": raw})), {"breakout": sg.breakout(), "vol": sg.vol_breakout()})
    got = sides.toPandas().sort_values("bar").reset_index(drop=True)
    df = pd.DataFrame(raw, columns=["open", "high", "low", "close", "volume"]).iloc[69:].reset_index(drop=True)
    ph, pl = df.high.rolling(20).max().shift(1), df.low.rolling(20).min().shift(1)
    want = np.where(df.close < pl, -1, np.where(df.close > ph, 1, 0))
    assert (got.side_breakout.to_numpy() == want).all()
    rank = got.bb_width.rolling(100).rank(pct=True).shift(1)
    assert np.allclose(got.bb_width_rank.fillna(-1), rank.fillna(-1))
    assert (got.side_vol.to_numpy() == np.where(rank <= 0.35, want, 0)).all()


def test_as_of_never_reads_the_future(spark):
    left = pd.DataFrame({"asset": "A", "ts": pd.to_datetime(["2024-01-01", "2024-02-15", "2024-06-01"])})
    right = pd.DataFrame({"asset": "A", "ts": pd.to_datetime(["2024-01-02", "2024-02-15", "2024-03-01"]), "v": [1.0, 2.0, 3.0]})
    schema = "asset string, ts timestamp_ntz"
    out = s.attach_asof(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema + ", v double"), ["v"])
    got = out.toPandas().sort_values("ts")
    assert np.isnan(got.v.iloc[0]) and got.v.iloc[1:].tolist() == [2.0, 3.0]
