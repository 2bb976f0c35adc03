"""Registered feature queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.operators import features as ft
from barloom.sources import tables as t


def _rounded(cols: dict[str, int]):
    return [F.round(F.col(c), d).alias(c) for c, d in cols.items()]


def _rounded_sql(cols: dict[str, int]) -> str:
    return ", ".join(f'round("{c}", {d}) AS "{c}"' for c, d in cols.items())


def _feature_query(cols: dict[str, int]) -> str:
    return q.with_(q.FEATURES, recursive=True) + f"SELECT asset, ts, bar, {_rounded_sql(cols)} FROM tf"


def _feature_rows(spark, sf_dir, cols):
    balance = any(c.startswith("OBV") for c in cols)
    return ft.features(t.numbered_bars(spark, sf_dir), balance=balance).select("asset", "ts", "bar", *_rounded(cols))


RETURNS = {"ret_1d": 8, "ret_2d": 8, "ret_3d": 8, "ret_5d": 8, "roc_10": 8, "roc_20": 8}
MACD = {"MACD_12_26_9": 7, "MACDs_12_26_9": 7, "MACDh_12_26_9": 7}
RSI = {"RSI_14": 6, "RSI_70": 6}
RANGE = {"ATR_14": 8, "ATR_50": 8, "ATR_ratio": 8, "atr": 5}
BANDS = {"bb_width": 8, "bb_pct": 8, "bb_position": 8}
AVERAGES = {"sma_dist": 8, "close_to_sma20": 8, "close_to_sma50": 8}
VOLATILITY = {"realized_vol_10": 8, "realized_vol_30": 8, "vol_regime": 8, "garman_klass_vol": 7}
VOLUME = {"vol_change_1d": 8, "vol_change_3d": 8, "vol_sma_20": 6, "vol_ratio": 8}
OBV = {"OBV_sma_20": 6, "OBV_sma_70": 5, "OBV_dist": 6, "OBV_trend": 6}


@query(_feature_query(RETURNS))
def feature_returns(spark, sf_dir):
    return _feature_rows(spark, sf_dir, RETURNS)


@query(_feature_query(MACD))
def feature_macd(spark, sf_dir):
    return _feature_rows(spark, sf_dir, MACD)


@query(_feature_query(RSI))
def feature_rsi(spark, sf_dir):
    return _feature_rows(spark, sf_dir, RSI)


@query(_feature_query(RANGE))
def feature_true_range(spark, sf_dir):
    return _feature_rows(spark, sf_dir, RANGE)


@query(_feature_query(BANDS))
def feature_bands(spark, sf_dir):
    return _feature_rows(spark, sf_dir, BANDS)


@query(_feature_query(AVERAGES))
def feature_average_distance(spark, sf_dir):
    return _feature_rows(spark, sf_dir, AVERAGES)


@query(_feature_query(VOLATILITY))
def feature_volatility(spark, sf_dir):
    return _feature_rows(spark, sf_dir, VOLATILITY)


@query(_feature_query(VOLUME))
def feature_volume(spark, sf_dir):
    return _feature_rows(spark, sf_dir, VOLUME)


@query(_feature_query(OBV))
def feature_on_balance_volume(spark, sf_dir):
    return _feature_rows(spark, sf_dir, OBV)


@query(q.with_(q.FEATURES, recursive=True) + "SELECT asset, ts, bar, dow, hour FROM tf")
def feature_clock(spark, sf_dir):
    return ft.features(t.numbered_bars(spark, sf_dir), balance=False).select("asset", "ts", "bar", "dow", "hour")
