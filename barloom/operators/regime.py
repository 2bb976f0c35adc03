"""Market regime of a leader asset and its agreement with trades."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import (
    BLOCK_ROWS, add_ewm, attach_asof, change, forward_fill, number_rows, own_rows, rolling, shifted, slice_bars)
from barloom.operators.features import SLICE_ROWS, TINY, named, span

BARS_PER_YEAR = 365 * 6
REGIME_COLUMNS = ["trend", "trend_strength", "above_sma", "leader_ret_5", "leader_vol", "leader_vol_ratio"]


def leader_bars(bars: DataFrame, leader: str) -> DataFrame:
    """The leader's own numbered series; the filter reaches the scan."""
    return number_rows(bars.filter(F.col("asset") == leader).drop("pos"))


def leader_regime(leader: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Trend, strength, average side, five-bar return and volatility of the leader.

    An unknown average counts as below it.
    """
    laid = slice_bars(leader, back=BLOCK_ROWS, slice_rows=slice_rows)
    out = laid.selectExpr("*", *named({
        "_lr": f"ln(close / {shifted('close')})", "_sma": rolling("avg", "close", 50, first=0),
        "leader_ret_5": change("close", 5)}))
    out = add_ewm(out, {"_fast": ("close", span(12)), "_slow": ("close", span(26))})
    out = out.selectExpr("*", f"(_fast - _slow) / (close + {TINY}) AS _norm")
    out = add_ewm(out, {"_signal": ("_norm", span(9))})
    out = out.selectExpr("*", *named({"_v10": rolling("stddev_samp", "_lr", 10, first=1),
                                      "_v30": rolling("stddev_samp", "_lr", 30, first=1)}))
    return own_rows(out).selectExpr("ts", "leader_ret_5", *named({
        "trend": "CASE WHEN _fast - _slow > 0 THEN 1D ELSE -1D END",
        "trend_strength": "_norm - _signal",
        "above_sma": "CASE WHEN close > _sma THEN 1D ELSE -1D END",
        "leader_vol": f"_v10 * {math.sqrt(BARS_PER_YEAR)!r}D",
        "leader_vol_ratio": f"_v10 / (_v30 + {TINY})"}))


def leader_strength(leader: DataFrame, n: int = 50) -> DataFrame:
    """Bounded distance of the leader's close from its average."""
    laid = slice_bars(leader, back=n).selectExpr("*", f"{rolling('avg', 'close', n, first=0)} AS _sma")
    return own_rows(laid).selectExpr("ts", f"tanh((close / (_sma + {TINY}) - 1.0D) * 10.0D) AS leader_strength")


def align_with_regime(trades: DataFrame, regime: DataFrame) -> DataFrame:
    """Agreement of each trade's side with the leader; unknown regime stays null."""
    joined = trades.join(regime, "ts", "left")
    direction = F.col("side").cast("double")

    def agrees(column: str) -> Column:
        return F.when(F.col(column).isNotNull(),
                      (F.signum(direction) == F.signum(F.col(column))).cast("double"))

    return joined.select(
        "*", agrees("trend").alias("alignment"), agrees("above_sma").alias("alignment_sma"),
        (direction * F.col("trend_strength")).alias("alignment_strength"),
        (direction * F.col("leader_ret_5")).alias("ret_5_aligned"))


def strength_at(trades: DataFrame, strength: DataFrame) -> DataFrame:
    """Latest known leader strength at each trade's timestamp.

    Strength is looked up once per distinct timestamp, then joined back, so
    trades are not shuffled into one global order.
    """
    moments = trades.select("ts").distinct()
    known = attach_asof(moments, strength.filter(F.col("leader_strength").isNotNull()), ["leader_strength"], keys=[])
    return trades.join(known, "ts", "left")


def leader_return_on_bars(bars: DataFrame, regime: DataFrame) -> DataFrame:
    """Leader's five-bar return joined by timestamp and forward filled per asset."""
    joined = bars.join(regime.select("ts", "leader_ret_5"), "ts", "left")
    return forward_fill(joined, ["leader_ret_5"]).select(*bars.columns, "leader_ret_5")
