"""End-to-end studies: each is one composition of the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import economics as ec
from barloom.operators import features as ft
from barloom.operators import gating as g
from barloom.operators import labels as lb
from barloom.operators import regime as rg
from barloom.operators import signals as sg
from barloom.session import cut_lineage

TRADE_KEYS = ["asset", "signal", "bar"]
MODEL_FEATURES = ["ret_2d", "ret_3d", "ret_5d", "MACD_12_26_9", "MACDh_12_26_9", "RSI_14", "RSI_70", "bb_width",
                  "bb_position", "sma_dist", "ATR_ratio", "vol_regime", "roc_10", "roc_20", "vol_ratio", "dow"]
REGIME_FEATURES = ["trend", "trend_strength", "above_sma", "leader_ret_5", "alignment", "alignment_strength"]


def labelled_candidates(bars: DataFrame, rules: list[str], pt: float, sl: float, horizon: int = 18,
                        keep: list[str] = []) -> DataFrame:
    """Numbered bars -> features -> fired rules -> triple-barrier labels, all assets and rules in one job."""
    frame = ft.feature_frame(bars, balance="obv_divergence" in rules)
    sides = sg.signal_sides(frame, {r: sg.RULES[r]() for r in rules})
    fired = sg.candidates(sides, rules).select("asset", "ts", "signal", "bar", "side", "close", "atr", *keep)
    trades = lb.triple_barrier(fired, ft.usable_path(bars), TRADE_KEYS, pt, sl, horizon)
    return trades.withColumn("trade_id", F.concat_ws("_", "asset", "signal", F.col("bar").cast("string")))


def meta_label_dataset(bars: DataFrame, leader: str, rules: list[str], pt: float = 2.0, sl: float = 2.0,
                       horizon: int = 18) -> DataFrame:
    """Labelled candidates with entry features and leader alignment."""
    trades = labelled_candidates(bars, rules, pt, sl, horizon, keep=MODEL_FEATURES)
    return rg.align_with_regime(trades, rg.leader_regime(rg.leader_bars(bars.drop("leader_ret_5"), leader)))


def rule_study(bars: DataFrame, rules: list[str], taker: float = 0.004, maker: float = 0.0008) -> DataFrame:
    """Instant against limit fills of any registered rules: economics per rule and execution style.

    The bars carry what the rules read (funding, book imbalance, leader returns).
    """
    frame = ft.feature_frame(bars, balance="obv_divergence" in rules)
    sides = sg.signal_sides(frame, {r: sg.RULES[r]() for r in rules})
    fired = cut_lineage(sg.candidates(sides, rules).select("asset", "ts", "signal", "bar", "side", "close", "atr"))
    path = ft.usable_path(bars)
    instant = lb.triple_barrier(fired, path, TRADE_KEYS, 2.0, 1.0)
    filled = lb.triple_barrier_from_fill(lb.limit_fills(fired, path, TRADE_KEYS), path, TRADE_KEYS)
    cols = ["signal", "label", "ret"]
    both = (instant.select(F.lit("taker").alias("execution"), F.lit(taker).alias("cost"), *cols)
            .unionByName(filled.select(F.lit("maker").alias("execution"), F.lit(maker).alias("cost"), *cols)))
    return ec.net_economics(both, ["signal", "execution"], F.col("cost"))


def maker_study(bars: DataFrame, rule: str, taker: float = 0.004, maker: float = 0.0008) -> DataFrame:
    """``rule_study`` of one rule."""
    return rule_study(bars, [rule], taker, maker).drop("signal")


def daily_digest(scored: DataFrame, per_day: int, costs: dict[str, float]) -> DataFrame:
    """Economics of the day's best signals and of the frequency-matched threshold."""
    pool = cut_lineage(scored)
    cut = g.threshold_for_frequency(pool, float(per_day)).select("threshold")
    top = g.top_n_per_day(pool, per_day).withColumn("selection", F.lit("top_per_day"))
    above = ec.attach_facts(pool, cut, []).filter("score >= threshold").drop("threshold").withColumn("selection", F.lit("threshold"))
    costed = ec.per_cost(top.unionByName(above), costs)
    return ec.net_economics(costed, ["selection", "cost_name"], F.col("cost"))
