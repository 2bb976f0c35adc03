"""Technical features: one pass over sliced bars.

All look-backs share one shuffle on ``(asset, slice)``; only on-balance volume
needs a second, small pass to carry its running total across slices.  Features
are SQL text, and unused ones are pruned by the optimizer.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import (
    BLOCK_ROWS, FRAME, SLICE_BLOCKS, add_ewm, change, own_rows, rolling, shifted, slice_bars)

# Guards and window lengths that decide the low digits.
TINY = "1e-9D"
DAYS_PER_YEAR = 365
WARMUP_BARS = 69
PRICE_WARMUP_BARS = 49
LATE_COLUMNS = {"funding_rate": 4, "obi": 4, "leader_ret_5": 0}
SLICE_ROWS = BLOCK_ROWS * SLICE_BLOCKS

PRICE_FEATURES = [
    "ret_1d", "ret_2d", "ret_3d", "ret_5d",
    "MACD_12_26_9", "MACDs_12_26_9", "MACDh_12_26_9", "RSI_14", "RSI_70",
    "ATR_14", "bb_width", "bb_pct", "bb_position", "sma_dist", "ATR_50", "ATR_ratio",
    "realized_vol_10", "realized_vol_30", "vol_regime", "close_to_sma20", "close_to_sma50",
    "roc_10", "roc_20",
]
VOLUME_FEATURES = ["vol_change_1d", "vol_change_3d", "vol_sma_20", "vol_ratio",
                   "OBV_sma_20", "OBV_dist", "OBV_sma_70", "OBV_trend"]
FUNDING_FEATURES = ["funding_rate_diff", "funding_sma_5"]
BOOK_FEATURES = ["obi_raw", "obi_imbalance", "obi_diff", "obi_sma_5"]
CLOCK_FEATURES = ["dow", "hour", "garman_klass_vol"]


def span(n: int) -> float:
    return 2.0 / (n + 1)


def centre_of_mass(n: int) -> float:
    return 1.0 / (1 + n)


TRUE_RANGE = (f"greatest(high - low, abs(high - {shifted('close')}), abs(low - {shifted('close')}))")


def named(expressions: dict[str, str]) -> list[str]:
    return [f"{text} AS `{name}`" for name, text in expressions.items()]


def add_on_balance_volume(laid: DataFrame) -> DataFrame:
    """Running signed volume over the whole history.

    Per-slice totals are carried forward; inside a slice the copied-in rows
    are subtracted so that they too show their true running total.
    """
    moved = laid.selectExpr("*", f"coalesce(signum(close - {shifted('close')}) * volume, 0D) AS _sv")
    totals = moved.filter("own").groupBy("asset", "slice").agg(F.sum("_sv").alias("_total"))
    earlier = Window.partitionBy("asset").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select("asset", "slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_open"))
    local = moved.selectExpr(
        *[f"`{c}`" for c in laid.columns],
        f"sum(_sv) OVER ({FRAME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        " - coalesce(sum(CASE WHEN NOT own THEN _sv END) OVER (PARTITION BY asset, slice), 0D) AS _obv")
    return local.join(opening, ["asset", "slice"], "left").selectExpr(
        *[f"`{c}`" for c in laid.columns], "_obv + coalesce(_open, 0D) AS obv")


def add_price_features(laid: DataFrame) -> DataFrame:
    base = laid.selectExpr("*", *named({
        "tr": TRUE_RANGE,
        "log_ret": f"ln(close / {shifted('close')})",
        "up": f"CASE WHEN {shifted('close')} IS NOT NULL THEN greatest(close - {shifted('close')}, 0D) END",
        "down": f"CASE WHEN {shifted('close')} IS NOT NULL THEN -least(close - {shifted('close')}, 0D) END",
        "_sma10": rolling("avg", "close", 10, first=0), "_sma20": rolling("avg", "close", 20, first=0),
        "_sma50": rolling("avg", "close", 50, first=0), "_std20": rolling("stddev_samp", "close", 20, first=0),
        **{f"ret_{k}d": change("close", k) for k in (1, 2, 3, 5)},
        **{f"roc_{k}": change("close", k) for k in (10, 20)}}))
    base = add_ewm(base, {
        "ema_12": ("close", span(12)), "ema_26": ("close", span(26)),
        "_up14": ("up", centre_of_mass(13)), "_down14": ("down", centre_of_mass(13)),
        "_up70": ("up", centre_of_mass(69)), "_down70": ("down", centre_of_mass(69))})
    base = base.selectExpr("*", f"(ema_12 - ema_26) / (close + {TINY}) AS MACD_12_26_9")
    base = add_ewm(base, {"MACDs_12_26_9": ("MACD_12_26_9", span(9))})
    upper, lower = "(_sma20 + _std20 * 2)", "(_sma20 - _std20 * 2)"
    year = f"{math.sqrt(DAYS_PER_YEAR)!r}D"
    wide = base.selectExpr("*", *named({
        "MACDh_12_26_9": "MACD_12_26_9 - MACDs_12_26_9",
        "RSI_14": f"100 - (100 / (1 + _up14 / (_down14 + {TINY})))",
        "RSI_70": f"100 - (100 / (1 + _up70 / (_down70 + {TINY})))",
        "ATR_14": f"{rolling('avg', 'tr', 14, first=0)} / (close + {TINY})",
        "ATR_50": f"{rolling('avg', 'tr', 50, first=0)} / (close + {TINY})",
        "bb_width": f"({upper} - {lower}) / (_sma20 + {TINY})",
        "bb_pct": f"(close - {lower}) / ({upper} - {lower} + {TINY})",
        "bb_position": f"(close - _sma20) / (_std20 * 2 + {TINY})",
        "sma_dist": "try_divide(_sma10, _sma50) - 1",
        "close_to_sma20": f"close / (_sma20 + {TINY}) - 1",
        "close_to_sma50": f"close / (_sma50 + {TINY}) - 1",
        "realized_vol_10": f"{rolling('stddev_samp', 'log_ret', 10, first=1)} * {year}",
        "realized_vol_30": f"{rolling('stddev_samp', 'log_ret', 30, first=1)} * {year}"}))
    kept = [c for c in PRICE_FEATURES if c not in ("ATR_ratio", "vol_regime")]
    return wide.selectExpr(*[f"`{c}`" for c in laid.columns + kept], *named({
        "ATR_ratio": f"ATR_14 / (ATR_50 + {TINY})",
        "vol_regime": f"realized_vol_10 / (realized_vol_30 + {TINY})",
        "atr": "ATR_14 * close"}))


def add_balance_features(laid: DataFrame) -> DataFrame:
    out = add_on_balance_volume(laid).selectExpr("*", *named({
        "OBV_sma_20": rolling("avg", "obv", 20, first=0), "OBV_sma_70": rolling("avg", "obv", 70, first=0)}))
    return out.selectExpr("*", *named({
        f"OBV_{name}": f"(obv - {average}) / (CASE WHEN {average} = 0 THEN {TINY} ELSE {average} END)"
        for name, average in (("dist", "OBV_sma_20"), ("trend", "OBV_sma_70"))}))


def other_features(columns: list[str]) -> dict[str, str]:
    """Volume, clock, funding and book blocks; a block needs its columns."""
    out = {
        "dow": "weekday(ts)", "hour": "hour(ts)",
        "garman_klass_vol": "sqrt(0.5D * ln(high / low) * ln(high / low)"
                            f" - {2 * math.log(2) - 1!r}D * ln(close / open) * ln(close / open))"}
    if "volume" in columns:
        out["vol_change_1d"], out["vol_change_3d"] = change("volume", 1), change("volume", 3)
        out["vol_sma_20"] = rolling("avg", "volume", 20, first=0)
        out["vol_ratio"] = f"volume / ({rolling('avg', 'volume', 20, first=0)} + {TINY})"
    if "funding_rate" in columns:
        out["funding_rate_diff"] = f"funding_rate - {shifted('funding_rate')}"
        out["funding_sma_5"] = rolling("avg", "funding_rate", 5)
    if "obi" in columns:
        out["obi_raw"], out["obi_imbalance"] = "obi", "obi - 0.5D"
        out["obi_diff"], out["obi_sma_5"] = f"obi - {shifted('obi')}", rolling("avg", "obi", 5)
    return out


def feature_frame(bars: DataFrame, slice_rows: int = SLICE_ROWS, balance: bool = True) -> DataFrame:
    """All features on sliced bars, border copies included.

    Everything but on-balance volume is pruned by the optimizer when unused;
    that one needs a join, so callers that do not read it pass ``balance=False``.

    ``bar`` is the position on the trimmed frame: the first bar on which every
    feature is known is 0 and warm-up bars are negative.  Signals use it so
    that their own look-backs restart after the warm-up.
    """
    laid = slice_bars(bars, back=BLOCK_ROWS, slice_rows=slice_rows)
    out = add_price_features(laid)
    if balance and "volume" in bars.columns:
        out = add_balance_features(out)
    out = out.selectExpr("*", *named(other_features(bars.columns)))
    return trimmed(out, bars)


def trimmed(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``bar``: the position counted from the asset's first usable bar.

    A late-starting optional column pushes that bar back. One row per asset decides
    it, so no position is counted again; features and paths share this rule.
    """
    warmup = WARMUP_BARS if "volume" in bars.columns else PRICE_WARMUP_BARS
    late = {c: n for c, n in LATE_COLUMNS.items() if c in bars.columns}
    if not late:
        return rows.withColumn("bar", F.col("pos") - warmup)
    starts = bars.groupBy("asset").agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_s_{c}") for c in late])
    warm = starts.select("asset", F.greatest(
        F.lit(warmup), *[F.col(f"_s_{c}") + n for c, n in late.items()]).alias("_warm"))
    return rows.join(warm, "asset", "left").withColumn("bar", F.col("pos") - F.col("_warm")).drop("_warm")


def features(bars: DataFrame, slice_rows: int = SLICE_ROWS, balance: bool = True) -> DataFrame:
    """Feature table: one row per usable bar, positions restarted at 0."""
    return own_rows(feature_frame(bars, slice_rows, balance).filter("bar >= 0"))


def usable_path(bars: DataFrame) -> DataFrame:
    """High, low and close by trimmed position, straight from numbered bars."""
    return trimmed(bars, bars).select("asset", "bar", "high", "low", "close").filter("bar >= 0")


def average_directional_index(bars: DataFrame, threshold: float = 25.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Wilder's ADX with the regime flag and the lagged value used for blending."""
    laid = slice_bars(bars, back=BLOCK_ROWS, slice_rows=slice_rows)
    moves = laid.selectExpr("*", *named({
        "tr": TRUE_RANGE, "_up": f"high - {shifted('high')}", "_down": f"{shifted('low')} - low"}))
    moves = moves.selectExpr("*", *named({
        "_pdm": "CASE WHEN _up > _down AND _up > 0 THEN _up ELSE 0D END",
        "_mdm": "CASE WHEN _down > _up AND _down > 0 THEN _down ELSE 0D END"}))
    wilder = 1.0 / 14
    smooth = add_ewm(moves, {"_atr": ("tr", wilder), "_p": ("_pdm", wilder), "_m": ("_mdm", wilder)})
    # A flat start has no range at all; its index is unknown until prices move.
    smooth = smooth.selectExpr("*", "100 * try_divide(_p, _atr) AS plus_di", "100 * try_divide(_m, _atr) AS minus_di")
    smooth = smooth.selectExpr("*", f"100 * abs(plus_di - minus_di) / (plus_di + minus_di + {TINY}) AS dx")
    out = add_ewm(smooth, {"adx": ("dx", wilder)})
    return own_rows(out.selectExpr(
        *bars.columns, "slice", "own", "plus_di", "minus_di", "adx",
        f"CASE WHEN adx > {threshold} THEN 1 ELSE 0 END AS trending", f"coalesce({shifted('adx')}, 0D) AS adx_prior"))


def bar_scale(hours: float, base: float = 0.005) -> float:
    """Direction threshold scaled to the bar width."""
    return base * math.sqrt(hours / 24.0) * 2.5


def direction_target(frame: DataFrame, threshold: float) -> DataFrame:
    """1 when the next bar's return clears the threshold, 0 when it clears it downwards."""
    ahead = slice_bars(frame, back=0, ahead=1).selectExpr("*", f"lead(ret_1d) OVER ({FRAME}) AS _next")
    out = ahead.selectExpr("*", f"CASE WHEN _next > {threshold!r}D THEN 1 WHEN _next < {-threshold!r}D THEN 0 END AS target")
    return own_rows(out).drop("_next").filter("target IS NOT NULL")


def quote_volatility(bars: DataFrame, n: int = 60) -> DataFrame:
    """Mean high-low range over ``n`` bars, the quoting width proxy."""
    laid = slice_bars(bars, back=n)
    return own_rows(laid.selectExpr("*", f"{rolling('avg', '(high - low)', n, first=0)} AS range_vol"))
