"""Rule-based entry signals: one column of -1/0/+1 per rule.

Rules are SQL text over the columns of ``feature_frame`` and fire only on the
crossing bar.  ``bar`` (the trimmed position) guards every look-back, so a rule
cannot see warm-up bars.  When both branches could fire the later assignment of
the rule wins, hence the order of the branches.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import (
    back_rows, own_rows, quantile_of_sorted, rolling_rank, seen_values, shifted, sorted_window)

# Rule name -> family, which decides the sign of the ranking terms.
FAMILY = {
    "breakout": "trend",
    "vol_breakout": "trend",
    "trend_pullback": "trend",
    "reversion": "reversion",
    "range_fade": "reversion",
}
RANK_BARS = 100


def side(first: str, first_side: int, second: str) -> str:
    """Side whose ``first`` branch wins; unknown comparisons do not fire."""
    return f"CASE WHEN {first} THEN {first_side} WHEN {second} THEN {-first_side} ELSE 0 END"


def known(n: int, value: str) -> str:
    """``value`` once ``n`` trimmed bars precede the current one."""
    return f"CASE WHEN bar >= {n} THEN {value} END"


def prior(value: str) -> str:
    return f"({known(1, shifted(value))})"


def prior_high(value: str, n: int) -> str:
    return f"({known(n, f'max({value}) OVER {back_rows(n, 1)}')})"


def prior_low(value: str, n: int) -> str:
    return f"({known(n, f'min({value}) OVER {back_rows(n, 1)}')})"


def breakout(lookback: int = 20) -> str:
    return side(f"close < {prior_low('low', lookback)}", -1, f"close > {prior_high('high', lookback)}")


def reversion(oversold: float = 30, overbought: float = 70) -> str:
    before = prior("RSI_14")
    return side(f"{before} > {overbought} AND RSI_14 <= {overbought}", -1,
                f"{before} < {oversold} AND RSI_14 >= {oversold}")


def vol_breakout(lookback: int = 20, squeeze: float = 0.35) -> str:
    """Breakout out of a narrow band, read from the lagged width rank."""
    quiet = f"bb_width_rank <= {squeeze}D"
    return side(f"close < {prior_low('low', lookback)} AND {quiet}", -1,
                f"close > {prior_high('high', lookback)} AND {quiet}")


def trend_pullback() -> str:
    before = prior("RSI_14")
    return side(f"close_to_sma20 < 0 AND close_to_sma50 < 0 AND {before} > 55 AND RSI_14 <= 55", -1,
                f"close_to_sma20 > 0 AND close_to_sma50 > 0 AND {before} < 45 AND RSI_14 >= 45")


def range_fade(band: float = 0.9, ratio_cap: float = 1.05) -> str:
    before, calm = prior("bb_position"), f"ATR_ratio < {ratio_cap}D"
    return side(f"{before} >= {band}D AND bb_position < {band}D AND {calm}", -1,
                f"{before} <= -{band}D AND bb_position > -{band}D AND {calm}")


def extreme_cross(source: str, lookback: int, quantile: float) -> tuple[str, str]:
    """Crossings of the prior rolling quantile band, upwards and downwards."""
    values = f"({known(lookback, f'_sorted_{source}')})"
    upper = quantile_of_sorted(values, lookback, quantile)
    lower = quantile_of_sorted(values, lookback, 1 - quantile)
    before = prior(source)
    return f"{before} <= {upper} AND {source} > {upper}", f"{before} >= {lower} AND {source} < {lower}"


def obi_momentum(lookback: int = 288, quantile: float = 0.9) -> str:
    up, down = extreme_cross("obi", lookback, quantile)
    return side(down, -1, up)


def funding_reversion(lookback: int = 90, quantile: float = 0.9) -> str:
    up, down = extreme_cross("funding_rate", lookback, quantile)
    return side(down, 1, up)


def funding_reversion_confirmed(lookback: int = 90, quantile: float = 0.9, stretch: float = 0.5) -> str:
    base = f"({funding_reversion(lookback, quantile)})"
    return side(f"{base} = 1 AND bb_position < -{stretch}D", 1, f"{base} = -1 AND bb_position > {stretch}D")


def funding_reversion_regime_filtered(lookback: int = 90, quantile: float = 0.9, ratio_cap: float = 1.05) -> str:
    return f"CASE WHEN ATR_ratio < {ratio_cap}D THEN {funding_reversion(lookback, quantile)} ELSE 0 END"


def obv_divergence(lookback: int = 20) -> str:
    """Fade a price extreme that running volume does not confirm."""
    low = f"close < {prior_low('close', lookback)} AND NOT coalesce(obv < {prior_low('obv', lookback)}, false)"
    high = f"close > {prior_high('close', lookback)} AND NOT coalesce(obv > {prior_high('obv', lookback)}, false)"
    return side(low, 1, high)


def btc_lead_lag(threshold: float = 0.03) -> str:
    """The leader's own return crosses the threshold; traded on another asset."""
    before = prior("leader_ret_5")
    return side(f"{before} >= -{threshold}D AND leader_ret_5 < -{threshold}D", -1,
                f"{before} <= {threshold}D AND leader_ret_5 > {threshold}D")


RULES: dict[str, Callable[[], str]] = {
    "breakout": breakout,
    "reversion": reversion,
    "vol_breakout": vol_breakout,
    "trend_pullback": trend_pullback,
    "range_fade": range_fade,
    "obi_momentum": obi_momentum,
    "funding_reversion": funding_reversion,
    "funding_reversion_confirmed": funding_reversion_confirmed,
    "funding_reversion_regime_filtered": funding_reversion_regime_filtered,
    "obv_divergence": obv_divergence,
    "btc_lead_lag": btc_lead_lag,
}


#: Sorted look-backs that rules of these names read, at their defaults.
QUANTILE_WINDOWS: dict[str, dict[str, int]] = {
    "obi_momentum": {"obi": 288},
    "funding_reversion": {"funding_rate": 90},
    "funding_reversion_confirmed": {"funding_rate": 90},
    "funding_reversion_regime_filtered": {"funding_rate": 90},
}


def with_helpers(frame: DataFrame, quantile_windows: dict[str, int] | None = None) -> DataFrame:
    """Columns several rules share: the lagged width rank and sorted look-backs."""
    out = frame.selectExpr("*", f"{seen_values('bb_width', RANK_BARS)} AS _seen", *[
        f"{sorted_window(source, n, 1)} AS _sorted_{source}" for source, n in (quantile_windows or {}).items()])
    ranked = known(RANK_BARS - 1, rolling_rank("bb_width", RANK_BARS))
    out = out.selectExpr("*", f"{ranked} AS _rank").drop("_seen")
    return out.selectExpr("*", f"{shifted('_rank')} AS bb_width_rank").drop("_rank")


def signal_sides(frame: DataFrame, rules: dict[str, str],
                 quantile_windows: dict[str, int] | None = None) -> DataFrame:
    """Trimmed bars with one side column per rule, all rules in one pass.

    Look-backs other than a rule's default are named in ``quantile_windows`` (column -> rows).
    """
    needed = {c: n for name in rules for c, n in QUANTILE_WINDOWS.get(name, {}).items()}
    out = with_helpers(frame, needed | (quantile_windows or {}))
    out = out.selectExpr("*", *[f"{rule} AS side_{name}" for name, rule in rules.items()])
    drop = [c for c in out.columns if c.startswith("_sorted_")]
    return own_rows(out.filter("bar >= 0")).drop(*drop)


def candidates(sides: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row per fired (bar, rule): adds ``signal`` and ``side``."""
    pairs = ", ".join(f"named_struct('signal', '{n}', 'side', side_{n})" for n in names)
    fired = F.expr(f"explode(filter(array({pairs}), s -> s.side <> 0))")
    keep = [c for c in sides.columns if not c.startswith("side_")]
    return sides.withColumn("_s", fired).select(*keep, "_s.signal", "_s.side")
