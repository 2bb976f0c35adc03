"""Cross-sectional long/short books on a sparse (day, asset) panel.

Days are numbered on the shared calendar, so "k days earlier" is arithmetic on
``d`` and no dense grid is built: a value known on day d becomes a feature of
day d+1, a weight held on day d leaves as a negative change on d+1.  Configs
ride along as columns, so a whole sweep is one job.  Rows per asset are bounded
by the calendar, rows per day by the universe.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import compounded
from barloom.operators.bars import calendar
from barloom.operators.economics import attach_facts
from barloom.session import cut_lineage

EPS = 1e-12


def index_days(panel: DataFrame) -> DataFrame:
    """Adds the calendar number ``d`` of each day; written once, as every step reads it."""
    return cut_lineage(panel.join(calendar(panel), "day").filter("close is not null"))


def asset_days(n: int):
    """The ``n`` calendar days ending today, per asset."""
    return Window.partitionBy("asset").orderBy("d").rangeBetween(-(n - 1), 0)


def at_offset(value: Column, days: int) -> Column:
    """Value exactly ``days`` calendar days away (negative: earlier); null when missing."""
    exact = Window.partitionBy("asset").orderBy("d").rangeBetween(days, days)
    return F.max(value).over(exact)


def momentum(indexed: DataFrame, lookback: int | Column, reversal: bool = False) -> DataFrame:
    """Past return known at the previous close: (d, asset, value)."""
    past = F.try_divide(F.col("close"), at_offset(F.col("close"), -lookback)) - 1
    out = indexed.select((F.col("d") + 1).alias("d"), "asset", (-past if reversal else past).alias("value"))
    return out.filter("value is not null")


def factor_grid(indexed: DataFrame, lookbacks: list[int]) -> DataFrame:
    """Momentum and reversal features for several look-backs, tagged by ``config_id``."""
    cells = [F.struct(F.lit(f"{kind}_{k}").alias("config_id"),
                      (sign * (F.try_divide(F.col("close"), at_offset(F.col("close"), -k)) - 1)).alias("value"))
             for kind, sign in (("momentum", 1), ("reversal", -1)) for k in lookbacks]
    wide = indexed.select((F.col("d") + 1).alias("d"), "asset", F.array(*cells).alias("_c"))
    out = wide.select("d", "asset", F.explode("_c").alias("_c")).select("_c.config_id", "d", "asset", "_c.value")
    return out.filter("value is not null")


def realized_vol(indexed: DataFrame, n: int = 20) -> DataFrame:
    """Standard deviation of the last ``n`` daily returns, known the day after."""
    daily = indexed.select("d", "asset", (F.try_divide(F.col("close"), at_offset(F.col("close"), -1)) - 1).alias("_r"))
    w = asset_days(n)
    vol = F.when(F.count("_r").over(w) == n, F.stddev_samp("_r").over(w))
    return daily.select((F.col("d") + 1).alias("d"), "asset", vol.alias("vol")).filter("vol is not null")


def zscore(feature: DataFrame, keys: list[str]) -> DataFrame:
    """Cross-sectional z-score per day."""
    day = Window.partitionBy(*keys)
    z = (F.col("value") - F.avg("value").over(day)) / (F.stddev_samp("value").over(day) + EPS)
    return feature.withColumn("value", z).filter("value is not null")


def composite(indexed: DataFrame, funding: DataFrame | None, lookback: int = 14, carry_weight: float = 0.0) -> DataFrame:
    """Blend of momentum and negative funding, both z-scored; missing carry is 0."""
    base = zscore(momentum(indexed, lookback), ["d"])
    if funding is None or carry_weight <= 0:
        return base
    carry = zscore(funding.select((F.col("d") + 1).alias("d"), "asset", (-F.col("funding")).alias("value")), ["d"])
    joined = base.join(carry.withColumnRenamed("value", "_carry"), ["d", "asset"], "left")
    return joined.select("d", "asset", ((1.0 - carry_weight) * F.col("value")
                                        + carry_weight * F.coalesce("_carry", F.lit(0.0))).alias("value"))


def ranked_legs(feature: DataFrame, per_side: int, keys: list[str]) -> DataFrame:
    """Top and bottom names per day with ``leg`` +1/-1; thin days take no book."""
    day = Window.partitionBy(*keys, "d")
    order = day.orderBy(F.col("value").desc(), "asset")
    ranked = feature.select("*", F.row_number().over(order).alias("_r"), F.count(F.lit(1)).over(day).alias("_n"))
    leg = F.when(F.col("_r") <= per_side, 1).when(F.col("_r") > F.col("_n") - per_side, -1)
    return ranked.filter(F.col("_n") >= 2 * per_side).withColumn("leg", leg).filter("leg is not null").drop("_r", "_n")


def long_short_book(feature: DataFrame, per_side: int, keys: list[str] = []) -> DataFrame:
    """Equal weights +-1/(2M); names outside the book carry no row."""
    legs = ranked_legs(feature, per_side, keys)
    return legs.select(*keys, "d", "asset", (F.col("leg") / F.lit(2.0 * per_side)).alias("w"))


def vol_target_book(feature: DataFrame, per_side: int, vol: DataFrame, keys: list[str] = []) -> DataFrame:
    """Inverse-volatility weights inside each leg, +-0.5 per leg."""
    legs = ranked_legs(feature, per_side, keys).join(vol, ["d", "asset"], "left")
    inverse = F.when(F.col("vol") > 0, 1.0 / (F.col("vol") + 1e-9))
    leg = Window.partitionBy(*keys, "d", "leg")
    sized = legs.withColumn("_i", inverse)
    sized = sized.withColumn("_i", F.coalesce("_i", F.avg("_i").over(leg), F.lit(1.0)))
    return sized.select(*keys, "d", "asset", (F.col("_i") / F.sum("_i").over(leg) * 0.5 * F.col("leg")).alias("w"))


def overlap_rebalance(weights: DataFrame, days: int, keys: list[str] = []) -> DataFrame:
    """Average of ``days`` staggered books: each target weight is held ``days`` days at 1/days."""
    if days <= 1:
        return weights
    held = weights.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return held.groupBy(*keys, (F.col("d") + F.col("_k")).alias("d"), "asset").agg((F.sum("w") / days).alias("w"))


def forward_returns(indexed: DataFrame) -> DataFrame:
    """Return from today's close to the next calendar day's close."""
    return indexed.select("d", "asset", (F.try_divide(at_offset(F.col("close"), 1), F.col("close")) - 1).alias("fwd"))


def backtest_book(indexed: DataFrame, weights: DataFrame, cost_per_side: float | Column,
                  keys: list[str] = [], funding: DataFrame | None = None) -> DataFrame:
    """Gross, turnover, cost and net per (config, day), the last day left out.

    Turnover sums absolute weight changes; an exit shows up as the negative of
    yesterday's weight.
    """
    cost_per_side = cost_per_side if isinstance(cost_per_side, Column) else F.lit(float(cost_per_side))
    weights = cut_lineage(weights)
    cost_keys = [c for c in ("cost",) if c in weights.columns and c not in keys]
    days = calendar(indexed.select("day"))
    last = days.agg(F.max("d").alias("_last"))
    changes = weights.select(*keys, *cost_keys, "asset", F.explode(F.array(
        F.struct(F.col("d").alias("d"), F.col("w").alias("dw")),
        F.struct((F.col("d") + 1).alias("d"), (-F.col("w")).alias("dw")))).alias("_c"))
    moved = changes.groupBy(*keys, *cost_keys, "asset", F.col("_c.d").alias("d")).agg(F.sum("_c.dw").alias("dw"))
    turnover = moved.groupBy(*keys, *cost_keys, "d").agg(F.sum(F.abs("dw")).alias("turnover"))
    earned = weights.join(forward_returns(indexed), ["d", "asset"], "left")
    pnl = F.sum(F.col("w") * F.col("fwd"))
    if funding is not None:
        earned = earned.join(funding.select("d", "asset", "funding"), ["d", "asset"], "left")
        gross = earned.groupBy(*keys, "d").agg(
            F.coalesce(pnl, F.lit(0.0)).alias("gross"),
            (-F.coalesce(F.sum(F.col("w") * F.col("funding")), F.lit(0.0))).alias("funding"))
    else:
        gross = earned.groupBy(*keys, "d").agg(F.coalesce(pnl, F.lit(0.0)).alias("gross"))
    # Every calendar day of every config has a row, traded or not.
    slots = (weights.select(*keys, *cost_keys).distinct() if keys or cost_keys else last.select(F.lit(1).alias("_x")))
    last_day = days.agg(F.max("d")).scalar()
    slots = slots.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), last_day - 1))).join(days, "d")
    out = slots.join(gross, [*keys, "d"], "left").join(turnover, [*keys, *cost_keys, "d"], "left")
    paid = F.coalesce("turnover", F.lit(0.0)) * cost_per_side
    net = F.coalesce("gross", F.lit(0.0)) - paid
    cols = [F.coalesce("gross", F.lit(0.0)).alias("gross"), paid.alias("cost_paid"),
            F.coalesce("turnover", F.lit(0.0)).alias("turnover")]
    if funding is not None:
        cols.append(F.coalesce("funding", F.lit(0.0)).alias("funding"))
        net = net + F.coalesce("funding", F.lit(0.0))
    return out.select(*keys, "day", "d", *cols, net.alias("net"))


def config_days(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("d") if keys else Window.partitionBy(F.lit(0)).orderBy("d")


def volatility_scale(pnl: DataFrame, keys: list[str] = [], target: float = 0.20, lookback: int = 30,
                     cap: float = 3.0, extra: float = 1.0, periods: int = 365) -> DataFrame:
    """Lever each row to a constant target volatility a year of ``periods`` rows, from the trailing returns."""
    w = config_days(keys).rowsBetween(-lookback, -1)
    vol = F.when(F.count("net").over(w) == lookback, F.stddev_samp("net").over(w))
    lev = F.coalesce(F.least(F.lit(target / math.sqrt(periods)) / (vol + 1e-9), F.lit(cap)), F.lit(1.0)) * extra
    return pnl.withColumn("leverage", lev).withColumn("scaled", F.col("net") * F.col("leverage"))


def equity_stats(pnl: DataFrame, keys: list[str], ret: str = "net", periods: int = 365) -> DataFrame:
    """Summary of a return series (``periods`` rows a year) per config; the peak starts at the first point."""
    run = config_days(keys).rowsBetween(Window.unboundedPreceding, 0)
    curve = pnl.withColumn("_curve", F.product(1 + F.col(ret)).over(run))
    curve = curve.withColumn("_peak", F.max("_curve").over(run))
    curve = curve.withColumn("_dd", (F.col("_curve") - F.col("_peak")) / F.col("_peak"))
    r, mean, vol = F.col(ret), F.avg(ret), F.stddev_samp(ret)
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), compounded(r).alias("total_return"),
        (F.pow(1 + mean, F.lit(periods)) - 1).alias("ann_return"),
        F.when(vol > 0, mean / vol * math.sqrt(periods)).alias("sharpe"), mean.alias("daily_mean"),
        vol.alias("daily_vol"), F.min("_dd").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"))


def half_split(pnl: DataFrame, keys: list[str]) -> DataFrame:
    """Each day once in FULL and once in its half (H1, H2)."""
    counted = pnl.select("*", F.row_number().over(config_days(keys)).alias("_r"),
                         F.count(F.lit(1)).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).alias("_n"))
    half = F.when(F.col("_r") <= F.floor(F.col("_n") / 2), "H1").otherwise("H2")
    return counted.withColumn("segment", F.explode(F.array(F.lit("FULL"), half))).drop("_r", "_n")


def calendar_year_returns(pnl: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    return pnl.groupBy(*keys, F.year("day").alias("year")).agg(compounded(F.col(ret)).alias("year_return"))


def latest_book(weights: DataFrame, days: DataFrame) -> DataFrame:
    """Long and short names of the newest calendar day; null lists when it has no book."""
    last = days.agg(F.max_by("day", "d").alias("day"), F.max("d").alias("d"))
    now = F.broadcast(last).join(weights, "d", "left")
    names = lambda cond: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("asset")))), ","), F.lit(""))
    return now.groupBy("day").agg(names(F.col("w") > 0).alias("longs"), names(F.col("w") < 0).alias("shorts"))


def best_config(stats: DataFrame, by: list[str] = []) -> DataFrame:
    """Config with the highest Sharpe ratio, config name on ties."""
    order = F.struct(F.coalesce("sharpe", F.lit(-9.0)).alias("s"), F.col("config_id"))
    return stats.groupBy(*by).agg(F.max(order).alias("_b")).select(
        *by, F.col("_b.config_id").alias("config_id"), F.col("_b.s").alias("sharpe"))


def rotation(scored: DataFrame, top_k: int, every: int, cost: float, long_short: bool = False) -> DataFrame:
    """Hold the ``top_k`` best scores between checkpoints on the common timeline.

    ``scored`` carries (ts, asset, close, score).  Only timestamps on which
    every asset has a score count; every ``every``-th of them is a checkpoint.
    """
    universe = scored.agg(F.count_distinct("asset").alias("_all"))
    shared = scored.groupBy("ts").agg(F.count_distinct("asset").alias("_k"))
    common = attach_facts(shared, universe, []).filter("_k = _all").select(F.col("ts").alias("day"))
    marks = calendar(common).filter(F.col("d") % every == 0).select(F.col("day").alias("ts"), (F.col("d") / every).cast("long").alias("c"))
    marks = cut_lineage(marks)
    at = scored.join(marks, "ts")
    nxt = at.select("asset", (F.col("c") - 1).alias("c"), F.col("close").alias("_next"))
    moves = at.join(nxt, ["asset", "c"]).withColumn("_r", F.col("_next") / F.col("close") - 1)
    day = Window.partitionBy("c")
    best = F.row_number().over(day.orderBy(F.col("score").desc(), "asset"))
    worst = F.row_number().over(day.orderBy(F.col("score"), F.col("asset").desc()))
    picked = moves.select("*", best.alias("_b"), worst.alias("_w"))
    longs = F.avg(F.when(F.col("_b") <= top_k, F.col("_r") - cost))
    shorts = F.avg(F.when(F.col("_w") <= top_k, -F.col("_r") - cost))
    held = 0.5 * longs + 0.5 * shorts if long_short else longs
    return picked.groupBy("ts", "c").agg(held.alias("period_ret"), F.avg(F.col("_r") - cost).alias("equal_weight_ret"))


def rotation_summary(periods: DataFrame, every: int) -> DataFrame:
    """Totals of a rotation; the annual factor assumes four-hour bars."""
    r = F.col("period_ret")
    return periods.agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg((r > 0).cast("double")).alias("win_rate"),
        compounded(r).alias("total_return"),
        (F.avg(r) / (F.stddev_samp(r) + 1e-9) * math.sqrt(365 / (every * 4 / 24))).alias("sharpe"),
        compounded(F.col("equal_weight_ret")).alias("equal_weight_total"))
