"""First-touch labelling and limit-order fills.

A bounded look-ahead becomes an equi-join: every order emits its next ``H``
positions and meets the bars on ``(asset, bar)``.  The key is as fine as one
bar, so no asset is ever handled by a single task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import own_rows, shifted, slice_bars
from barloom.session import cut_lineage


def bar_path(bars: DataFrame) -> DataFrame:
    """The columns a forward walk reads."""
    return bars.select("asset", "bar", "high", "low", "close")


def walk_forward_bars(orders: DataFrame, bars: DataFrame, start: str, horizon: int) -> DataFrame:
    """Each order joined to its bars ``start+1 .. start+horizon`` that exist."""
    steps = orders.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("_at", F.col(start) + F.col("k"))
    path = bar_path(bars).select(F.col("asset").alias("_asset"), F.col("bar").alias("_at_bar"),
                                 F.col("high").alias("_high"), F.col("low").alias("_low"),
                                 F.col("close").alias("_close"))
    return steps.join(path, (steps.asset == path["_asset"]) & (steps["_at"] == path["_at_bar"]))


def first_touch(orders: DataFrame, bars: DataFrame, keys: list[str], horizon: int, pt: Column, sl: Column) -> DataFrame:
    """Resolve orders against profit, stop and time barriers.

    ``orders`` carries ``keys``, asset, ``anchor`` (start position), ``side``,
    ``price`` (entry price) and ``risk`` (ATR at the signal).  Both barriers in
    one bar count as the stop.  Returns label, ret, hold, entry_pos, exit_pos.
    Orders are read twice (walk and result), so they are written once first:
    they are few compared with the bars behind them.
    """
    orders = cut_lineage(orders)
    long = F.col("side") > 0
    win_dist, loss_dist = pt * F.col("risk"), sl * F.col("risk")
    set_up = orders.withColumn("upper", F.col("price") + F.when(long, win_dist).otherwise(loss_dist))
    set_up = set_up.withColumn("lower", F.col("price") - F.when(long, loss_dist).otherwise(win_dist))
    walked = walk_forward_bars(set_up.select(*keys, *[c for c in ("asset",) if c not in keys],
                                             "anchor", "upper", "lower"), bars, "anchor", horizon)
    up, down = F.col("_high") >= F.col("upper"), F.col("_low") <= F.col("lower")
    touched = F.when(up | down, F.col("k"))
    outcome = walked.groupBy(*keys).agg(
        F.min(touched).alias("_hit"),
        F.min_by(up, touched).alias("_up"), F.min_by(down, touched).alias("_down"),
        F.max("k").alias("_last"), F.max_by("_close", "k").alias("_last_close"))
    out = set_up.join(outcome, keys, "left")
    stop_first = F.when(long, F.col("_down")).otherwise(F.col("_up"))
    exit_price = (F.when(F.col("_hit").isNull(), F.coalesce(F.col("_last_close"), F.col("price")))
                  .when(F.col("_up") & F.col("_down"), F.when(long, F.col("lower")).otherwise(F.col("upper")))
                  .when(F.col("_up"), F.col("upper")).otherwise(F.col("lower")))
    hold = F.coalesce(F.col("_hit"), F.col("_last"), F.lit(0))
    out = out.withColumn("_exit", exit_price)
    ret = F.col("side") * (F.col("_exit") / F.col("price") - 1)
    label = (F.when(F.col("_hit").isNull(), (ret > 0).cast("int"))
             .otherwise((~stop_first).cast("int")))
    kept = [c for c in orders.columns if c not in ("anchor", "price", "risk")]
    return out.select(*kept, label.alias("label"), ret.alias("ret"), hold.cast("int").alias("hold"),
                      F.col("anchor").alias("entry_pos"), (F.col("anchor") + hold).alias("exit_pos"))


def triple_barrier(candidates: DataFrame, bars: DataFrame, keys: list[str], pt: float | Column = 1.5,
                   sl: float | Column = 1.0, horizon: int = 18) -> DataFrame:
    """Label candidates entered at the signal bar's close.

    ``pt`` and ``sl`` may be columns of ``candidates``, so a whole geometry
    grid is labelled in one job.
    """
    orders = candidates.filter(F.col("atr").isNotNull()).select(
        "*", F.col("bar").alias("anchor"), F.col("close").alias("price"), F.col("atr").alias("risk"))
    return first_touch(orders, bars, keys, horizon, _as_column(pt), _as_column(sl))


def _as_column(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def limit_fills(candidates: DataFrame, bars: DataFrame, keys: list[str], offset: float = 0.15,
                timeout: int = 3) -> DataFrame:
    """Rest a limit ``offset`` ATRs better than the close for ``timeout`` bars."""
    orders = candidates.filter(F.col("atr").isNotNull()).select(
        "*", F.col("bar").alias("signal_pos"), F.col("close").alias("signal_price"),
        (F.col("close") - F.col("side") * (F.lit(offset) * F.col("atr"))).alias("limit_price"))
    orders = cut_lineage(orders)
    walked = walk_forward_bars(
        orders.select(*keys, *[c for c in ("asset", "side") if c not in keys], "signal_pos", "limit_price"),
        bars, "signal_pos", timeout)
    touch = F.when(F.col("side") > 0, F.col("_low") <= F.col("limit_price")).otherwise(
        F.col("_high") >= F.col("limit_price"))
    waits = walked.filter(touch).groupBy(*keys).agg(F.min("k").alias("wait_bars"))
    out = orders.join(waits, keys, "left")
    return out.withColumn("filled", F.col("wait_bars").isNotNull()).withColumn(
        "fill_price", F.when(F.col("filled"), F.col("limit_price")))


def triple_barrier_from_fill(fills: DataFrame, bars: DataFrame, keys: list[str], pt: float | Column = 2.0,
                             sl: float | Column = 1.0, horizon: int = 18) -> DataFrame:
    """Label filled orders from the fill bar and price, sized by the signal bar's ATR."""
    orders = fills.filter("filled").select(
        "*", (F.col("signal_pos") + F.col("wait_bars")).alias("anchor"),
        F.col("fill_price").alias("price"), F.col("atr").alias("risk"))
    return first_touch(orders, bars, keys, horizon, _as_column(pt), _as_column(sl))


def fill_rate(fills: DataFrame) -> DataFrame:
    """Fill share and side counts per asset and pooled (asset null -> 'ALL')."""
    return fills.rollup("asset").agg(
        F.avg(F.col("filled").cast("double")).alias("fill_rate"), F.count(F.lit(1)).alias("n"),
        F.sum((F.col("side") > 0).cast("long")).alias("n_long"),
        F.sum((F.col("side") < 0).cast("long")).alias("n_short")
    ).withColumn("asset", F.coalesce("asset", F.lit("ALL")))


def adverse_selection(market: DataFrame, fills: DataFrame, keys: list[str], material: float = 0.02) -> DataFrame:
    """Would-be win rate of filled against unfilled candidates."""
    joined = market.select(*keys, "label").join(fills.select(*keys, "filled"), keys)
    rates = joined.agg(
        F.sum(F.col("filled").cast("long")).alias("n_filled"),
        F.sum((~F.col("filled")).cast("long")).alias("n_unfilled"),
        F.avg(F.when(F.col("filled"), F.col("label"))).alias("filled_win_rate"),
        F.avg(F.when(~F.col("filled"), F.col("label"))).alias("unfilled_win_rate"))
    gap = F.col("unfilled_win_rate") - F.col("filled_win_rate")
    return rates.select("*", gap.alias("gap"), F.coalesce(gap > material, F.lit(False)).alias("adverse"))


def quote_touches(bars: DataFrame, k_spread: float = 2.0, k_obi: float = 0.0) -> DataFrame:
    """Stateless two-sided quoting study on bars carrying ``range_vol`` (and ``obi``).

    Quotes come from the previous bar only; counts how often each side was
    touched and the mean captured spread.
    """
    tilt = f" + {k_obi!r}D * ({shifted('obi')} - 0.5D)" if "obi" in bars.columns else ""
    mid, half = f"{shifted('close')}{tilt}", f"{k_spread!r}D * {shifted('range_vol')}"
    laid = slice_bars(bars, back=1)
    quoted = own_rows(laid.selectExpr("*", f"{mid} - {half} AS bid", f"{mid} + {half} AS ask"))
    bid_hit, ask_hit = F.col("low") <= F.col("bid"), F.col("high") >= F.col("ask")
    return quoted.groupBy("asset").agg(
        F.count(F.col("bid")).alias("n_quotes"),
        F.sum(F.coalesce(bid_hit, F.lit(False)).cast("long")).alias("bid_touches"),
        F.sum(F.coalesce(ask_hit, F.lit(False)).cast("long")).alias("ask_touches"),
        (F.avg(F.when(ask_hit, F.col("ask"))) - F.avg(F.when(bid_hit, F.col("bid")))).alias("captured_spread"))
