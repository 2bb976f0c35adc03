"""Bars from ticks and bars from bars.

Every aggregate is associative with fixed-width buffers, so ticks are combined
map-side before the shuffle and a hot asset costs one row per bucket and task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import number_rows, scan, time_bucket

# Timeframe name -> window length.
RULES = {"1d": "1 day", "4h": "4 hours", "1h": "1 hour", "15m": "15 minutes", "5m": "5 minutes", "1m": "1 minute",
         "30s": "30 seconds", "10s": "10 seconds", "5s": "5 seconds", "1s": "1 second"}


def bucket(rule: str) -> Column:
    """Start of the window the row's ``ts`` falls in; weeks start on Monday."""
    if rule == "1w":
        return F.date_trunc("week", F.col("ts")).cast("timestamp_ntz")
    return F.window("ts", RULES[rule])["start"]


def moment_order(seq: str | None = "seq", seq_in_time_order: bool = False) -> Column:
    """Orderable key of a tick that stays inside hash aggregation.

    Feeds whose sequence number grows with time are ordered by it alone, a
    plain long; otherwise time and sequence are packed into one decimal.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    if seq is None:
        return micros
    if seq_in_time_order:
        return F.col(seq).cast("long")
    return micros.cast("decimal(18,0)") * F.lit(10 ** 18).cast("decimal(19,0)") + F.col(seq).cast("decimal(18,0)")


def resample_bars(bars: DataFrame, rule: str) -> DataFrame:
    """Coarser OHLCV bars; buckets with a missing field are dropped."""
    keyed = bars.withColumn("_o", moment_order(None))
    out = keyed.groupBy("asset", bucket(rule).alias("ts")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("_o"))).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("_o"))).alias("close"),
        F.sum("volume").alias("volume"))
    return out.na.drop(subset=["open", "high", "low", "close", "volume"])


def trade_bars(ticks: DataFrame, rule: str, seq_in_time_order: bool = False) -> DataFrame:
    """OHLCV bars from trade prints (asset, ts, price, qty, seq)."""
    keyed = ticks.withColumn("_o", moment_order("seq", seq_in_time_order))
    return keyed.groupBy("asset", bucket(rule).alias("ts")).agg(
        F.min_by("price", "_o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_o").alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_ticks"))


def partial_book_bars(ticks: DataFrame, rule: str, part: Column | None = None,
                      seq_in_time_order: bool = False) -> DataFrame:
    """Book bars with the first and last moment kept, so they can be merged again."""
    keys = ["asset", bucket(rule).alias("ts")] + ([part.alias("part")] if part is not None else [])
    return ticks.withColumn("_o", moment_order("seq", seq_in_time_order)).groupBy(*keys).agg(
        F.sum("bid_qty").alias("bid_qty"), F.sum("ask_qty").alias("ask_qty"),
        F.min_by("mid", "_o").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"),
        F.max_by("mid", "_o").alias("close"), F.max_by("bid_price", "_o").alias("bid_close"),
        F.max_by("ask_price", "_o").alias("ask_close"), F.min("_o").alias("first_at"), F.max("_o").alias("last_at"))


def merge_book_bars(parts: DataFrame) -> DataFrame:
    """Combine partial bars across files, days or micro-batches."""
    return parts.groupBy("asset", "ts").agg(
        F.sum("bid_qty").alias("bid_qty"), F.sum("ask_qty").alias("ask_qty"),
        F.min_by("open", "first_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_at").alias("close"), F.max_by("bid_close", "last_at").alias("bid_close"),
        F.max_by("ask_close", "last_at").alias("ask_close"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def with_imbalance(bars: DataFrame) -> DataFrame:
    """Bid share of the summed quantities, computed after aggregation."""
    return bars.withColumn("obi", F.col("bid_qty") / (F.col("bid_qty") + F.col("ask_qty") + 1e-9))


def book_bars(ticks: DataFrame, rule: str, seq_in_time_order: bool = False) -> DataFrame:
    """Bars of the mid price with summed sizes, last quotes and imbalance."""
    return with_imbalance(partial_book_bars(ticks, rule, None, seq_in_time_order).drop("first_at", "last_at"))


def bar_quality(bars: DataFrame) -> DataFrame:
    """Mean spread and range relative to price, bar count and span."""
    return bars.groupBy("asset").agg(
        F.avg((F.col("ask_close") - F.col("bid_close")) / F.col("close")).alias("spread_pct"),
        F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("range_pct"),
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def calendar(panel: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days numbered from 0.

    Its length is the number of calendar days in the data, not the number of
    rows, so one ordered pass over it is bounded.
    """
    return number_rows(panel.select(day).distinct(), [], [day], F.lit(0), "d")


def close_panel(panel: DataFrame) -> DataFrame:
    """Dense day x asset table with nulls where an asset did not trade.

    Each asset expands to all day numbers; nothing is filled.
    """
    days = calendar(panel)
    last_day = days.agg(F.max("d")).scalar()
    slots = panel.select("asset").distinct().select(
        "asset", F.explode(F.sequence(F.lit(0).cast("long"), last_day)).alias("d"))
    return slots.join(days, "d").join(panel, ["day", "asset"], "left").select("day", "asset", "close")


def time_steps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps in seconds between consecutive distinct timestamps of each key."""
    distinct = df.select(*keys, "ts").distinct()
    stepped = scan(distinct, keys, ["ts"], time_bucket(F.col("ts")), {"_prev": ("last", F.col("ts"))}, exclusive=True)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return stepped.select(*keys, ((micros("ts") - micros("_prev")) / F.lit(1e6)).alias("step_s")).filter("step_s is not null")


def infer_bar_width(df: DataFrame, keys: list[str], default_hours: float = 4.0) -> DataFrame:
    """Most frequent gap, smallest on ties, in hours."""
    counts = time_steps(df, keys).groupBy(*keys, "step_s").agg(F.count(F.lit(1)).alias("n"))
    width = counts.groupBy(*keys).agg(
        (F.max_by("step_s", F.struct("n", (-F.col("step_s")))) / 3600.0).alias("_w"))
    return df.select(*keys).distinct().join(width, keys, "left").select(
        *keys, F.coalesce("_w", F.lit(default_hours)).alias("bar_hours")) if keys else width.select(
        F.coalesce("_w", F.lit(default_hours)).alias("bar_hours"))


def periods_per_year(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whole bars per 365 days at the median gap.

    The median comes from gap counts, so its cost is the number of distinct gaps.
    """
    counts = time_steps(df, keys).groupBy(*keys, "step_s").agg(F.count(F.lit(1)).alias("n"))
    median = counts.groupBy(*keys).agg(F.expr("percentile(step_s, 0.5, n)").alias("m"))
    return median.select(*keys, F.floor(F.lit(365.0 * 86400.0) / F.col("m")).cast("long").alias("periods"))


def daily_funding(funding: DataFrame, rule: str = "1d", charges_per_day: float = 3.0) -> DataFrame:
    """Daily funding: mean of the filled series times the charges per day."""
    return funding.groupBy("asset", bucket(rule).alias("day")).agg(
        (F.avg("funding_rate") * charges_per_day).alias("funding"))


def drop_forming_bar(bars: DataFrame, width: str, now: Column) -> DataFrame:
    """Remove bars that have not closed by ``now``."""
    return bars.filter(F.col("ts") + F.expr(f"INTERVAL {width}") <= now)
