"""Market-data views over the supplied star-schema tables.

Prints are line items, assets are brands, and every other input (funding,
quotes, fills, replies) is derived from the same tables, so all work grows
with them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.series import number_rows
from barloom.session import cut_lineage, pin_utc

LEADER = "Brand#1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade prints: asset, ts, price, qty and the columns that order them."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        "asset", F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"), print_order().alias("seq"), "l_discount", "l_returnflag")


def print_order() -> Column:
    """Order of prints as one number: order, then line, then amount in cents.

    A fixed-width key keeps ``min_by``/``max_by`` in hash aggregation (a struct
    would sort every tick partition). A 38-digit decimal holds orders below 10^15,
    lines below 10^10 and amounts below 10^13 cents without any of them wrapping.
    """
    part = lambda c, digits: c.cast(f"decimal({digits},0)")
    order = part(F.col("l_orderkey"), 15) * F.lit(10 ** 10).cast("decimal(11,0)") + part(F.col("l_linenumber"), 10)
    cents = F.round(F.col("l_extendedprice") * 100)
    return (part(order, 25) * F.expr("cast(10000000000000 as decimal(14,0))") + part(cents, 13)).cast("decimal(38,0)")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per brand."""
    return ticks(spark, sf_dir).groupBy("asset", "ts").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"))


def numbered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their position per asset, written once.

    Bars are far smaller than ticks and are read by every later step, so ticks
    are scanned a single time and positions are counted a single time.
    """
    return cut_lineage(number_rows(cut_lineage(bars(spark, sf_dir))))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed funding rate per brand and day."""
    exact = F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double")
    return ticks(spark, sf_dir).groupBy("asset", "ts").agg(
        ((exact / F.count(F.lit(1)) - F.lit(0.05)) / F.lit(100.0)).alias("funding_rate"))


def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of bought quantity per brand and day; returned prints count as sales."""
    sold = F.col("l_returnflag") == "R"
    bought, both = F.sum(F.when(sold, 0.0).otherwise(F.col("qty"))), F.sum("qty")
    return ticks(spark, sf_dir).groupBy("asset", "ts").agg((bought / (both + F.lit(1e-9))).alias("obi"))


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly average price per supplier nation: (asset, day, close), written once."""
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
              .join(nations, F.col("s_nationkey") == F.col("n_nationkey")))
    week = F.date_trunc("week", F.col("l_shipdate")).cast("timestamp_ntz")
    value = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    size = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return cut_lineage(joined.groupBy(F.col("n_name").alias("asset"), week.alias("day")).agg((value / size).alias("close")))


def week_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly funding rate per supplier nation: (asset, ts, funding_rate), one row per day."""
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
              .join(nations, F.col("s_nationkey") == F.col("n_nationkey")))
    exact = F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double")
    return joined.groupBy(F.col("n_name").alias("asset"), F.col("l_shipdate").alias("ts")).agg(
        ((exact / F.count(F.lit(1)) - F.lit(0.05)) / F.lit(1000.0)).alias("funding_rate"))


def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ticks: asset, ts, price, qty, seq."""
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"), F.col("event_id").alias("seq"))


def book_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book updates as raw strings and epoch milliseconds."""
    buy = F.col("event_type").isin("purchase", "signup")
    qty = F.get_json_object("props", "$.k").cast("double")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("asset"),
        F.col("event_id").alias("update_id"),
        F.col("value").cast("string").alias("best_bid_price"),
        F.when(buy, qty).otherwise(qty / 2).cast("string").alias("best_bid_qty"),
        (F.col("value") + 0.25).cast("string").alias("best_ask_price"),
        F.when(buy, qty / 2).otherwise(qty).cast("string").alias("best_ask_qty"),
        ms.alias("transaction_time"), ms.alias("event_time"))


def hash_uniform(*parts: Column) -> Column:
    """Repeatable draw in [0, 2^60) from the text of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def unit_draw(*parts: Column) -> Column:
    return hash_uniform(*parts) / F.lit(2.0 ** 60)
