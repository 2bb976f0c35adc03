"""Readers, normalisers and sinks for market data files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.series import forward_fill, scan, time_bucket

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = T.StructType(
    [T.StructField("asset", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS])

# The twelve documented columns of a raw kline archive row.
KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time",
                 "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore"]
KLINE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in KLINE_COLUMNS])
MICROSECOND_FLOOR = 100_000_000_000_000  # 1e14: anything above is microseconds


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def enough_history(bars: DataFrame, minimum: int) -> DataFrame:
    """Keep only assets with at least ``minimum`` bars."""
    deep = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return bars.join(deep.select("asset"), "asset", "left_semi")


def read_raw_klines(spark: SparkSession, path: str) -> DataFrame:
    """Headerless kline archives; the asset is the parent directory ``asset=...``."""
    return spark.read.schema(KLINE_SCHEMA).option("header", "false").csv(path)


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """OHLCV files in the library schema, cleaned."""
    reader = spark.read.schema(BAR_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    raw = reader.load(path)
    return clean_bars(raw.withColumn("ingest", F.monotonically_increasing_id()))


def clean_bars(raw: DataFrame, ingest: str = "ingest") -> DataFrame:
    """Required columns only; of duplicate timestamps the last ingested wins."""
    require_columns(raw, ["asset", "ts", *BAR_COLUMNS, ingest], "bars")
    newest = F.max_by(F.struct(*BAR_COLUMNS), ingest).alias("_b")
    return raw.groupBy("asset", "ts").agg(newest).select("asset", "ts", "_b.*")


def epoch_to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz")


def normalise_klines(raw: DataFrame, start: str | None = None, end: str | None = None,
                     ingest: str = "ingest") -> DataFrame:
    """Raw string klines to bars.

    Header rows (non-numeric open time) are dropped, microsecond epochs scaled
    down, and of duplicate timestamps the first ingested wins.
    """
    numeric = raw.withColumn("_t", F.col("open_time").try_cast("double")).filter("_t is not null")
    ms = F.when(F.col("_t") > MICROSECOND_FLOOR, F.floor(F.col("_t") / 1000)).otherwise(F.col("_t"))
    typed = numeric.select("asset", epoch_to_ts(ms).alias("ts"),
                           *[F.col(c).try_cast("double").alias(c) for c in BAR_COLUMNS], ingest)
    if start:
        typed = typed.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        typed = typed.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return typed.groupBy("asset", "ts").agg(
        F.min_by(F.struct(*BAR_COLUMNS), ingest).alias("_b")).select("asset", "ts", "_b.*")


def normalise_funding(raw: DataFrame, step: str = "1 hour", ingest: str = "ingest") -> DataFrame:
    """Epoch-millisecond charges to a gapless, forward-filled series.

    Each charge fills the grid up to the next one, so every row only needs its
    successor: no dense grid is joined.
    """
    charges = raw.groupBy("asset", epoch_to_ts(F.col("calc_time")).alias("ts")).agg(
        F.min_by("funding_rate", ingest).alias("funding_rate"))
    bucket = time_bucket(F.col("ts"))
    reverse = charges.withColumn("_desc", -F.unix_micros(F.col("ts").cast("timestamp")))
    nxt = scan(reverse, ["asset"], ["_desc"], -bucket, {"_next": ("min", F.col("ts"))}, exclusive=True)
    hour = lambda c: F.date_trunc("hour", c)
    first = F.when(F.col("ts").cast("timestamp") == hour(F.col("ts").cast("timestamp")),
                   F.col("ts").cast("timestamp")).otherwise(
        hour(F.col("ts").cast("timestamp")) + F.expr(f"INTERVAL {step}"))
    last = F.coalesce(F.col("_next").cast("timestamp") - F.expr("INTERVAL 1 microsecond"),
                      F.col("ts").cast("timestamp"))
    slots = F.when(first <= last, F.sequence(first, last, F.expr(f"INTERVAL {step}")))
    grid = nxt.select("asset", F.explode(slots).alias("_at"), "funding_rate")
    return grid.select("asset", F.col("_at").cast("timestamp_ntz").alias("ts"), "funding_rate")


def normalise_book(raw: DataFrame) -> DataFrame:
    """Top-of-book updates: typed quotes, mid price, timestamp."""
    bid, ask = F.col("best_bid_price").cast("double"), F.col("best_ask_price").cast("double")
    return raw.select(
        "asset", epoch_to_ts(F.col("transaction_time")).alias("ts"), F.col("update_id").alias("seq"),
        F.col("best_bid_qty").cast("double").alias("bid_qty"), F.col("best_ask_qty").cast("double").alias("ask_qty"),
        bid.alias("bid_price"), ask.alias("ask_price"), ((bid + ask) / 2).alias("mid"))


def overlap_report(old: DataFrame, new: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Per-asset merge verdict of ``new`` bars against ``old``, all assets in one job."""
    old_span = old.groupBy("asset").agg(F.min("ts").alias("old_min"), F.max("ts").alias("old_max"))
    prices = new.select("asset", "ts", F.col("close").alias("new_close")).join(
        old.select("asset", "ts", F.col("close").alias("old_close")), ["asset", "ts"], "left")
    base = F.when(F.abs("old_close") > 1e-12, F.abs("old_close")).otherwise(1.0)
    joined = prices.join(old_span, "asset", "left")
    outside = (F.col("ts") > F.col("old_max")) | (F.col("ts") < F.col("old_min"))
    stats = joined.groupBy("asset").agg(
        F.count("old_close").alias("overlap"),
        F.max(F.abs(F.col("new_close") - F.col("old_close")) / base).alias("max_rel_diff"),
        F.sum(F.coalesce(outside, F.lit(False)).cast("long")).alias("_outside"),
        F.count(F.lit(1)).alias("_all"), F.max("old_max").alias("_old"))
    status = (F.when(F.col("_old").isNull(), "created").when(F.col("overlap") == 0, "refused_no_overlap")
              .when(F.col("max_rel_diff") > tolerance, "refused_mismatch")
              .when(F.col("_outside") == 0, "noop").otherwise("merged"))
    added = F.when(status == "created", F.col("_all")).when(status == "merged", F.col("_outside")).otherwise(0)
    return stats.select("asset", status.alias("status"), added.alias("added"), "overlap", "max_rel_diff")


def merge_bars(old: DataFrame, new: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Old bars plus the verified bars outside their span; gaps inside stay."""
    verdict = overlap_report(old, new, tolerance).filter(F.col("status").isin("created", "merged")).select("asset", "status")
    old_span = old.groupBy("asset").agg(F.min("ts").alias("_min"), F.max("ts").alias("_max"))
    fresh = (new.join(verdict, "asset").join(old_span, "asset", "left")
             .filter((F.col("status") == "created") | (F.col("ts") > F.col("_max")) | (F.col("ts") < F.col("_min"))))
    return old.unionByName(fresh.select(*old.columns))


def attach_series(bars: DataFrame, series: DataFrame, columns: list[str], default: float | None = None) -> DataFrame:
    """Exact-timestamp join, then forward fill per asset; ``default`` fills the lead-in."""
    joined = bars.join(series.select("asset", "ts", *columns), ["asset", "ts"], "left")
    filled = forward_fill(joined, columns)
    if default is not None:
        filled = filled.fillna(default, subset=columns)
    return filled


def pool(frames: dict[str, DataFrame], tag: str = "signal") -> DataFrame:
    """Union several frames, tagged by name."""
    out: DataFrame | None = None
    for name, df in frames.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("nothing to pool")
    return out


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                 mode: str = "errorifexists", rows_per_file: int = 5_000_000) -> None:
    """Partitioned result sink; big partitions are split into several files."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
