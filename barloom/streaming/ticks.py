"""Tick streams to bars, and run helpers for bounded stream runs."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.bars import RULES, moment_order
from barloom.session import shared_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
                      files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream; the pattern picks them out of a shared folder."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_bars(ticks: DataFrame, rule: str, delay: str = "1 hour", seq_in_time_order: bool = False) -> DataFrame:
    """Tumbling OHLCV bars; a bar is emitted once the watermark passes its end."""
    timed = ticks.withColumn("_o", moment_order("seq", seq_in_time_order)).withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", RULES[rule]), "asset").agg(*_bar_columns()).select(
        "asset", F.col("window.start").cast("timestamp_ntz").alias("ts"), *BAR_COLUMNS)


def sliding_bars(ticks: DataFrame, width: str, slide: str, delay: str = "1 hour", seq_in_time_order: bool = False) -> DataFrame:
    """OHLCV bars of overlapping windows, one every ``slide``; batch and stream alike.

    A tick belongs to width / slide windows and is combined inside them before the shuffle. A stream
    emits a window once the watermark passes its end and leaves late ticks out of windows that the
    watermark of the micro-batch before had closed; a batch returns every window. Ticks without a time or an asset take no part.
    """
    timed = ticks.dropna(subset=["asset", "ts"]).withColumn("_o", moment_order("seq", seq_in_time_order))
    timed = timed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width, slide), "asset").agg(*_bar_columns()).select(
        "asset", F.col("window.start").cast("timestamp_ntz").alias("ts"), F.col("window.end").cast("timestamp_ntz").alias("ends"),
        *BAR_COLUMNS)


def session_bars(ticks: DataFrame, gap: str, delay: str = "1 hour", seq_in_time_order: bool = False) -> DataFrame:
    """OHLCV bars of sessions: runs of an asset's ticks, each at most ``gap`` after the one before.

    A session ends ``gap`` after its last tick. A late tick inside the watermark extends the session it
    meets and merges two that it joins; a stream emits a session once the watermark passes its end, and drops
    ticks whose own session the watermark of the micro-batch before had closed.
    Sessions are merged inside every input partition first, so that an asset with a third of all ticks
    sends its sessions through the shuffle and not its ticks. Ticks without a time or an asset take no part.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    timed = ticks.dropna(subset=["asset", "ts"]).withColumn("_o", moment_order("seq", seq_in_time_order))
    timed = timed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", gap), "asset").agg(*_bar_columns()).select(
        "asset", F.col("session_window.start").cast("timestamp_ntz").alias("ts"),
        F.col("session_window.end").cast("timestamp_ntz").alias("ends"), *BAR_COLUMNS)


BAR_COLUMNS = ["open", "high", "low", "close", "volume", "n_ticks"]


def _bar_columns() -> list:
    return [F.min_by("price", "_o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "_o").alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_ticks")]


def distinct_signals(signals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (asset, signal_time) once, however often it is logged."""
    timed = signals.withColumn("_event", F.col("signal_time").cast("timestamp")).withWatermark("_event", delay)
    return timed.dropDuplicatesWithinWatermark(["asset", "signal_time"]).drop("_event")


def new_signals(found: DataFrame, logged: DataFrame) -> DataFrame:
    """Batch form: signals of this run that the log does not hold yet."""
    return found.dropDuplicates(["asset", "signal_time"]).join(logged, ["asset", "signal_time"], "left_anti")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Drain a stream into files of the shared folder and return them.

    Results go to a file sink, never through the driver; the checkpoint beside
    them lets a lost run resume.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), "streams", uuid.uuid4().hex)
    run = (stream.writeStream.format("parquet").outputMode("append")
           .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
