"""Chronological splits without leakage."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import number_rows, time_bucket
from barloom.operators.economics import attach_facts
from barloom.session import cut_lineage

MICROS = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def split_by_position(trades: DataFrame, bars: DataFrame, share: float = 0.8) -> DataFrame:
    """``train``/``test`` by the timestamp of bar ``int(n * share)`` of each asset."""
    counts = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"))
    at = counts.select("asset", F.floor(F.col("_n") * share).cast("long").alias("pos"))
    edges = bars.join(at, ["asset", "pos"]).select("asset", F.col("ts").alias("split_ts"))
    return trades.join(edges, "asset").withColumn(
        "role", F.when(F.col("ts") < F.col("split_ts"), "train").otherwise("test"))


def purged_folds(rows: DataFrame, n_splits: int = 5, gap: int = 5, embargo: float = 0.01,
                 keys: list[str] = ["asset"]) -> DataFrame:
    """Walk-forward folds over row positions ``pos``: (fold, role) per row.

    The training range ends an embargo before the test range minus its gap.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.floor(F.col("_n") / (n_splits + 1)).cast("long")
    plan = n.withColumn("_size", size).withColumn(
        "_embargo", F.greatest(F.lit(1), F.floor(F.col("_size") * embargo)).cast("long"))
    placed = rows.join(plan, keys).withColumn("_f", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    train_end = F.col("_size") * F.col("_f")
    start, end = train_end + gap, train_end + gap + F.col("_size")
    role = F.when(F.col("pos") < train_end - F.col("_embargo"), "train").when(
        (F.col("pos") >= start) & (F.col("pos") < end), "test")
    valid = (end <= F.col("_n")) & (F.col("_size") > 0) & (train_end - F.col("_embargo") > 0)
    return placed.withColumn("role", F.when(valid, role)).filter("role is not null").select(
        *rows.columns, F.col("_f").alias("fold"), "role")


def fold_edges(trades: DataFrame, n_folds: int, purge_seconds: float, order: list[str] = ["ts", "trade_id"]) -> DataFrame:
    """Time edges at equal row counts: (fold, test_start, test_end, train_before); ``n_folds - 1`` rows."""
    lean = cut_lineage(trades.select(*order))
    numbered = number_rows(lean, [], order, time_bucket(F.col(order[0])), "_row")
    total = lean.agg(F.count(F.lit(1)).alias("_n"), F.max(order[0]).alias("_last"))
    marks = attach_facts(numbered, total, []).withColumn("_f", F.explode(F.sequence(F.lit(1), F.lit(n_folds - 1))))
    starts = marks.filter(F.col("_row") == F.floor(F.col("_n") * F.col("_f") / F.lit(float(n_folds)))).select(
        F.col("_f").alias("fold"), F.col(order[0]).alias("test_start"),
        (F.col("_last") + F.expr("INTERVAL 1 second")).alias("_end"))
    nxt = starts.select((F.col("fold") - 1).alias("fold"), F.col("test_start").alias("_next"))
    before = F.timestamp_micros((MICROS("test_start") - F.lit(int(purge_seconds * 1e6))).cast("long"))
    return starts.join(nxt, "fold", "left").select(
        "fold", "test_start", F.coalesce("_next", "_end").alias("test_end"),
        before.cast("timestamp_ntz").alias("train_before"))


def assign_folds(trades: DataFrame, edges: DataFrame, min_train: int = 100, two_classes: bool = False) -> DataFrame:
    """(fold, role) per trade; folds with too little data are dropped.

    ``edges`` has one row per fold (a handful by construction), so it is the
    broadcast side.
    """
    e = F.broadcast(edges)
    role = F.when(F.col("ts") < F.col("train_before"), "train").when(
        (F.col("ts") >= F.col("test_start")) & (F.col("ts") < F.col("test_end")), "test")
    placed = trades.join(e, (F.col("ts") < F.col("train_before")) | (
        (F.col("ts") >= F.col("test_start")) & (F.col("ts") < F.col("test_end")))).withColumn("role", role)
    train = F.col("role") == "train"
    sizes = placed.groupBy("fold").agg(
        F.sum(train.cast("long")).alias("_train"), F.sum((~train).cast("long")).alias("_test"),
        F.count_distinct(F.when(train, F.col("label"))).alias("_classes"))
    good = sizes.filter((F.col("_train") >= min_train) & (F.col("_test") > 0)
                        & (F.col("_classes") >= (2 if two_classes else 0))).select("fold")
    return placed.join(F.broadcast(good), "fold", "left_semi").select(*trades.columns, "fold", "role")
