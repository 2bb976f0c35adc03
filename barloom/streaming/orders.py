"""Shadow orders: pending -> filled -> closed, or expired.

Each tick moves an order at most one step.  A pending order tests the fill
before its deadline; an open order tests profit, then stop, then time, and
closes at the observed price.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.series import scan, time_bucket
from barloom.functions.stats import profit_factor
from barloom.session import cut_lineage

BAR_HOURS = 4
FILL_BARS = 3
HOLD_BARS = 18
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"

# Moments travel as epoch microseconds, so state does not depend on any zone.
ORDER_FIELDS = [("order_id", T.StringType()), ("side", T.IntegerType()), ("signal_us", T.LongType()),
                ("limit_price", T.DoubleType()), ("pt_price", T.DoubleType()), ("sl_price", T.DoubleType()),
                ("deadline_us", T.LongType())]
STATE_SCHEMA = T.StructType([T.StructField(n, k) for n, k in ORDER_FIELDS] + [
    T.StructField("fill_us", T.LongType()), T.StructField("fill_seq", T.LongType())])
RESULT_FIELDS = "order_id string, asset string, side int, status string, fill_us bigint, fill_price double, " \
                "close_us bigint, close_price double, ret double"


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def price_orders(signals: DataFrame, offset: float = 0.15, pt: float = 2.0, sl: float = 1.0) -> DataFrame:
    """Signals (asset, signal_time, side, close, atr) to resting orders."""
    side, atr = F.col("side"), F.col("atr")
    limit = F.col("close") - side * (offset * atr)
    return signals.select(
        F.concat_ws("_", F.col("asset"), F.unix_micros(F.col("signal_time").cast("timestamp")).cast("string")).alias("order_id"),
        "asset", side.cast("int").alias("side"), "signal_time", limit.alias("limit_price"),
        (limit + side * (pt * atr)).alias("pt_price"), (limit - side * (sl * atr)).alias("sl_price"),
        (F.col("signal_time") + F.expr(f"INTERVAL {BAR_HOURS * FILL_BARS} HOURS")).alias("deadline"))


def event_rows(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Orders and ticks in one schema, keyed by asset."""
    prints = ticks.select(
        "asset", micros("ts").alias("at_us"), F.col("seq").cast("long").alias("seq"), "price",
        *[F.lit(None).cast(kind).alias(name) for name, kind in ORDER_FIELDS])
    placed = orders.withColumn("signal_us", micros("signal_time")).withColumn("deadline_us", micros("deadline"))
    placed = placed.select(
        "asset", F.col("signal_us").alias("at_us"), F.lit(-1).cast("long").alias("seq"),
        F.lit(None).cast("double").alias("price"), *[F.col(name).cast(kind) for name, kind in ORDER_FIELDS])
    return prints.unionByName(placed)


def track_orders(events: DataFrame) -> DataFrame:
    """Stateful stream operator: emits each order once it is closed or expired.

    State per asset is its open orders only.  Ticks of a batch are handled as
    arrays: one comparison per order, not one per tick.
    """
    from pyspark.sql.streaming import StatefulProcessor

    state_schema, names = STATE_SCHEMA, [n for n, _ in ORDER_FIELDS]
    out_names = [part.split()[0] for part in RESULT_FIELDS.split(", ")]
    hold_us = BAR_HOURS * HOLD_BARS * 3_600_000_000
    never = -1  # stands for "not filled yet" inside the state

    class Tracker(StatefulProcessor):
        def init(self, handle):
            self.open = handle.getListState("open", state_schema)

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            batch = pd.concat(list(rows), ignore_index=True)
            ticks = batch[batch["price"].notna()].sort_values(["at_us", "seq"])
            when, seq, price = (ticks[c].to_numpy() for c in ("at_us", "seq", "price"))
            pending = [tuple(row) for row in self.open.get()]
            fresh = batch[batch["order_id"].notna()]
            pending += [tuple(r) + (never, never) for r in fresh[names].itertuples(index=False)]
            done, still = [], []

            def first(mask):
                return int(np.argmax(mask)) if mask.any() else -1

            for oid, side, born, limit, pt, sl, deadline, filled, fill_seq in pending:
                side, born, deadline = int(side), int(born), int(deadline)
                filled, fill_seq = int(filled), int(fill_seq)
                if filled == never:
                    touch = price <= limit if side > 0 else price >= limit
                    at = first((when > born) & (touch | (when >= deadline)))
                    if at >= 0 and not touch[at]:
                        done.append((oid, key[0], side, "expired_unfilled", None, None, None, None, None))
                        continue
                    if at >= 0:
                        filled, fill_seq = int(when[at]), int(seq[at])
                at = -1
                if filled != never:
                    moved = (when > filled) | ((when == filled) & (seq > fill_seq))
                    win = price >= pt if side > 0 else price <= pt
                    loss = price <= sl if side > 0 else price >= sl
                    at = first(moved & (win | loss | (when >= filled + hold_us)))
                if at < 0:
                    still.append((oid, side, born, limit, pt, sl, deadline, filled, fill_seq))
                    continue
                status = "closed_win" if win[at] else "closed_loss" if loss[at] else "closed_vertical"
                done.append((oid, key[0], side, status, filled, limit, int(when[at]), float(price[at]),
                             side * (float(price[at]) / limit - 1)))
            if still:
                self.open.put(still)
            else:
                self.open.clear()
            out = pd.DataFrame(done, columns=out_names)
            yield out.astype({"fill_us": "Int64", "close_us": "Int64", "fill_price": "float64",
                              "close_price": "float64", "ret": "float64"})

        def close(self):
            pass

    spark = events.sparkSession
    if spark.conf.get(STATE_CONF, None) != ROCKS_DB:
        spark.conf.set(STATE_CONF, ROCKS_DB)
    tracked = events.groupBy("asset").transformWithStateInPandas(
        statefulProcessor=Tracker(), outputStructType=RESULT_FIELDS, outputMode="Append", timeMode="None")
    moment = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return tracked.select("order_id", "asset", "side", "status", moment("fill_us").alias("fill_time"), "fill_price",
                          moment("close_us").alias("close_time"), "close_price", "ret")


# ---------------------------------------------------------------- batch twin

def first_tick_at_or_after(orders: DataFrame, ticks: DataFrame, moment: str, alias: str) -> DataFrame:
    """Timestamp of the first tick at or after ``moment`` of each order."""
    back = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    left = orders.select("order_id", "asset", F.col(moment).alias("_at"), F.lit(1).alias("_side"))
    right = ticks.select(F.lit(None).cast("string").alias("order_id"), "asset", F.col("ts").alias("_at"), F.lit(0).alias("_side"))
    both = left.unionByName(right).withColumn("_desc", back("_at"))
    found = scan(both, ["asset"], ["_desc", "_side"], -time_bucket(F.col("_at"), 1),
                 {alias: ("last", F.when(F.col("_side") == 0, F.col("_at")))})
    return orders.join(found.filter("_side = 1").select("order_id", alias), "order_id")


def ticks_between(orders: DataFrame, ticks: DataFrame, start: str, end: str, hours: int = 12) -> DataFrame:
    """Ticks inside each order's interval, met on (asset, time cell)."""
    cell = lambda c: time_bucket(c, hours / 24)
    spans = orders.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    right = ticks.select(F.col("asset").alias("_a"), F.col("ts").alias("tick_ts"), F.col("seq").alias("tick_seq"),
                         F.col("price").alias("tick_price"), cell(F.col("ts")).alias("_tc"))
    return spans.join(right, (spans.asset == right["_a"]) & (spans["_cell"] == right["_tc"])
                      & (right["tick_ts"] >= spans[start]) & (right["tick_ts"] <= spans[end])).drop("_cell", "_tc", "_a")


def resolve_orders(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Final state of every order against a full tick history.

    The first tick at or after a deadline bounds the search, so each order
    meets only the ticks of its own life.
    """
    far = F.col("deadline") + F.expr("INTERVAL 100 YEARS")
    last = ticks.groupBy("asset").agg(F.max("ts").alias("_end"))
    bounded = first_tick_at_or_after(orders.join(last, "asset"), ticks, "deadline", "_expire")
    bounded = cut_lineage(bounded.withColumn("_until", F.coalesce("_expire", "_end")))
    long = F.col("side") > 0
    touch = F.when(long, F.col("tick_price") <= F.col("limit_price")).otherwise(F.col("tick_price") >= F.col("limit_price"))
    hits = ticks_between(bounded.filter("_until >= signal_time"), ticks, "signal_time", "_until")
    hits = hits.filter((F.col("tick_ts") > F.col("signal_time")) & touch)
    # Only the first tick at the deadline may still fill.
    at = F.struct("tick_ts", "tick_seq")
    fills = hits.groupBy("order_id").agg(F.min(at).alias("_fill"))
    first_after = ticks.groupBy("asset", F.col("ts").alias("_expire")).agg(F.min("seq").alias("_expire_seq"))
    placed = bounded.join(fills, "order_id", "left").join(first_after, ["asset", "_expire"], "left")
    too_late = F.col("_expire").isNotNull() & (F.col("_fill.tick_ts") == F.col("_expire")) & (
        F.col("_fill.tick_seq") > F.col("_expire_seq"))
    filled = F.col("_fill").isNotNull() & ~F.coalesce(too_late, F.lit(False))
    placed = cut_lineage(placed.withColumn("fill_time", F.when(filled, F.col("_fill.tick_ts")))
                         .withColumn("fill_seq", F.when(filled, F.col("_fill.tick_seq")))
                         .withColumn("vertical", F.col("fill_time") + F.expr(f"INTERVAL {BAR_HOURS * HOLD_BARS} HOURS"))
                         .drop("_fill"))
    opened = first_tick_at_or_after(placed.filter("fill_time is not null"), ticks, "vertical", "_over")
    opened = opened.withColumn("_until", F.coalesce("_over", "_end"))
    win = F.when(long, F.col("tick_price") >= F.col("pt_price")).otherwise(F.col("tick_price") <= F.col("pt_price"))
    loss = F.when(long, F.col("tick_price") <= F.col("sl_price")).otherwise(F.col("tick_price") >= F.col("sl_price"))
    life = ticks_between(opened, ticks, "fill_time", "_until")
    life = life.filter((F.col("tick_ts") > F.col("fill_time")) | (F.col("tick_seq") > F.col("fill_seq")))
    life = life.filter(win | loss | (F.col("tick_ts") >= F.col("vertical")))
    status = F.when(win, "closed_win").when(loss, "closed_loss").otherwise("closed_vertical")
    ends = life.groupBy("order_id").agg(F.min_by(
        F.struct(F.col("tick_ts").alias("t"), F.col("tick_price").alias("p"), status.alias("s")), at).alias("_c"))
    out = placed.join(ends, "order_id", "left")
    state = (F.when(F.col("_c").isNotNull(), F.col("_c.s")).when(F.col("fill_time").isNotNull(), "filled")
             .when(F.col("_expire").isNotNull(), "expired_unfilled").otherwise("pending_fill"))
    fill_price = F.when(F.col("fill_time").isNotNull(), F.col("limit_price"))
    return out.select(
        "order_id", "asset", "side", state.alias("status"), "fill_time", fill_price.alias("fill_price"),
        F.col("_c.t").alias("close_time"), F.col("_c.p").alias("close_price"),
        (F.col("side") * (F.col("_c.p") / fill_price - 1)).alias("ret"))


def order_summary(states: DataFrame, taker: float = 0.004, maker: float = 0.0008) -> DataFrame:
    """Counts by status, closed win rate and economics, observed fill rate."""
    is_in = lambda *s: F.col("status").isin(*s)
    closed = is_in("closed_win", "closed_loss", "closed_vertical")
    count = lambda c: F.sum(c.cast("long"))
    lived = count(closed | is_in("filled"))
    known = count(closed | is_in("filled", "expired_unfilled"))
    net = lambda cost: F.when(closed, F.col("ret") - cost)
    return states.agg(
        count(is_in("pending_fill")).alias("pending"), count(is_in("filled")).alias("open"),
        count(is_in("expired_unfilled")).alias("expired"), count(closed).alias("closed"),
        F.avg(F.when(closed, is_in("closed_win").cast("double"))).alias("win_rate"),
        profit_factor(net(taker)).alias("taker_pf"), F.avg(net(taker)).alias("taker_exp"),
        profit_factor(net(maker)).alias("maker_pf"), F.avg(net(maker)).alias("maker_exp"),
        F.try_divide(lived, known).alias("fill_rate"))
