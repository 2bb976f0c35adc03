"""Streams give the batch result, also when the input arrives in several files."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import bars as b
from barloom.sources import tables as t
from barloom.streaming import orders as od
from barloom.streaming import ticks as st

SF = "/root/testdata/sf0.001"


def test_bars_from_split_files_equal_batch(spark, tmp_path):
    events = t.table(spark, SF, "events")
    for i in range(4):
        low, high = i * 250, (i + 1) * 250
        part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "events"))
    stream = t.shape_events(st.read_event_stream(spark, str(tmp_path / "events"), "*.parquet", files_per_trigger=1))
    got = st.run_to_table(st.stream_bars(stream, "4h", "40 days")).toPandas()
    whole = b.trade_bars(t.stream_ticks(spark, SF), "4h").toPandas()
    both = got.merge(whole, on=["asset", "ts"], suffixes=("", "_b"))
    assert len(both) == len(got)
    for c in ("open", "high", "low", "close", "volume", "n_ticks"):
        assert np.allclose(both[c], both[f"{c}_b"])


def one_order(spark, side=1):
    signals = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), side, 100.0, 2.0)],
                                    "asset string, signal_time timestamp_ntz, side int, close double, atr double")
    return od.price_orders(signals)


def resolve(spark, prices, side=1):
    ticks = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(p), i) for i, (h, p) in enumerate(prices)],
        "asset string, ts timestamp_ntz, price double, seq long")
    return od.resolve_orders(one_order(spark, side), ticks).first()


def test_order_lifecycle_cases(spark):
    price = one_order(spark).first()
    assert (price.limit_price, price.pt_price, price.sl_price) == (99.7, 103.7, 97.7)
    assert resolve(spark, [(1, 100), (2, 99.5), (3, 104)]).status == "closed_win"
    loss = resolve(spark, [(1, 99), (3, 97)])
    assert loss.status == "closed_loss" and loss.close_price == 97 and loss.fill_price == 99.7
    assert resolve(spark, [(1, 100), (13, 100), (14, 99)]).status == "expired_unfilled"
    assert resolve(spark, [(1, 100), (13, 99)]).status == "filled"          # fill is tested before the deadline
    assert resolve(spark, [(1, 99), (80, 100)]).status == "closed_vertical"
    assert resolve(spark, [(1, 100)]).status == "pending_fill"
    assert resolve(spark, [(1, 101), (2, 96)], side=-1).status == "closed_win"
    assert resolve(spark, [(1, 99), (1, 104)]).status == "closed_win"       # same moment, later tick


def test_order_stream_in_several_batches(spark, tmp_path):
    from barloom.catalog.streams import shadow_orders

    ticks, orders = t.stream_ticks(spark, SF), shadow_orders(spark, SF)
    cuts = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2025-01-01"]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        lo_, hi_ = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
        part = od.event_rows(orders.filter((F.col("signal_time") >= lo_) & (F.col("signal_time") < hi_)),
                             ticks.filter((F.col("ts") >= lo_) & (F.col("ts") < hi_)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.run_to_table(od.track_orders(stream)).toPandas().set_index("order_id").sort_index()
    want = od.resolve_orders(orders, ticks).filter("status not in ('filled', 'pending_fill')").toPandas().set_index("order_id").sort_index()
    assert list(got.index) == list(want.index) and (got.status == want.status).all()
    assert np.allclose(got.ret.fillna(0), want.ret.fillna(0))
