"""Registered queries: streams and their batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.catalog.signals import rounded
from barloom.operators import bars as b
from barloom.session import pin_utc
from barloom.sources import tables as t
from barloom.streaming import orders as od
from barloom.streaming import ticks as st

_B = "time_bucket(INTERVAL 4 hour, ts)"
_BARS4 = f"""b4 AS (SELECT asset, {_B} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, seq) AS close, sum(qty) AS volume, count(*) AS n_ticks FROM (SELECT * FROM sticks) GROUP BY asset, {_B})"""


@query(q.with_(q.STREAM, _BARS4) + "SELECT * FROM b4 WHERE ts + INTERVAL 4 hour <= (SELECT max(ts) - INTERVAL 1 hour FROM sticks)")
def stream_tick_bars(spark, sf_dir):
    """Bars the watermark has closed after the stream drained the event files."""
    ticks = t.shape_events(st.read_event_stream(pin_utc(spark), sf_dir))
    return st.run_to_table(st.stream_bars(ticks, "4h", seq_in_time_order=True))


_OHLC = """first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, seq) AS close, sum(qty) AS volume, count(*) AS n_ticks"""
_SLIDING = f"""s4 AS (SELECT asset, w AS ts, w + INTERVAL 4 hour AS ends, {_OHLC} FROM (
  SELECT *, time_bucket(INTERVAL 1 hour, ts) - k * INTERVAL 1 hour AS w FROM sticks, range(0, 4) r(k)) GROUP BY asset, w)"""
_SESSIONS = f"""g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 20 minute THEN 0 ELSE 1 END AS fresh FROM sticks
  WINDOW w AS (PARTITION BY asset ORDER BY ts, seq)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY asset ORDER BY ts, seq) AS no FROM g),
s20 AS (SELECT asset, min(ts) AS ts, max(ts) + INTERVAL 20 minute AS ends, {_OHLC} FROM n GROUP BY asset, no)"""
_CLOSED = " WHERE ends <= (SELECT max(ts) - INTERVAL 1 hour FROM sticks)"


@query(q.with_(q.STREAM, _SLIDING) + "SELECT * FROM s4" + _CLOSED)
def stream_sliding_bars(spark, sf_dir):
    """Four-hour bars every hour that the watermark has closed after the stream drained the event files."""
    ticks = t.shape_events(st.read_event_stream(pin_utc(spark), sf_dir))
    return st.run_to_table(st.sliding_bars(ticks, "4 hours", "1 hour", seq_in_time_order=True))


@query(q.with_(q.STREAM, _SLIDING) + "SELECT * FROM s4")
def sliding_bars(spark, sf_dir):
    return st.sliding_bars(t.stream_ticks(spark, sf_dir), "4 hours", "1 hour", seq_in_time_order=True)


@query(q.with_(q.STREAM, _SESSIONS) + "SELECT * FROM s20" + _CLOSED)
def stream_session_bars(spark, sf_dir):
    """Sessions with pauses of at most 20 minutes that the watermark has closed."""
    ticks = t.shape_events(st.read_event_stream(pin_utc(spark), sf_dir))
    return st.run_to_table(st.session_bars(ticks, "20 minutes", seq_in_time_order=True))


@query(q.with_(q.STREAM, _SESSIONS) + "SELECT * FROM s20")
def session_bars(spark, sf_dir):
    return st.session_bars(t.stream_ticks(spark, sf_dir), "20 minutes", seq_in_time_order=True)


_ORDERS = """od AS (SELECT asset || '_' || epoch_us(ts + INTERVAL 4 hour) AS order_id, asset, CASE WHEN close < open THEN 1 ELSE -1 END AS side,
    ts + INTERVAL 4 hour AS signal_time, close - CASE WHEN close < open THEN 1 ELSE -1 END * (0.15::DOUBLE * (high - low)) AS limit_price, high - low AS atr
  FROM b4 WHERE high > low),
o2 AS (SELECT *, limit_price + side * (2.0::DOUBLE * atr) AS pt_price, limit_price - side * (1.0::DOUBLE * atr) AS sl_price, signal_time + INTERVAL 12 hour AS deadline FROM od),
tk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts, seq) AS rn FROM sticks),
f0 AS (SELECT o.order_id, min(rn) FILTER (WHERE CASE WHEN side > 0 THEN price <= limit_price ELSE price >= limit_price END) AS f, min(rn) FILTER (WHERE k.ts >= deadline) AS e
  FROM o2 o JOIN tk k ON k.asset = o.asset AND k.ts > o.signal_time GROUP BY o.order_id),
f1 AS (SELECT o2.*, f0.e, CASE WHEN f <= coalesce(e, f) THEN f END AS f FROM o2 LEFT JOIN f0 USING (order_id)),
f2 AS (SELECT f1.*, k.ts AS fill_time, k.ts + INTERVAL 72 hour AS vd FROM f1 LEFT JOIN tk k ON k.asset = f1.asset AND k.rn = f1.f),
c0 AS (SELECT o.order_id, min(rn) AS c FROM f2 o JOIN tk k ON k.asset = o.asset AND k.rn > o.f AND (
    CASE WHEN side > 0 THEN price >= pt_price OR price <= sl_price ELSE price <= pt_price OR price >= sl_price END OR k.ts >= vd) GROUP BY o.order_id),
st AS (SELECT f2.order_id, f2.asset, side, CASE WHEN c IS NOT NULL THEN CASE WHEN CASE WHEN side > 0 THEN k.price >= pt_price ELSE k.price <= pt_price END THEN 'closed_win'
      WHEN CASE WHEN side > 0 THEN k.price <= sl_price ELSE k.price >= sl_price END THEN 'closed_loss' ELSE 'closed_vertical' END
    WHEN f IS NOT NULL THEN 'filled' WHEN e IS NOT NULL THEN 'expired_unfilled' ELSE 'pending_fill' END AS status,
    fill_time, CASE WHEN f IS NOT NULL THEN limit_price END AS fill_price, k.ts AS close_time, k.price AS close_price, side * (k.price / limit_price - 1) AS ret
  FROM f2 LEFT JOIN c0 USING (order_id) LEFT JOIN tk k ON k.asset = f2.asset AND k.rn = c0.c)"""
_STATES = q.with_(q.STREAM, _BARS4, _ORDERS)
_COLS = "order_id, asset, side, status, fill_time, round(fill_price, 7) AS fill_price, close_time, close_price, round(ret, 7) AS ret"


def shadow_orders(spark, sf_dir):
    """Orders from every four-hour bar: fade its direction, sized by its range."""
    bars = b.trade_bars(t.stream_ticks(spark, sf_dir), "4h", seq_in_time_order=True).filter((F.col("high") > F.col("low")))
    return od.price_orders(bars.select(
        "asset", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("signal_time"),
        F.when(F.col("close") < F.col("open"), 1).otherwise(-1).alias("side"), "close",
        (F.col("high") - F.col("low")).alias("atr")))


@query(_STATES + f"SELECT {_COLS} FROM st")
def order_lifecycle(spark, sf_dir):
    out = od.resolve_orders(shadow_orders(spark, sf_dir), t.stream_ticks(spark, sf_dir))
    return rounded(out, fill_price=7, ret=7)


@query(_STATES + f"SELECT {_COLS} FROM st WHERE status NOT IN ('filled', 'pending_fill')")
def stream_order_lifecycle(spark, sf_dir):
    """The stateful stream: orders and ticks in, finished orders out."""
    from barloom.session import cut_lineage

    events = cut_lineage(od.event_rows(shadow_orders(spark, sf_dir), t.stream_ticks(spark, sf_dir)))
    stream = spark.readStream.schema(events.schema).parquet(events.inputFiles()[0].rsplit("/", 1)[0])
    return rounded(st.run_to_table(od.track_orders(stream)), fill_price=7, ret=7)


@query(q.with_(q.STREAM) + f"SELECT DISTINCT asset, {_B} AS signal_time FROM sticks")
def stream_distinct_signals(spark, sf_dir):
    """A signal logged on every tick of its bar is kept once."""
    ticks = t.shape_events(st.read_event_stream(pin_utc(spark), sf_dir))
    logged = ticks.select("asset", F.window("ts", "4 hours")["start"].alias("signal_time"))
    return st.run_to_table(st.distinct_signals(logged))


@query(q.with_(q.STREAM) + f"""SELECT DISTINCT asset, {_B} AS signal_time FROM sticks EXCEPT
SELECT asset, {_B} FROM sticks WHERE ts < TIMESTAMP '2024-01-15'""")
def new_signals(spark, sf_dir):
    ticks = t.stream_ticks(spark, sf_dir)
    found = ticks.select("asset", F.window("ts", "4 hours")["start"].alias("signal_time"))
    return st.new_signals(found, found.filter(F.col("signal_time") < F.lit("2024-01-15").cast("timestamp_ntz")))


@query(_STATES + """, n AS (SELECT *, ret - 0.004 AS nt, ret - 0.0008 AS nm FROM st)
SELECT count(*) FILTER (WHERE status = 'pending_fill') AS pending, count(*) FILTER (WHERE status = 'filled') AS open,
  count(*) FILTER (WHERE status = 'expired_unfilled') AS expired, count(*) FILTER (WHERE status LIKE 'closed%') AS closed,
  round(avg(CASE WHEN status LIKE 'closed%' THEN CAST(status = 'closed_win' AS INT) END), 9) AS win_rate,
  round(sum(nt) FILTER (WHERE nt > 0) / abs(sum(nt) FILTER (WHERE nt <= 0)), 7) AS taker_pf, round(avg(nt), 8) AS taker_exp,
  round(sum(nm) FILTER (WHERE nm > 0) / abs(sum(nm) FILTER (WHERE nm <= 0)), 7) AS maker_pf, round(avg(nm), 8) AS maker_exp,
  round(count(*) FILTER (WHERE status LIKE 'closed%' OR status = 'filled') / count(*) FILTER (WHERE status <> 'pending_fill')::DOUBLE, 9) AS fill_rate FROM n""")
def order_state_summary(spark, sf_dir):
    out = od.order_summary(od.resolve_orders(shadow_orders(spark, sf_dir), t.stream_ticks(spark, sf_dir)))
    return rounded(out, win_rate=9, taker_pf=7, taker_exp=8, maker_pf=7, maker_exp=8, fill_rate=9)
