"""Registered queries: sources, sinks and bars."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.operators import bars as b
from barloom.operators import economics as ec
from barloom.session import shared_dir
from barloom.functions.series import attach_asof
from barloom.sources import market as m
from barloom.sources import tables as t

BAR_OUT = "asset, ts, open, high, low, close, volume"
MICROS = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def _ingested(bars):
    """Bars with every seventh row repeated under a later ingest number and other prices."""
    first = bars.withColumn("ingest", F.lit(1))
    again = (bars.filter(F.dayofyear("ts") % 7 == 0).withColumn("close", F.col("close") + 1)
             .withColumn("ingest", F.lit(2)))
    return first.unionByName(again)


@query(q.with_(q.BARS) + """SELECT asset, ts, open, high, low,
  CASE WHEN dayofyear(ts) % 7 = 0 THEN close + 1 ELSE close END AS close, volume FROM bars""")
def read_bars_keep_last(spark, sf_dir):
    return m.clean_bars(_ingested(t.bars(spark, sf_dir)))


@query(q.with_(q.BARS) + f"""SELECT {BAR_OUT} FROM bars
WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2000-12-31'""")
def normalise_raw_klines(spark, sf_dir):
    """String klines with header rows, mixed epochs and duplicates."""
    bars = _ingested(t.bars(spark, sf_dir))
    ms = F.floor(MICROS("ts") / 1000).cast("long")
    epoch = F.when(F.day("ts") % 2 == 0, ms).otherwise(MICROS("ts"))
    raw = bars.select("asset", epoch.cast("string").alias("open_time"),
                      *[F.col(c).cast("string").alias(c) for c in m.BAR_COLUMNS], "ingest")
    header = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("asset")).distinct().select(
        "asset", F.lit("open_time").alias("open_time"), *[F.lit(c).alias(c) for c in m.BAR_COLUMNS],
        F.lit(0).alias("ingest"))
    return m.normalise_klines(raw.unionByName(header), "1996-01-01", "2000-12-31")


@query(q.with_(q.STREAM) + """, c AS (SELECT asset, time_bucket(INTERVAL 1 millisecond, ts) AS ts, first(price ORDER BY seq) AS rate
  FROM sticks GROUP BY 1, 2),
g AS (SELECT asset, unnest(generate_series(
        CASE WHEN min(ts) = date_trunc('hour', min(ts)) THEN min(ts) ELSE date_trunc('hour', min(ts)) + INTERVAL 1 hour END,
        max(ts), INTERVAL 1 hour)) AS ts FROM c GROUP BY asset)
SELECT g.asset, g.ts, c.rate AS funding_rate FROM g ASOF JOIN c ON g.asset = c.asset AND g.ts >= c.ts""")
def normalise_funding_hourly(spark, sf_dir):
    ticks = t.stream_ticks(spark, sf_dir)
    raw = ticks.select("asset", F.floor(MICROS("ts") / 1000).cast("long").alias("calc_time"),
                       F.col("price").alias("funding_rate"), F.col("seq").alias("ingest"))
    return m.normalise_funding(raw)


BOOK = q.with_("""raw AS (SELECT CAST(user_id % 5 AS VARCHAR) AS asset, event_id AS seq,
    time_bucket(INTERVAL 1 millisecond, ts) AS ts, value AS bid_price, value + 0.25 AS ask_price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type IN ('purchase', 'signup') AS buy FROM events),
book AS (SELECT asset, ts, seq, CASE WHEN buy THEN k ELSE k / 2 END AS bid_qty, CASE WHEN buy THEN k / 2 ELSE k END AS ask_qty,
    bid_price, ask_price, (bid_price + ask_price) / 2 AS mid FROM raw),
bb AS (SELECT asset, date_trunc('hour', ts) AS ts, sum(bid_qty) AS bid_qty, sum(ask_qty) AS ask_qty,
    first(mid ORDER BY ts, seq) AS open, max(mid) AS high, min(mid) AS low, last(mid ORDER BY ts, seq) AS close,
    last(bid_price ORDER BY ts, seq) AS bid_close, last(ask_price ORDER BY ts, seq) AS ask_close
  FROM (SELECT * FROM book) GROUP BY 1, date_trunc('hour', ts))""")


@query(BOOK + "SELECT * FROM book")
def normalise_book_ticks(spark, sf_dir):
    return m.normalise_book(t.book_ticks(spark, sf_dir))


_TOPUP = q.with_(q.BARS) + """, old AS (SELECT * FROM bars WHERE ts <= TIMESTAMP '1998-06-01' AND asset <> 'Brand#4'),
new AS (SELECT asset, ts, open, high, low, CASE WHEN asset = 'Brand#2' THEN close * 1.01::DOUBLE ELSE close END AS close, volume FROM bars
  WHERE (asset NOT IN ('Brand#3', 'Brand#5') AND ts >= TIMESTAMP '1998-03-01')
     OR (asset = 'Brand#3' AND ts >= TIMESTAMP '1999-01-01')
     OR (asset = 'Brand#5' AND ts BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-06-01')),
sp AS (SELECT asset, min(ts) AS mn, max(ts) AS mx FROM old GROUP BY asset),
st AS (SELECT n.asset, count(o.close) AS overlap, max(abs(n.close - o.close) / CASE WHEN abs(o.close) > 1e-12 THEN abs(o.close) ELSE 1 END) AS diff,
    count(*) FILTER (WHERE n.ts > sp.mx OR n.ts < sp.mn) AS outside, count(*) AS n_all, max(sp.mx) AS mx
  FROM new n LEFT JOIN old o ON n.asset = o.asset AND n.ts = o.ts LEFT JOIN sp ON sp.asset = n.asset GROUP BY n.asset),
v AS (SELECT asset, overlap, diff, outside, n_all, CASE WHEN mx IS NULL THEN 'created' WHEN overlap = 0 THEN 'refused_no_overlap'
    WHEN diff > 0.001 THEN 'refused_mismatch' WHEN outside = 0 THEN 'noop' ELSE 'merged' END AS status FROM st)
"""


def _topup(spark, sf_dir):
    bars = t.bars(spark, sf_dir)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    old = bars.filter((F.col("ts") <= at("1998-06-01")) & (F.col("asset") != "Brand#4"))
    new = bars.filter(
        (~F.col("asset").isin("Brand#3", "Brand#5") & (F.col("ts") >= at("1998-03-01")))
        | ((F.col("asset") == "Brand#3") & (F.col("ts") >= at("1999-01-01")))
        | ((F.col("asset") == "Brand#5") & F.col("ts").between(at("1998-03-01"), at("1998-06-01"))))
    new = new.withColumn("close", F.when(F.col("asset") == "Brand#2", F.col("close") * 1.01).otherwise(F.col("close")))
    return old, new


@query(_TOPUP + """SELECT asset, status, CASE status WHEN 'created' THEN n_all WHEN 'merged' THEN outside ELSE 0 END AS added,
  overlap, round(diff, 9) AS max_rel_diff FROM v""")
def merge_bars_report(spark, sf_dir):
    old, new = _topup(spark, sf_dir)
    return m.overlap_report(old, new).withColumn("max_rel_diff", F.round("max_rel_diff", 9))


@query(_TOPUP + f"""SELECT {BAR_OUT} FROM old UNION ALL SELECT n.asset, n.ts, n.open, n.high, n.low, n.close, n.volume
FROM new n JOIN v ON v.asset = n.asset LEFT JOIN sp ON sp.asset = n.asset
WHERE v.status = 'created' OR (v.status = 'merged' AND (n.ts > sp.mx OR n.ts < sp.mn))""")
def merge_bars_result(spark, sf_dir):
    old, new = _topup(spark, sf_dir)
    return m.merge_bars(old, new)


@query(q.with_(q.BARS) + f"SELECT {BAR_OUT} FROM bars")
def result_sink_round_trip(spark, sf_dir):
    """Write bars partitioned by asset to the shared folder and read them back."""
    path = os.path.join(shared_dir(spark), "sinks", uuid.uuid4().hex)
    m.write_result(t.bars(spark, sf_dir), path, partition_by=["asset"])
    return spark.read.parquet(path).select("asset", "ts", *m.BAR_COLUMNS)


def _filled(column: str) -> str:
    return f"last_value({column} IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts)"



_WHOLE = q.with_(q.BARS, q.FUNDING) + """, imb AS (SELECT asset, ts,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE qty END) AS DOUBLE) / (sum(qty) + 1e-9::DOUBLE) AS obi FROM ticks GROUP BY asset, ts),
j AS (SELECT b.asset, b.ts, b.close, f.funding_rate, i.obi FROM bars b LEFT JOIN funding f ON f.asset = b.asset AND f.ts = b.ts
  LEFT JOIN imb i ON i.asset = b.asset AND i.ts = b.ts)"""


@query(_WHOLE + f"SELECT asset, ts, close, {_filled('funding_rate')} AS funding_rate FROM j")
def attach_funding(spark, sf_dir):
    """The whole funding series on the bars."""
    return m.attach_series(t.bars(spark, sf_dir).select("asset", "ts", "close"), t.funding(spark, sf_dir), ["funding_rate"])


@query(_WHOLE + f"SELECT asset, ts, close, round(coalesce({_filled('obi')}, 0.5), 12) AS obi FROM j")
def attach_imbalance_default(spark, sf_dir):
    """The whole imbalance series on the bars."""
    out = m.attach_series(t.bars(spark, sf_dir).select("asset", "ts", "close"), t.imbalance(spark, sf_dir), ["obi"], default=0.5)
    return out.withColumn("obi", F.round("obi", 12))


@query(q.with_(q.STREAM) + """, s AS (SELECT asset, ts, seq FROM sticks WHERE seq % 3 = 0),
r AS (SELECT asset, ts, last(price ORDER BY seq) AS price FROM sticks WHERE seq % 3 <> 0 GROUP BY asset, ts)
SELECT s.asset, s.ts, s.seq, r.price FROM s ASOF LEFT JOIN r ON s.asset = r.asset AND s.ts >= r.ts""")
def attach_as_of(spark, sf_dir):
    ticks = t.stream_ticks(spark, sf_dir)
    left = ticks.filter("seq % 3 = 0").select("asset", "ts", "seq")
    right = ticks.filter("seq % 3 <> 0").groupBy("asset", "ts").agg(F.max_by("price", "seq").alias("price"))
    return attach_asof(left, right, ["price"])


@query(q.with_(q.BARS, q.STREAM) + """, sb AS (SELECT asset, time_bucket(INTERVAL 4 hour, ts) AS ts, last(price ORDER BY ts, seq) AS close FROM sticks
  GROUP BY asset, time_bucket(INTERVAL 4 hour, ts))
SELECT asset, ts, close, 'daily' AS source FROM bars UNION ALL SELECT asset, ts, close, 'four_hour' FROM sb""")
def pool_assets(spark, sf_dir):
    return m.pool({"daily": t.bars(spark, sf_dir).select("asset", "ts", "close"),
                   "four_hour": b.trade_bars(t.stream_ticks(spark, sf_dir), "4h", seq_in_time_order=True).select("asset", "ts", "close")},
                  tag="source")


@query(q.with_(q.BARS) + f"""SELECT asset, ts, close FROM bars WHERE asset IN
(SELECT asset FROM bars GROUP BY asset HAVING count(*) >= 1500)""")
def enough_history(spark, sf_dir):
    bars = m.require_columns(t.bars(spark, sf_dir), ["asset", "ts", *m.BAR_COLUMNS], "bars")
    return m.enough_history(bars, 1500).select("asset", "ts", "close")


# ------------------------------------------------------------------ bars

@query(q.with_(q.BARS) + f"SELECT {BAR_OUT} FROM bars")
def daily_bars(spark, sf_dir):
    return t.bars(spark, sf_dir)


@query(q.with_(q.BARS) + """SELECT asset, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
  min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY asset, date_trunc('week', ts)""")
def resample_bars_weekly(spark, sf_dir):
    return b.resample_bars(t.bars(spark, sf_dir), "1w")


def _stream_bars_sql(step: str) -> str:
    bucket = f"time_bucket(INTERVAL {step}, ts)"
    return q.with_(q.STREAM) + f"""SELECT asset, {bucket} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(qty) AS volume, count(*) AS n_ticks
FROM (SELECT * FROM sticks) GROUP BY asset, {bucket}"""


@query(_stream_bars_sql("4 hour"))
def tick_bars_4h(spark, sf_dir):
    return b.trade_bars(t.stream_ticks(spark, sf_dir), "4h", seq_in_time_order=True)


@query(_stream_bars_sql("5 minute"))
def tick_bars_5m(spark, sf_dir):
    return b.trade_bars(t.stream_ticks(spark, sf_dir), "5m", seq_in_time_order=True)


@query(BOOK + "SELECT asset, ts, bid_qty, ask_qty, open, high, low, close, bid_close, ask_close FROM bb")
def book_bars_hourly(spark, sf_dir):
    return b.book_bars(m.normalise_book(t.book_ticks(spark, sf_dir)), "1h").drop("obi")


@query(BOOK + "SELECT asset, ts, bid_qty, ask_qty, open, high, low, close, bid_close, ask_close FROM bb")
def book_bars_merged(spark, sf_dir):
    """Bars per chunk of updates, merged again: equal to the single pass."""
    ticks = m.normalise_book(t.book_ticks(spark, sf_dir))
    parts = b.partial_book_bars(ticks, "1h", part=F.floor(F.col("seq") / 1000))
    return b.merge_book_bars(parts.drop("part")).drop("first_at", "last_at")


@query(BOOK + "SELECT asset, ts, round(bid_qty / (bid_qty + ask_qty + 1e-9), 10) AS obi FROM bb")
def book_imbalance(spark, sf_dir):
    bars = b.book_bars(m.normalise_book(t.book_ticks(spark, sf_dir)), "1h")
    return bars.select("asset", "ts", F.round("obi", 10).alias("obi"))


@query(BOOK + """SELECT asset, round(avg((ask_close - bid_close) / close), 8) AS spread_pct, round(avg((high - low) / close), 8) AS range_pct,
  count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bb GROUP BY asset""")
def bar_quality(spark, sf_dir):
    out = b.bar_quality(b.book_bars(m.normalise_book(t.book_ticks(spark, sf_dir)), "1h"))
    return out.withColumn("spread_pct", F.round("spread_pct", 8)).withColumn("range_pct", F.round("range_pct", 8))


@query(q.with_(q.PANEL) + "SELECT day, asset, close FROM grid")
def close_panel(spark, sf_dir):
    return b.close_panel(t.week_panel(spark, sf_dir))


@query(q.with_(q.BARS) + """, g AS (SELECT asset, date_diff('second', lag(ts) OVER (PARTITION BY asset ORDER BY ts), ts) AS s FROM bars),
n AS (SELECT asset, s, count(*) AS n FROM g WHERE s IS NOT NULL GROUP BY asset, s),
r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY n DESC, s) AS k FROM n)
SELECT asset, s / 3600.0::DOUBLE AS bar_hours FROM r WHERE k = 1""")
def bar_width(spark, sf_dir):
    return b.infer_bar_width(t.bars(spark, sf_dir), ["asset"])


@query(q.with_(q.BARS) + """, g AS (SELECT asset, date_diff('second', lag(ts) OVER (PARTITION BY asset ORDER BY ts), ts) AS s FROM bars)
SELECT asset, CAST(floor(365 * 86400 / median(s)) AS BIGINT) AS periods FROM g WHERE s IS NOT NULL GROUP BY asset""")
def periods_per_year(spark, sf_dir):
    return b.periods_per_year(t.bars(spark, sf_dir), ["asset"])


@query(q.with_(q.WEEK_FUNDING) + """SELECT asset, CAST(date_trunc('week', ts) AS TIMESTAMP) AS day, round(avg(funding_rate) * 3, 10) AS funding
FROM wfund GROUP BY 1, 2""")
def funding_panel(spark, sf_dir):
    return b.daily_funding(t.week_funding(spark, sf_dir), "1w").withColumn("funding", F.round("funding", 10))


@query(q.with_(q.BARS) + "SELECT asset, ts, close FROM bars WHERE ts + INTERVAL 1 day <= (SELECT max(ts) + INTERVAL 12 hour FROM bars)")
def closed_bars(spark, sf_dir):
    """Twelve hours into the newest day, which is still forming."""
    bars = t.bars(spark, sf_dir)
    newest = t.table(spark, sf_dir, "lineitem").agg((F.max("l_shipdate") + F.expr("INTERVAL 12 HOURS")).alias("now"))
    return b.drop_forming_bar(ec.attach_facts(bars, newest, []), "1 day", F.col("now")).select("asset", "ts", "close")
