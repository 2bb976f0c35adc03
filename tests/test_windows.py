"""Sliding and session windows: late ticks, merged sessions, nulls and empty input."""
import datetime as dt

from barloom.streaming import ticks as st

SCHEMA = "asset string, ts timestamp_ntz, price double, qty double, seq long"


def at(text):
    return None if text is None else dt.datetime.fromisoformat(f"2024-01-01 {text}")


def frame(spark, ticks):
    return spark.createDataFrame([(a, at(x), float(p), 1.0, i) for i, (a, x, p) in enumerate(ticks)], SCHEMA)


def stream_of(spark, folder, *files):
    for ticks in files:
        frame(spark, ticks).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted((r.asset, r.ts.strftime("%H:%M"), r.ends.strftime("%H:%M"), r.open, r.high, r.low, r.close, r.n_ticks) for r in df.collect())


def test_late_tick_merges_sessions_until_the_watermark(spark, tmp_path):
    files = [[("A", "00:10", 2), ("A", "00:00", 1), ("A", "00:50", 3), ("B", "00:05", 7)],
             [("A", "00:30", 9), ("A", "05:00", 4)],     # joins both sessions of A; then the watermark is 04:00
             [("A", "05:10", 6)],                        # emits what 04:00 has closed
             [("A", "00:20", 50), ("A", "12:00", 5)]]    # 00:20 is too late: dropped
    got = st.run_to_table(st.session_bars(stream_of(spark, str(tmp_path / "in"), *files), "25 minutes"))
    assert rows(got) == [("A", "00:00", "01:15", 1, 9, 1, 3, 4), ("A", "05:00", "05:35", 4, 6, 4, 6, 2),
                         ("B", "00:05", "00:30", 7, 7, 7, 7, 1)]


def test_sliding_windows_close_with_the_watermark(spark, tmp_path):
    files = [[("A", "02:10", 2)], [("A", "03:10", 3), ("A", "07:30", 4)], [("A", "07:40", 4)], [("A", "02:50", 50), ("A", "12:00", 5)]]
    got = st.run_to_table(st.sliding_bars(stream_of(spark, str(tmp_path / "in"), *files), "2 hours", "1 hour"))
    assert rows(got) == [("A", "01:00", "03:00", 2, 2, 2, 2, 1), ("A", "02:00", "04:00", 2, 3, 2, 3, 2),
                         ("A", "03:00", "05:00", 3, 3, 3, 3, 1), ("A", "06:00", "08:00", 4, 4, 4, 4, 2),
                         ("A", "07:00", "09:00", 4, 4, 4, 4, 2)]


def test_batch_sessions_of_pauses_ties_and_nulls(spark):
    # A pause of exactly the gap does not split; ticks of one moment are ordered by their number.
    ticks = frame(spark, [("A", "01:00", 1), ("A", "01:20", 2), ("A", "01:20", 3), ("A", "01:41", 4), (None, "01:00", 9), ("A", None, 9)])
    assert rows(st.session_bars(ticks, "20 minutes")) == [("A", "01:00", "01:40", 1, 3, 1, 3, 3), ("A", "01:41", "02:01", 4, 4, 4, 4, 1)]
    assert st.session_bars(ticks.limit(0), "20 minutes").count() == 0
    assert st.sliding_bars(ticks.limit(0), "2 hours", "1 hour").count() == 0
