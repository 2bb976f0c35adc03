"""Labels, fills, overlap, matching and gates on hand-made cases and loops."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.operators import economics as ec
from barloom.operators import gating as g
from barloom.operators import labels as lb
from barloom.operators import pairs as pr
from barloom.operators import portfolio as pf
from barloom.operators import splits as sp
from barloom.sources import market as m

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
KEYS = ["asset", "bar", "side"]


def path(spark, bars):
    return spark.createDataFrame([("A", i, float(h), float(l), float(c)) for i, (h, l, c) in enumerate(bars)],
                                 "asset string, bar long, high double, low double, close double")


def orders(spark, rows):
    return spark.createDataFrame([("A", b, s, float(c), float(a)) for b, s, c, a in rows],
                                 "asset string, bar long, side int, close double, atr double")


def label(spark, bars, rows, **kw):
    out = lb.triple_barrier(orders(spark, rows), path(spark, bars), KEYS, **kw)
    return {(r.bar, r.side): r for r in out.collect()}


def test_barrier_outcomes(spark):
    flat = (100.5, 99.5, 100)
    bars = [flat, (102.2, 99.6, 102), flat, (102.5, 98.5, 100), flat, (100.4, 98.7, 99.2), (100.2, 99.8, 100.1)]
    got = label(spark, bars, [(0, 1, 100, 1), (2, 1, 100, 1), (2, -1, 100, 1), (4, -1, 100, 1), (6, 1, 100.1, 1)],
                pt=2.0, sl=1.0, horizon=3)
    assert got[(0, 1)].label == 1 and got[(0, 1)].hold == 1 and got[(0, 1)].ret == pytest.approx(0.02)
    assert got[(2, 1)].label == 0 and got[(2, 1)].ret == pytest.approx(-0.01)      # both touched: stop
    assert got[(2, -1)].label == 0 and got[(2, -1)].ret == pytest.approx(-0.01)
    vertical = got[(4, -1)]
    assert vertical.hold == 2 and vertical.label == 0 and vertical.ret == pytest.approx(-0.001)
    last = got[(6, 1)]
    assert (last.hold, last.label, last.ret) == (0, 0, 0.0)


def test_limit_fill_then_label_from_fill(spark):
    bars = [(100.5, 99.9, 100), (100.6, 99.9, 100.2), (100.2, 99.7, 99.9), (102.3, 99.8, 102), (103, 101, 102)]
    fills = lb.limit_fills(orders(spark, [(0, 1, 100, 1), (3, 1, 102, 10)]), path(spark, bars), KEYS)
    got = {r.bar: r for r in fills.collect()}
    assert got[0].filled and got[0].wait_bars == 2 and got[0].limit_price == pytest.approx(99.85)
    assert not got[3].filled and got[3].fill_price is None
    lab = lb.triple_barrier_from_fill(fills, path(spark, bars), KEYS, 2.0, 1.0, 3).collect()
    assert len(lab) == 1 and lab[0].entry_pos == 2 and lab[0].exit_pos == 3 and lab[0].label == 1


def test_labels_equal_a_loop(spark):
    rng = np.random.default_rng(0)
    close = 100 + np.cumsum(rng.normal(0, 1, 300))
    bars = [(c + rng.uniform(0, 1.5), c - rng.uniform(0, 1.5), c) for c in close]
    rows = [(int(b), int(rng.choice([-1, 1])), close[b], 1.3) for b in range(0, 300, 3)]
    got = label(spark, bars, rows, pt=1.5, sl=1.0, horizon=9)
    for b, s, c, a in rows:
        up, dn = (c + 1.5 * a, c - a) if s > 0 else (c + a, c - 1.5 * a)
        want, hold = None, 0
        for j in range(b + 1, min(b + 9, 299) + 1):
            hold = j - b
            hu, hd = bars[j][0] >= up, bars[j][1] <= dn
            if hu or hd:
                want = 0 if (hu and hd) else int(hu == (s > 0))
                break
        if want is None:
            want = int(s * (bars[b + hold][2] / c - 1) > 0)
        assert (got[(b, s)].label, got[(b, s)].hold) == (want, hold)


@LOOSE
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 9)), min_size=1, max_size=60))
def test_non_overlap_equals_a_loop(spark, trades):
    rows = [("A", i, e, e + h) for i, (e, h) in enumerate(trades)]
    df = spark.createDataFrame(rows, "asset string, n long, entry_pos long, exit_pos long")
    got = {r.n for r in g.non_overlapping(df, reach=9, tie=["n"], slice_rows=16).collect()}
    busy, want = -1, set()
    for _, n, e, x in sorted(rows, key=lambda r: (r[2], r[1])):
        if e >= busy:
            want.add(n)
            busy = x
    assert got == want


@LOOSE
@given(st.lists(st.tuples(st.sampled_from(["buy", "sell"]), st.integers(1, 900), st.integers(1, 50)), min_size=1, max_size=40))
def test_fifo_equals_a_queue(spark, fills):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=20 * i), i, s, float(p), float(q))
            for i, (s, q, p) in enumerate(fills)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, seq long, side string, price double, qty double")
    got = {r.seq: r.pnl for r in ec.fifo_round_trips(df, fee=0.001).collect()}
    lots, want = [], {}
    for _, _, i, s, p, q in rows:
        if s == "buy":
            lots.append([p, q])
            continue
        left, pnl = q, 0.0
        while left > 1e-12 and lots:
            take = min(left, lots[0][1])
            pnl += (p - lots[0][0]) * take - (lots[0][0] + p) * take * 0.001
            left -= take
            lots[0][1] -= take
            if lots[0][1] <= 1e-12:
                lots.pop(0)
        if left <= 1e-12:
            want[i] = pnl
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@LOOSE
@given(st.lists(st.one_of(st.none(), st.floats(-6, 6)), min_size=1, max_size=60))
def test_hysteresis_equals_the_state_machine(spark, zs):
    df = spark.createDataFrame([("A", "B", i, z) for i, z in enumerate(zs)], "a string, b string, pos long, z double")
    got = pr.hysteresis_positions(df).orderBy("pos").collect()
    cur, stopped, want = 0, False, []
    for z in zs:
        if z is None:
            want.append(0)
            continue
        if stopped and abs(z) < 0.5:
            stopped = False
        elif stopped:
            cur = 0
        if not stopped:
            if abs(z) > 4:
                cur, stopped = 0, True
            elif z > 2:
                cur = -1
            elif z < -2:
                cur = 1
            elif abs(z) < 0.5:
                cur = 0
        want.append(cur)
    assert [r.position for r in got] == [0, *want[:-1]]


def test_gate_thresholds(spark):
    df = spark.createDataFrame([(0.55, 1.0, False), (0.55, 0.0, True), (0.55, None, False), (0.95, 0.0, True)],
                               "base double, al double, nv boolean")
    got = [r.t for r in df.select(g.effective_threshold(F.col("base"), F.col("al"), F.col("nv")).alias("t")).collect()]
    assert got == pytest.approx([0.53, 0.69, 0.63, 0.99])


@pytest.mark.parametrize("text,want", [
    ('{"decision": "Approve", "confidence": 0.7, "reason": "r"}', ("approve", 0.7, "r")),
    ('```json\n{"decision": "reject",\n"confidence": -2}\n```', ("reject", 0.0, "")),
    ("nothing", ("reject", 0.0, "unparseable response")), ("{oops", ("reject", 0.0, "unparseable response")),
    ('{"decision": 3, "confidence": "x"}', ("reject", 0.0, ""))])
def test_reply_parsing_fails_closed(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(g.parse_reply(F.col("t")).alias("r")).select("r.*")
    assert tuple(df.first()) == want


def test_permutation_bounds_and_degenerate_selection(spark):
    rows = [("k", f"t{i}", float(i % 2), i % 2 == 1 and i < 200) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, trade_id string, label double, sel boolean")
    r = ec.permutation_test(df, ["k"], F.col("label"), F.col("sel"), 60).first()
    assert r.n_selected == 100 and r.statistic == 1.0 and r.p_value == pytest.approx(1 / 61)
    assert abs(r.null_mean - 0.5) < 0.03
    none = ec.permutation_test(df, ["k"], F.col("label"), F.lit(False), 20).first()
    assert none.p_value is None and none.n_selected == 0


def test_bootstrap_separates_clear_means(spark):
    rng = np.random.default_rng(1)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"{k}{i}", float(v))
            for k, mu in (("up", 0.5), ("flat", 0.0)) for i, v in enumerate(rng.normal(mu, 1, 200))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, trade_id string, v double")
    for fn in (ec.bootstrap_mean_pvalue, ec.poisson_bootstrap_pvalue):
        got = {r.k: r.boot_p for r in fn(df, ["k"], F.col("v"), 100).collect()}
        assert got["up"] < 0.02 < got["flat"] < 0.99


def test_binomial_tail_and_profit_factor(spark):
    from math import comb
    df = spark.createDataFrame([("a", 60, 40), ("b", 30, 5)], "k string, n long, n_wins long")
    got = {r.k: r.p_value for r in ec.binomial_tail(df, ["k"], F.lit(0.5)).collect()}
    for k, n, w in (("a", 60, 40), ("b", 30, 5)):
        assert got[k] == pytest.approx(sum(comb(n, i) for i in range(w, n + 1)) / 2 ** n, rel=1e-9)
    trades = spark.createDataFrame([("win", 0.02, 1), ("zero", 0.0, 0), ("mix", 0.03, 1), ("mix", -0.01, 0)], "k string, ret double, label int")
    pf_ = {r.k: r.profit_factor for r in ec.net_economics(trades, ["k"], 0.0).collect()}
    assert pf_["win"] == float("inf") and pf_["zero"] == 0.0 and pf_["mix"] == pytest.approx(3.0)


def test_book_costs_and_ladder(spark):
    days = pd.date_range("2024-01-01", periods=6)
    rows = [(d.to_pydatetime(), a, p) for i, d in enumerate(days) for a, p in (("A", 100 * 1.1 ** i), ("B", 100.0), ("C", 100 * 0.9 ** i), ("D", 100.0))]
    ix = pf.index_days(spark.createDataFrame(rows, "day timestamp_ntz, asset string, close double"))
    book = pf.long_short_book(pf.momentum(ix, 1), 1)
    pnl = pf.backtest_book(ix, book, 0.001).orderBy("day").collect()
    assert len(pnl) == 5 and pnl[0].turnover == 0 and pnl[1].gross == 0
    assert pnl[2].turnover == pytest.approx(1.0) and pnl[2].gross == pytest.approx(0.5 * 0.1 + 0.5 * 0.1)
    assert pnl[3].turnover == pytest.approx(0.0)
    thin = pf.long_short_book(pf.momentum(ix, 1), 3)
    assert thin.count() == 0
    ladder = pf.overlap_rebalance(book, 3).filter("d = 3").toPandas().set_index("asset").w
    assert ladder["A"] == pytest.approx(2 / 6) and ladder["C"] == pytest.approx(-2 / 6)


def test_fold_edges_purge(spark):
    rows = [(f"t{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "trade_id string, ts timestamp_ntz, label int")
    folded = sp.assign_folds(df, sp.fold_edges(df, 4, 10 * 86400.0), min_train=85).toPandas()
    assert set(folded.fold) == {1, 2, 3}
    for _, f in folded.groupby("fold"):
        train, test = f[f.role == "train"], f[f.role == "test"]
        assert (test.ts.min() - train.ts.max()).days > 10 and len(test) == 100


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="missing columns"):
        m.require_columns(spark.range(1), ["close"], "bars")


def test_bars_files_round_trip(spark, make_bars, tmp_path):
    bars = make_bars({"A": [(1, 2, 0.5, 1.5, 10)] * 3, "B": [(2, 3, 1, 2, 5)] * 2}).drop("pos")
    m.write_result(bars, str(tmp_path / "csv"), fmt="csv")
    back = m.read_bars(spark, str(tmp_path / "csv"))
    assert back.count() == 5 and back.schema["ts"].dataType.simpleString() == "timestamp_ntz"
    m.write_result(bars, str(tmp_path / "pq"), partition_by=["asset"])
    assert spark.read.parquet(str(tmp_path / "pq")).filter("asset = 'B'").count() == 2


def test_replies_that_are_not_one_strict_object_reject(spark):
    replies = ["{'decision': 'approve', 'confidence': 0.9}", '{"decision": "approve", "confidence": 0.9} {"decision": "approve"}',
               '{"decision": "approve", "confidence": 0.9}, {"a": 1}', '{"decision": "approve",}']
    for text in replies:
        r = spark.createDataFrame([(text,)], "t string").select(g.parse_reply(F.col("t")).alias("r")).select("r.*").first()
        assert (r.decision, r.confidence, r.reason) == ("reject", 0.0, "unparseable response")
    for value, want in (('"nan"', 0.0), ('"0.9d"', 0.0), ('" 0.25 "', 0.25), ("7", 1.0), ("-1", 0.0), ("true", 0.0), ("null", 0.0)):
        text = '{"decision": " Approve", "confidence": %s}' % value
        r = spark.createDataFrame([(text,)], "t string").select(g.parse_reply(F.col("t")).alias("r")).select("r.*").first()
        assert (r.decision, r.confidence) == ("approve", want)


def test_late_funding_moves_features_and_path_alike(spark, make_bars):
    from barloom.operators import features as ft

    rows = [(10 + i % 7, 12 + i % 7, 9 + i % 7, 11 + i % 7 + i / 1000, 5.0 + i % 3) for i in range(260)]
    bars = make_bars({"A": rows}).withColumn("funding_rate", F.when(F.col("pos") >= 200, F.col("pos") / 1000.0))
    frame = {r.bar: r.close for r in ft.features(bars, balance=False).select("bar", "close").collect()}
    path = {r.bar: r.close for r in ft.usable_path(bars).select("bar", "close").collect()}
    assert frame[0] == rows[204][3] and frame == path
