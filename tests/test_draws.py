"""Random subsets by splitting counts, against exact distributions."""
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from barloom.operators import economics as ec


def quantile(size, left, drawn, u):
    total, below = math.comb(size, drawn), Fraction(0)
    for x in range(max(0, drawn - (size - left)), min(drawn, left) + 1):
        below += Fraction(math.comb(left, x) * math.comb(size - left, drawn - x), total)
        if below > u:
            return x
    return min(drawn, left)


def test_left_counts_are_hypergeometric_quantiles(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        size = rng.choice([1, 2, 7, 40, 900, 6000])
        rows.append((i % 3, i, size, rng.randint(0, size), rng.randint(0, size), rng.random()))
    df = spark.createDataFrame(rows, "k int, id int, size bigint, left bigint, drawn bigint, _u double")
    got = {r.id: r._x for r in ec.left_counts(df, ["k"]).collect()}
    assert got == {i: quantile(s, a, d, Fraction(u)) for _, i, s, a, d, u in rows}


def test_subset_sums_draw_every_subset_alike(spark):
    values = [0.0, 1.0, 1.0, 3.0, 7.0, 20.0]
    counts = spark.createDataFrame([("a", v, c) for v, c in Counter(values).items()] + [("b", 2.0, 5)], "k string, _v double, _c bigint")
    wanted = spark.createDataFrame([("a", 3, 6), ("b", 2, 5)], "k string, n_selected bigint, n_pool bigint")
    got = ec.subset_sums(counts, wanted, ["k"], 4000).collect()
    assert {r._sum for r in got if r.k == "b"} == {4.0} and len(got) == 8000
    from itertools import combinations

    exact = Counter(sum(c) for c in combinations(values, 3))
    seen = Counter(r._sum for r in got if r.k == "a")
    assert set(seen) == set(exact)
    for total, ways in exact.items():
        p = ways / 20
        assert abs(seen[total] - 4000 * p) < 4.5 * math.sqrt(4000 * p * (1 - p))


def test_permutation_of_returns_and_of_nothing(spark):
    rng = random.Random(5)
    rows = [("k", rng.gauss(0, 1) + (0.8 if i < 60 else 0), i < 60) for i in range(300)] + [("n", 1.0, None), ("n", None, False)]
    df = spark.createDataFrame(rows, "k string, v double, sel boolean")
    got = {r.k: r for r in ec.permutation_test(df, ["k"], F.col("v"), F.col("sel"), 200).collect()}
    assert got["k"].p_value == pytest.approx(1 / 201) and got["k"].n_selected == 60
    assert abs(got["k"].null_mean - sum(v for k, v, _ in rows if k == "k") / 300) < 0.03
    assert got["n"].n_selected == 0 and got["n"].p_value is None
    assert ec.permutation_test(df.limit(0), ["k"], F.col("v"), F.col("sel"), 10).collect() == []


def test_poisson_bootstrap_of_few_rows_skips_iterations_without_weight(spark):
    """One row weighs 0 in about every third iteration: no mean, and not counted."""
    df = spark.createDataFrame([("up", "x_1", 0.5), ("down", "y_1", -0.5), ("few", "z_1", 2.0), ("few", "z_2", -1.0)], "k string, trade_id string, v double")
    weights = {(r.k, r._it): r._w for r in ec.poisson_sums(df, ["k"], F.col("v"), 300).collect()}
    empty = {k: sum(w == 0 for (key, _), w in weights.items() if key == k) for k in ("up", "down", "few")}
    assert 80 < empty["up"] < 140 and 80 < empty["down"] < 140 and 20 < empty["few"] < 65
    got = {r.k: r.boot_p for r in ec.poisson_bootstrap_pvalue(df, ["k"], F.col("v"), 300).collect()}
    assert got["up"] == 1 / 301 and got["down"] == pytest.approx((300 - empty["down"] + 1) / 301)
    assert 1 / 301 < got["few"] < (300 - empty["few"] + 1) / 301


def test_reports_with_iterations_without_weight(spark):
    import datetime as dt
    rows = [(f"t_{i}", dt.datetime(2024, 1, 1 + i), i % 2, 0.1 * (1 + i)) for i in range(3)]
    df = spark.createDataFrame(rows, "trade_id string, ts timestamp_ntz, label int, ret double")
    folds = {r.fold: r.boot_p for r in ec.fold_stability(df, 3, 0.0, 300).collect()}
    assert folds == {f: 1 / 301 for f in range(4)}
    report = ec.selection_report(df, F.col("label") == 1, {"none": 0.0, "high": 1.0}, 2.0, 20, 300).collect()
    assert {r.cost_name: r.boot_p for r in report}["none"] == 1 / 301 and 0.4 < {r.cost_name: r.boot_p for r in report}["high"] < 0.8


def test_row_permutations_rank_every_row_of_every_iteration(spark):
    """Against ranking all draws, for a selection near the strip's middle, small ones and one row of two."""
    import hashlib

    def seven(text, i):
        return int(hashlib.md5(text.encode()).hexdigest()[7 * i:7 * i + 7], 16)

    rng, prime, n_iter = random.Random(8), (1 << 31) - 1, 60
    rows = [(k, f"{k}_{i}", float(rng.randint(0, 1)), i < sel) for k, n, sel in (("big", 400, 150), ("few", 30, 1), ("two", 2, 1), ("none", 5, 0), ("all", 4, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, trade_id string, v double, sel boolean")
    got = {r.k: r for r in ec.row_permutation_test(df, ["k"], F.col("v"), F.col("sel"), n_iter).collect()}
    for k in ("big", "few", "two"):
        own = [r for r in rows if r[0] == k]
        want, stat = sum(r[3] for r in own), sum(r[2] for r in own if r[3]) / sum(r[3] for r in own)
        means = []
        for it in range(1, n_iter + 1):
            r, t = seven(str(it), 0) + 1, seven(str(it), 1) + 1
            draw = lambda name: ((seven(name, 0) * r + seven(name, 1)) % prime << 31) + (seven(name, 2) * t + seven(name, 3)) % prime  # noqa: B023, E731
            means.append(sum(x[2] for x in sorted(own, key=lambda x: (draw(x[1]), x[1]))[:want]) / want)
        assert got[k].statistic == pytest.approx(stat) and got[k].null_mean == pytest.approx(sum(means) / n_iter)
        assert got[k].p_value == pytest.approx((sum(m >= stat for m in means) + 1) / (n_iter + 1))
    assert got["none"].p_value is None and got["all"].p_value is None and got["all"].n_selected == 4


def test_permutation_sql_draws_rows():
    from barloom.catalog import ENTRIES
    assert "row_number() OVER (PARTITION BY signal, it ORDER BY" in ENTRIES["permutation_test"].sql
