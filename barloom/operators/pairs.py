"""Pair research: alignment, hedge, screens, positions and returns.

Pairs of a universe are many, their series short relative to raw data, so the
keys are (pair, position) and (pair, slice); nothing orders one pair globally
except through the scans.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import number_rows, scan, time_bucket
from barloom.operators.economics import position_slice
from barloom.session import cut_lineage

PAIR = ["a", "b"]
# Fixed value: 10% critical value of the two-variable residual unit-root test.
CRITICAL_10 = -3.0445
MIN_ROWS = 30


def align_pairs(prices: DataFrame, share: float = 0.8) -> DataFrame:
    """Every unordered pair on its common timestamps: (a, b, ts, x, y, pos, n, in_sample).

    The self join meets on the timestamp, whose group is the universe of one
    moment, not the history of an asset.
    """
    left = prices.select("ts", F.col("asset").alias("a"), F.col("close").alias("x"))
    right = prices.select("ts", F.col("asset").alias("b"), F.col("close").alias("y"))
    both = cut_lineage(left.join(right, "ts").filter("a < b"))
    counts = both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_ROWS)
    placed = number_rows(both, PAIR, ["ts"], time_bucket(F.col("ts"), 365)).join(counts, PAIR)
    return cut_lineage(placed.withColumn("in_sample", F.col("pos") < F.floor(F.col("n") * share)))


def hedge_ratio(pairs: DataFrame) -> DataFrame:
    """Least-squares slope and intercept of x on y over the in-sample rows."""
    return pairs.filter("in_sample").groupBy(*PAIR).agg(
        F.regr_slope("x", "y").alias("beta"), F.regr_intercept("x", "y").alias("alpha"))


PAIR_SLICE = 20_000


def sliced_pairs(rows: DataFrame, back: int) -> tuple[DataFrame, str]:
    """Pair series cut into runs of positions, each preceded by ``back`` copied rows."""
    if back > PAIR_SLICE:
        raise ValueError("the look-back must fit in one slice")
    copies = f"""array_compact(array(
        named_struct('s', floor(pos / {PAIR_SLICE}), 'own', true),
        CASE WHEN pos % {PAIR_SLICE} >= {PAIR_SLICE - back} THEN named_struct('s', floor(pos / {PAIR_SLICE}) + 1, 'own', false) END))"""
    laid = rows.withColumn("_c", F.explode(F.expr(copies)))
    return laid.select(*rows.columns, F.col("_c.s").alias("_s"), F.col("_c.own").alias("_own")), \
        "PARTITION BY a, b, _s ORDER BY pos"


def rolling_hedge(pairs: DataFrame, n: int = 60) -> DataFrame:
    """Least-squares slope over the last ``n`` rows."""
    laid, frame = sliced_pairs(pairs, n)
    window = f"({frame} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    slope = f"CASE WHEN pos >= {n - 1} THEN covar_pop(x, y) OVER {window} / var_pop(y) OVER {window} END"
    return laid.withColumn("beta", F.expr(slope)).filter("_own").drop("_s", "_own")


def with_spread(pairs: DataFrame) -> DataFrame:
    """Adds ``spread = x - beta*y`` from the in-sample hedge."""
    return pairs.join(hedge_ratio(pairs).select(*PAIR, "beta"), PAIR).withColumn(
        "spread", F.col("x") - F.col("beta") * F.col("y"))


def with_previous(rows: DataFrame, column: str, alias: str) -> DataFrame:
    """Value at the previous position, by equi-join on the position."""
    before = rows.select(*PAIR, (F.col("pos") + 1).alias("pos"), F.col(column).alias(alias))
    return rows.join(before, [*PAIR, "pos"], "left")


def cointegration_screen(pairs: DataFrame, critical: float = CRITICAL_10) -> DataFrame:
    """Residual unit-root statistic with no lags against a fixed critical value.

    Stage one regresses x on y; stage two regresses the change of the residual
    on its level (no intercept) and compares the t-value.
    """
    rows = pairs.filter("in_sample")
    fit = hedge_ratio(pairs)
    residual = rows.join(fit, PAIR).select(*PAIR, "pos", (F.col("x") - F.col("alpha") - F.col("beta") * F.col("y")).alias("e"))
    lagged = with_previous(residual, "e", "e0").filter("e0 is not null").withColumn("de", F.col("e") - F.col("e0"))
    sums = lagged.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("e0") * F.col("de")).alias("sxy"),
        F.sum(F.col("e0") * F.col("e0")).alias("sxx"), F.sum(F.col("de") * F.col("de")).alias("syy"))
    slope = F.col("sxy") / F.col("sxx")
    variance = (F.col("syy") - slope * F.col("sxy")) / (F.col("m") - 1)
    return sums.select(*PAIR, "m", (slope / F.sqrt(variance / F.col("sxx"))).alias("t_stat")).withColumn(
        "cointegrated", F.col("t_stat") < critical)


def hurst_doubled(pairs: DataFrame, longest: int = 100) -> DataFrame:
    """Twice the slope of ln std(lagged difference) on ln lag, lags 2..longest-1.

    The standard deviation is used as it is, so the value is twice the usual
    exponent.  The spread is scaled by the ratio of means.
    """
    rows = pairs.filter("in_sample")
    means = rows.groupBy(*PAIR).agg((F.avg("x") / F.avg("y")).alias("_r"))
    series = rows.join(means, PAIR).select(*PAIR, "pos", (F.col("x") - F.col("y") * F.col("_r")).alias("s"))
    lags = range(2, longest)
    laid, frame = sliced_pairs(series, longest)
    moves = laid.selectExpr(*PAIR, "_own", *[f"s - lag(s, {k}) OVER ({frame}) AS d{k}" for k in lags])
    taus = moves.filter("_own").groupBy(*PAIR).agg(*[F.stddev_pop(f"d{k}").alias(f"d{k}") for k in lags])
    points = taus.select(*PAIR, F.explode(F.array(*[
        F.struct(F.lit(math.log(k)).alias("k"), F.col(f"d{k}").alias("tau")) for k in lags])).alias("_p"))
    return points.filter("_p.tau > 0").groupBy(*PAIR).agg(
        (F.regr_slope(F.ln("_p.tau"), F.col("_p.k")) * 2.0).alias("hurst2"))


def half_life_window(spreads: DataFrame, default: int = 30) -> DataFrame:
    """Adaptive look-back from the half-life of the in-sample spread.

    Sample covariance over population variance, as the rule states it.
    """
    lagged = with_previous(spreads.select(*PAIR, "pos", "n", "in_sample", "spread"), "spread", "s0")
    used = lagged.filter("in_sample and s0 is not null")
    fit = used.groupBy(*PAIR).agg(
        (F.covar_samp("s0", F.col("spread") - F.col("s0")) / (F.var_pop("s0") + 1e-9)).alias("slope"),
        F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    wide = F.greatest(F.lit(10), F.floor(2 * (-math.log(2) / F.col("slope"))))
    window = F.when((F.col("m") > 10) & (F.col("slope") < 0),
                    F.least(wide, F.least(F.floor(F.col("n") / 4), F.lit(120)))).otherwise(default)
    return fit.select(*PAIR, "slope", window.cast("int").alias("window"))


def spread_zscore(spreads: DataFrame, windows: DataFrame) -> DataFrame:
    """z-score over each pair's own look-back.

    A look-back that differs per pair is not a frame literal.  Running sums of
    the centred spread at both ends of the window give its mean and variance,
    so every row meets exactly one earlier row whatever the look-back.
    """
    centre = spreads.groupBy(*PAIR).agg(F.avg("spread").alias("_c"))
    lean = cut_lineage(spreads.join(centre, PAIR).join(windows.select(*PAIR, "window"), PAIR)
                       .withColumn("_v", F.col("spread") - F.col("_c")))
    sums = cut_lineage(scan(lean, PAIR, ["pos"], position_slice(),
                            {"_s1": ("sum", F.col("_v")), "_s2": ("sum", F.col("_v") * F.col("_v"))}))
    before = sums.select(*PAIR, (F.col("pos") + F.col("window")).alias("pos"),
                         F.col("_s1").alias("_b1"), F.col("_s2").alias("_b2"))
    joined = sums.join(before, [*PAIR, "pos"], "left")
    n = F.col("window")
    s1, s2 = F.col("_s1") - F.coalesce("_b1", F.lit(0.0)), F.col("_s2") - F.coalesce("_b2", F.lit(0.0))
    spread = F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))
    z = F.when(F.col("pos") >= n - 1, F.try_divide(F.col("_v") - s1 / n, spread))
    return joined.withColumn("z", z).drop("_c", "_v", "_s1", "_s2", "_b1", "_b2")


def hysteresis_positions(scores: DataFrame, keys: list[str] = PAIR, entry: float = 2.0, leave: float = 0.5,
                         stop: float = 4.0) -> DataFrame:
    """Position from z-scores: enter beyond ``entry``, leave inside ``leave``, sit out after a stop.

    Two last-known-value scans: the stop flag first, then the position given
    the flag.  The traded position lags one row.
    """
    z = F.col("z")
    stops = scan(scores, keys, ["pos"], position_slice(), {"_stopped": ("last", F.when(F.abs(z) > stop, True).when(
        F.abs(z) < leave, False))})
    flagged = cut_lineage(stops.withColumn("_stopped", F.coalesce("_stopped", F.lit(False))))
    event = (F.when(z.isNull(), None).when(F.col("_stopped"), 0).when(z > entry, -1).when(z < -entry, 1)
             .when(F.abs(z) < leave, 0))
    held = scan(flagged, keys, ["pos"], position_slice(), {"_held": ("last", event)})
    now = F.when(z.isNull(), 0).otherwise(F.coalesce("_held", F.lit(0)))
    placed = cut_lineage(held.withColumn("signal_position", now).drop("_held"))
    before = placed.select(*keys, (F.col("pos") + 1).alias("pos"), F.col("signal_position").alias("position"))
    return placed.join(before, [*keys, "pos"], "left").withColumn(
        "position", F.coalesce("position", F.lit(0))).withColumnRenamed("_stopped", "stopped")


def pair_returns(rows: DataFrame, cost: float) -> DataFrame:
    """Net return of both legs out of sample; an inherited position pays its entry."""
    held = rows.select(*PAIR, "pos", "ts", "n", "in_sample", "x", "y", "position")
    before = held.select(*PAIR, (F.col("pos") + 1).alias("pos"), F.col("x").alias("_x0"), F.col("y").alias("_y0"),
                         F.col("position").alias("_p0"), F.col("in_sample").alias("_was_in"))
    joined = held.join(before, [*PAIR, "pos"], "left").filter("not in_sample")
    first = F.col("_was_in") | F.col("_was_in").isNull()
    leg = (F.col("x") / F.col("_x0") - 1) - (F.col("y") / F.col("_y0") - 1)
    moved = F.when(first, F.abs("position")).otherwise(F.abs(F.col("position") - F.col("_p0")))
    gross = F.when(first, F.lit(0.0)).otherwise(F.col("position") * leg)
    return joined.select(*PAIR, "pos", "ts", "position", (gross - 2 * moved * cost).alias("strat_ret"))
