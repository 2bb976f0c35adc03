"""Model scores to decisions: thresholds, novelty, positions, blends."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import back_rows, own_rows, scan, shifted, slice_bars
from barloom.operators.economics import attach_facts, position_slice
from barloom.session import cut_lineage


def score_counts(scored: DataFrame, keys: list[str], score: str = "p_win", label: str = "label") -> DataFrame:
    """Trades and wins per distinct score."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("long")).alias("_w"))


def score_quantile(counts: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear-interpolated score quantile from counts per distinct score."""
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = scan(counts, keys, ["score"], F.floor(F.col("score") * 1000).cast("long"), {"_upto": ("sum", F.col("_c"))})
    at = (F.col("_n") - 1) * q
    placed = attach_facts(ranked, total, keys)
    value_at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("score")))
    ends = placed.groupBy(*keys, "_n").agg(
        value_at(F.floor(at)).alias("_lo"), value_at(F.least(F.floor(at) + 1, F.col("_n") - 1)).alias("_hi"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))).alias("cut"))


def top_quantile_precision(scored: DataFrame, keys: list[str], q: float = 0.8, min_support: int = 10) -> DataFrame:
    """Win rate among the most confident scores; 0 when too few."""
    counts = cut_lineage(score_counts(scored, keys))
    joined = attach_facts(counts, score_quantile(counts, keys, q), keys).filter(F.col("score") >= F.col("cut"))
    n = F.sum("_c")
    return joined.groupBy(*keys).agg(
        n.alias("support"), F.when(n >= min_support, F.sum("_w") / n).otherwise(0.0).alias("precision"))


def calibrate_threshold(scored: DataFrame, keys: list[str], target: float = 0.65, min_trades: int = 30,
                        fallback: float = 0.8) -> DataFrame:
    """Lowest score whose precision at or above it reaches ``target`` on enough trades.

    Works on counts per distinct score; without a qualifying score the
    ``fallback`` quantile is returned with ``target_met = false``.
    """
    counts = cut_lineage(score_counts(scored, keys))
    down = scan(counts.withColumn("_neg", -F.col("score")), keys, ["_neg"],
                F.floor(F.col("_neg") * 1000).cast("long"), {"_n": ("sum", F.col("_c")), "_win": ("sum", F.col("_w"))})
    fits = down.filter((F.col("_win") / F.col("_n") >= target) & (F.col("_n") >= min_trades))
    best = fits.groupBy(*keys).agg(F.min("score").alias("_t"))
    cut = attach_facts(score_quantile(counts, keys, fallback), best, keys, "left").select(
        *keys, F.coalesce("_t", "cut").alias("threshold"), F.col("_t").isNotNull().alias("target_met"))
    above = attach_facts(counts, cut, keys).filter(F.col("score") >= F.col("threshold"))
    return above.groupBy(*keys, "threshold", "target_met").agg(
        F.sum("_c").alias("n_trades"), (F.sum("_w") / F.sum("_c")).alias("precision"))


def threshold_table(scored: DataFrame, start: float = 0.40, step: float = 0.05, rows: int = 10) -> DataFrame:
    """Trades, win rate and share admitted at a ladder of thresholds."""
    ladder = F.explode(F.array(*[F.lit(round(start + i * step, 3)) for i in range(rows)]))
    counts = score_counts(scored, [])
    laid = counts.withColumn("threshold", ladder)
    over = F.col("score") >= F.col("threshold")
    n = F.sum(F.when(over, F.col("_c")).otherwise(0))
    return laid.groupBy("threshold").agg(
        n.alias("n_trades"), F.try_divide(F.sum(F.when(over, F.col("_w")).otherwise(0)), n).alias("win_rate"),
        (n / F.sum("_c")).alias("pct_of_candidates"))


# ---------------------------------------------------------------- novelty

def leaf_support(train: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Mean training occupancy of the leaves a row visits, as a share of training rows.

    Leaf counts are one row per (tree, leaf): bounded by the model, not by the data.
    """
    occupancy = train.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("_k"))
    size = train.agg(F.count_distinct(row_id).alias("_train"), F.count_distinct("tree").alias("_trees"))
    seen = rows.join(occupancy, ["tree", "leaf"], "left").groupBy(row_id).agg(
        F.sum(F.coalesce("_k", F.lit(0))).alias("_sum"))
    return attach_facts(seen, size, []).select(row_id, (F.col("_sum") / (F.col("_trees") * F.col("_train"))).alias("support"))


def novelty(train: DataFrame, rows: DataFrame, rare_percentile: float = 10.0, row_id: str = "row_id") -> DataFrame:
    """Support, novelty score and flag of every row against the training leaves."""
    own = leaf_support(train, train, row_id)
    scale = own.agg(F.percentile("support", rare_percentile / 100.0).alias("_cut"),
                    F.greatest(F.max("support"), F.lit(1e-12)).alias("_ref"))
    scored = attach_facts(leaf_support(train, rows, row_id), scale, [])
    return scored.select(
        row_id, "support", F.least(F.greatest(1.0 - F.col("support") / F.col("_ref"), F.lit(0.0)), F.lit(1.0)).alias("score"),
        (F.col("support") < F.col("_cut")).alias("is_novel"))


# ---------------------------------------------------------------- positions

def positions_from_probability(series: DataFrame, confidence: float = 0.55, window: int = 500,
                               max_position: float = 1.0, min_size: float = 0.2) -> DataFrame:
    """Two-class scores to lagged positions and sizes.

    ``p_up`` is standardised against its trailing window and cut at the normal
    quantile of ``confidence``; shorts are blocked at or above the 50-bar average.
    """
    cut = NormalDist().inv_cdf(min(max(confidence, 0.5001), 0.9999))
    least = max(30, window // 5)
    trailing = back_rows(window)
    laid = slice_bars(series, back=window + 1)
    enough = f"count(p_up) OVER {trailing} >= {least}"
    z = laid.selectExpr("*", f"CASE WHEN {enough} THEN try_divide(p_up - avg(p_up) OVER {trailing},"
                             f" stddev_samp(p_up) OVER {trailing}) END AS _z",
                        f"CASE WHEN pos >= 49 THEN avg(close) OVER {back_rows(50)} END AS _sma")
    blocked = "coalesce(close >= _sma, false)"
    size = f"least(greatest(least(greatest(abs(_z) / {2 * cut!r}D, 0D), 1D), {min_size}D), {max_position}D)"
    raw = z.selectExpr(
        "*", f"CASE WHEN _z >= {cut!r}D THEN 1D WHEN _z <= {-cut!r}D AND NOT {blocked} THEN -1D ELSE 0D END AS _p")
    raw = raw.selectExpr("*", f"CASE WHEN _p <> 0 THEN {size} ELSE 0D END AS _w")
    return own_rows(raw.selectExpr(
        *[f"`{c}`" for c in series.columns], "slice", "own", f"coalesce({shifted('_p')}, 0D) AS position",
        f"coalesce({shifted('_w')}, 0D) AS size"))


def positions_from_three_classes(series: DataFrame, confidence: float = 0.55, max_position: float = 1.0) -> DataFrame:
    """Up/flat/down scores to lagged positions with half-Kelly sizes."""
    laid = slice_bars(series, back=51).selectExpr("*", f"CASE WHEN pos >= 49 THEN avg(close) OVER {back_rows(50)} END AS _sma")
    edge = lambda p: f"least(greatest((2 * {p} - 1) / 2, 0D), {max_position}D, 1D)"
    raw = laid.selectExpr("*", f"""CASE WHEN p_up >= {confidence}D AND p_up > p_down THEN 1D
        WHEN p_down >= {confidence}D AND p_down > p_up AND NOT coalesce(close >= _sma, false) THEN -1D ELSE 0D END AS _p""")
    raw = raw.selectExpr("*", f"CASE WHEN _p > 0 THEN {edge('p_up')} WHEN _p < 0 THEN {edge('p_down')} ELSE 0D END AS _w")
    return own_rows(raw.selectExpr(
        *[f"`{c}`" for c in series.columns], "slice", "own", f"coalesce({shifted('_p')}, 0D) AS position",
        f"coalesce({shifted('_w')}, 0D) AS size"))


def positions_from_labels(series: DataFrame, max_position: float = 1.0) -> DataFrame:
    """Hard 0/1 predictions: 0 means short, always full size, traded on the next bar."""
    laid = slice_bars(series, back=1)
    side = "CASE WHEN prediction = 0 THEN -1D ELSE CAST(prediction AS DOUBLE) END"
    return own_rows(laid.selectExpr(
        *[f"`{c}`" for c in series.columns], "slice", "own", f"coalesce({shifted(f'({side})')}, 0D) AS position",
        f"CASE WHEN {shifted('pos')} IS NULL THEN 0D ELSE {max_position}D END AS size"))


def position_returns(series: DataFrame, cost: float) -> DataFrame:
    """Net return of held positions; a change of weight pays ``cost``."""
    laid = slice_bars(series, back=1).selectExpr("*", "position * size AS weighted")
    out = laid.selectExpr("*", f"abs(coalesce(weighted - {shifted('weighted')}, 0D)) AS traded")
    return own_rows(out.selectExpr("*", f"weighted * coalesce(ret_1d, 0D) - traded * {cost!r}D AS strat_ret"))


def cumulative_return(series: DataFrame, keys: list[str], ret: str = "strat_ret") -> DataFrame:
    """Compounded curve of a return column."""
    return scan(series, keys, ["pos"], position_slice(), {"cum_ret": ("product", 1 + F.col(ret))})


def blend_returns(series: DataFrame, third: bool = False) -> DataFrame:
    """Mix a trend and a range return stream by trend strength.

    The weight rises from 0 to 1 as the lagged ADX goes from 20 to 40; returns
    are halved while the lagged volatility ratio exceeds 2.
    """
    weight = F.least(F.greatest((F.col("adx_prior") - 20) / 20, F.lit(0.0)), F.lit(1.0))
    mixed = weight * F.col("trend_ret") + (1 - weight) * F.col("range_ret")
    if third:
        mixed = 0.3 * F.coalesce("pair_ret", F.lit(0.0)) + 0.7 * mixed
    laid = slice_bars(series, back=1).withColumn(
        "_vol", F.coalesce(F.lag("vol_regime").over(Window.partitionBy("asset", "slice").orderBy("pos")), F.lit(1.0)))
    return own_rows(laid.withColumn("weight", weight).withColumn(
        "blend_ret", mixed * F.when(F.col("_vol") > 2.0, 0.5).otherwise(1.0)).drop("_vol"))
