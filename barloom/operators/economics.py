"""Grouped trade economics and significance: one row per configuration."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import number_rows, scan, time_bucket
from barloom.functions.stats import (
    breakeven_win_rate, compounded_or_lost, kelly_size, log_factorial, profit_factor, sidak, wilson_bound)

from barloom.session import cut_lineage


def net_economics(trades: DataFrame, keys: list[str], cost: float | Column) -> DataFrame:
    """Trade count, win rate, profit factor and expectancy after a flat cost."""
    net = F.col("ret") - cost
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_wins"),
        F.avg("label").alias("win_rate"), profit_factor(net).alias("profit_factor"), F.avg(net).alias("expectancy"))


def per_cost(trades: DataFrame, costs: dict[str, float]) -> DataFrame:
    """Repeat trades for each named cost level."""
    levels = F.array(*[F.struct(F.lit(n).alias("cost_name"), F.lit(c).alias("cost")) for n, c in costs.items()])
    return trades.withColumn("_c", F.explode(levels)).select("*", "_c.cost_name", "_c.cost").drop("_c")


def binomial_tail(counts: DataFrame, keys: list[str], p_null: Column) -> DataFrame:
    """Exact P(X >= n_wins) for X ~ Binomial(n, p_null), per row of ``counts``.

    The tail terms are rows, so one configuration with many trades is summed
    by many tasks.
    """
    terms = counts.withColumn("_p", p_null).withColumn("_lf", log_factorial(F.col("n")))
    terms = spread_range(terms, F.col("n_wins"), F.col("n"), "_i")
    i, n, p = F.col("_i"), F.col("n"), F.col("_p")
    logged = F.col("_lf") - log_factorial(i) - log_factorial(n - i) + i * F.ln(p) + (n - i) * F.ln(1 - p)
    tail = terms.groupBy(*keys).agg(F.least(F.sum(F.exp(logged)), F.lit(1.0)).alias("p_value"))
    return counts.join(tail, keys, "left")


def spread_range(df: DataFrame, first: Column, last: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """One row per integer in [first, last], expanded chunk by chunk."""
    heads = df.withColumn("_head", F.explode(F.sequence(first, last, F.lit(chunk).cast("long"))))
    out = heads.withColumn(name, F.explode(F.sequence(
        F.col("_head"), F.least(F.col("_head") + chunk - 1, last))))
    return out.drop("_head")


def verdicts(counts: DataFrame, keys: list[str], payoff: float, cost: float = 0.0, tried: int = 1) -> DataFrame:
    """Win-rate test against breakeven, corrected for the variants tried."""
    base = counts.withColumn("breakeven", breakeven_win_rate(payoff, cost))
    tested = binomial_tail(base, keys, F.col("breakeven"))
    out = tested.select(
        *keys, "n", "n_wins", (F.col("n_wins") / F.col("n")).alias("win_rate"), "breakeven",
        wilson_bound(F.col("n_wins"), F.col("n"), False).alias("wilson_lo"),
        wilson_bound(F.col("n_wins"), F.col("n"), True).alias("wilson_hi"),
        "p_value", sidak(F.col("p_value"), tried).alias("p_deflated"))
    sure = F.col("p_deflated") < 0.05
    return out.withColumn(
        "verdict", F.when(F.col("n") == 0, "no trades").when(F.col("p_deflated").isNull(), "unknown")
        .when(sure & (F.col("wilson_lo") > F.col("breakeven")), "significant")
        .when(sure, "marginal (CI touches breakeven)").otherwise("NOT significant"))


# ---------------------------------------------------------------- resampling

#: Draws are whole numbers below 2 to this power; both halves are taken modulo a prime.
DRAW_BITS = 62
_PRIME = (1 << 31) - 1
#: Draws this many standard deviations around the expected cut are ranked one by one.
CUT_WIDTH = 8.0


def _seven(text: Column, first: int) -> Column:
    """Seven hexadecimal digits of the text's digest as a number."""
    return F.conv(F.substring(F.md5(text), first, 7), 16, 10).cast("long")


def row_seed(*parts: Column) -> Column:
    """Four numbers of 28 bits from a row's name; hashed once, whatever the number of iterations."""
    text = F.concat_ws("_", *[p.cast("string") for p in parts])
    return F.array(*[_seven(text, 1 + 7 * i) for i in range(4)])


def iterations(spark, n_iter: int) -> DataFrame:
    """_it and its two multipliers."""
    text = F.col("_it").cast("string")
    return spark.range(1, n_iter + 1).select(F.col("id").alias("_it")).select(
        "_it", (_seven(text, 1) + 1).alias("_r"), (_seven(text, 8) + 1).alias("_t"))


def draws_of(rows: DataFrame, n_iter: int) -> DataFrame:
    """Every row (with ``_seed``) once per iteration, with ``_h``: 62 bits, independent between rows.

    Pairs with the iterations' multipliers, which are one row per iteration and broadcast.
    """
    its = F.broadcast(iterations(rows.sparkSession, n_iter).withColumn("_one", F.lit(1)))
    seed = lambda i: F.col("_seed")[i]
    high, low = (seed(0) * F.col("_r") + seed(1)) % _PRIME, (seed(2) * F.col("_t") + seed(3)) % _PRIME
    paired = rows.withColumn("_one", F.lit(1)).join(its, "_one")
    return paired.withColumn("_h", high * F.lit(1 << 31) + low).drop("_one", "_seed", "_r", "_t")


def left_counts(draws: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``_x``: how many of ``drawn`` of ``size`` things fall among the first ``left`` of them, by the draw ``_u``.

    The count is hypergeometric. Its distribution is laid out once for each distinct (``by``, size, left, drawn),
    ten standard deviations to both sides of its mean, and every draw is placed in it as of ``_u``; so
    a case takes as many rows as its deviation, not as its size.
    """
    case = [*by, "size", "left", "drawn"]
    size, left, drawn = (F.col(c).cast("double") for c in ("size", "left", "drawn"))
    mean = drawn * left / size
    wide = 10 * F.sqrt(mean * (size - left) / size * (size - drawn) / F.greatest(size - 1, F.lit(1.0))) + 1
    lo = F.greatest(F.lit(0.0), drawn - (size - left), F.floor(mean - wide)).cast("long")
    hi = F.least(drawn, left, F.ceil(mean + wide)).cast("long")
    x = F.col("_x").cast("double")
    step = F.when(F.col("_x") == F.col("_lo"), 0.0).otherwise(F.log((left - x + 1) * (drawn - x + 1) / (x * (size - left - drawn + x))))
    upto, whole = Window.partitionBy(*case).orderBy("_x"), Window.partitionBy(*case)
    laid = draws.select(*case).distinct().withColumn("_lo", lo).withColumn("_x", F.explode(F.sequence("_lo", hi)))
    laid = laid.withColumn("_log", F.sum(step).over(upto))
    laid = laid.withColumn("_mass", F.exp(F.col("_log") - F.max("_log").over(whole)))
    start = F.coalesce(F.sum("_mass").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("_mass").over(whole)
    rest = [c for c in draws.columns if c not in case and c != "_u"]
    steps = laid.select(*case, start.alias("_u"), "_x", *[F.lit(None).cast(draws.schema[c].dataType).alias(c) for c in rest])
    both = steps.unionByName(draws.withColumn("_x", F.lit(None).cast("long")))
    order = whole.orderBy("_u", F.col("_x").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_found", F.last("_x", True).over(order)).filter("_x IS NULL").drop("_x").withColumnRenamed("_found", "_x")


def subset_sums(counts: DataFrame, wanted: DataFrame, keys: list[str], n_iter: int) -> DataFrame:
    """keys, _it, _sum: values of random subsets of fixed size, drawn without replacement.

    ``counts`` has (keys, _v, _c), one row per distinct value; ``wanted`` (keys, n_selected, n_pool). Each
    iteration's number of picks is split down a binary tree over the sorted values, so the cost is
    distinct values x iterations, whatever the number of rows: one count an iteration for 0/1 labels.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    leaves = cut_lineage(counts.withColumn("_leaf", place.cast("long")))
    most = leaves.agg(F.max("_leaf")).first()[0] or 0
    levels = int(most).bit_length()
    node = wanted.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(n_iter))).alias("_it"), F.lit(0).cast("long").alias("_node"),
                         F.col("n_pool").alias("size"), F.col("n_selected").alias("drawn"))
    for level in range(levels):
        first = leaves.groupBy(*keys, F.shiftright("_leaf", levels - level - 1).alias("_child")).agg(F.sum("_c").alias("left"))
        first = first.filter("_child % 2 = 0").withColumn("_node", (F.col("_child") / 2).cast("long")).drop("_child")
        met = node.join(first, [*keys, "_node"], "left").fillna(0, subset=["left"])
        u = (_digits(F.concat_ws("_", *[F.col(k).cast("string") for k in keys], "_it", F.lit(level), F.col("_node").cast("string"))) + 0.5) / float(1 << 52)
        split = left_counts(met.withColumn("_u", u), [*keys, "_node"])
        child = lambda right, count, n: F.struct((F.col("_node") * 2 + right).alias("_node"), n.alias("size"), count.alias("drawn"))
        parts = F.explode(F.array(child(0, F.col("_x"), F.col("left")), child(1, F.col("drawn") - F.col("_x"), F.col("size") - F.col("left"))))
        node = cut_lineage(split.select(*keys, "_it", parts.alias("_p")).select(*keys, "_it", "_p.*").filter("drawn > 0"))
    at = node.join(leaves.select(*keys, F.col("_leaf").alias("_node"), "_v"), [*keys, "_node"])
    return at.groupBy(*keys, "_it").agg(F.sum(F.col("_v") * F.col("drawn")).alias("_sum"))


def _digits(text: Column) -> Column:
    """The first 52 bits of a text's digest."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def row_sums(rows: DataFrame, wanted: DataFrame, keys: list[str], n_iter: int) -> DataFrame:
    """keys, _it, _sum: values of random subsets of fixed size, every row drawn anew in every iteration.

    ``rows`` has (keys, _seed, _id, _v), ``wanted`` (keys, n_selected, n_pool). An iteration takes the rows of the
    smallest draws. Where the cut falls is known within a few standard deviations: draws below that strip are
    summed, those inside it are ranked, and the rest is not touched. An iteration whose cut is outside the strip is
    ranked as a whole.
    """
    share = F.col("n_selected") / F.col("n_pool")
    slack = CUT_WIDTH * F.sqrt(share * (1 - share) / F.col("n_pool"))
    strip = wanted.select(*keys, F.col("n_selected").alias("_want"), ((share - slack) * 2.0 ** DRAW_BITS).alias("_lo"), ((share + slack) * 2.0 ** DRAW_BITS).alias("_hi"))
    placed = attach_facts(rows, strip, keys)
    part = [*keys, "_it"]
    near = draws_of(placed, n_iter).filter(F.col("_h") <= F.col("_hi"))
    inside = F.col("_h") >= F.col("_lo")
    below = cut_lineage(near.groupBy(*part).agg(
        F.count(F.when(~inside, 1)).alias("_n0"), F.coalesce(F.sum(F.when(~inside, F.col("_v"))), F.lit(0.0)).alias("_s0"),
        F.count(F.lit(1)).alias("_n1"), F.first("_want").alias("_want")))
    good = below.filter((F.col("_n0") <= F.col("_want")) & (F.col("_n1") >= F.col("_want")))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("_h", "_id"))
    ranked = near.filter(inside).select(*part, "_h", "_id", "_v").withColumn("_rank", rank)
    edge = (good.join(ranked, part, "left").groupBy(*part).agg(
        (F.first("_s0") + F.coalesce(F.sum(F.when(F.col("_rank") <= F.col("_want") - F.col("_n0"), F.col("_v"))), F.lit(0.0))).alias("_sum")))
    # An iteration without any row near the cut is missing from ``below`` as well.
    every = wanted.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_iter).cast("long"))).alias("_it"))
    missed = every.join(good.select(*part), part, "left_anti")
    whole = draws_of(placed, n_iter).join(missed, part).withColumn("_rank", rank)
    return edge.unionByName(whole.groupBy(*part).agg(F.coalesce(F.sum(F.when(F.col("_rank") <= F.col("_want"), F.col("_v"))), F.lit(0.0)).alias("_sum")))


def row_permutation_test(pool: DataFrame, keys: list[str], value: Column, selected: Column, n_iter: int = 10_000,
                         trade_id: str = "trade_id") -> DataFrame:
    """``permutation_test`` whose picks are drawn row by row, by a hash of ``trade_id`` and iteration."""
    rows = cut_lineage(pool.select(*keys, row_seed(F.col(trade_id)).alias("_seed"), F.col(trade_id).alias("_id"), value.cast("double").alias("_v"), selected.alias("_sel")))
    picks = lambda counts, wanted: row_sums(rows.drop("_sel"), wanted, keys, n_iter)
    return _permuted(rows.select(*keys, "_v", "_sel"), keys, F.col("_v"), F.col("_sel"), n_iter, picks)


def permutation_test(pool: DataFrame, keys: list[str], value: Column, selected: Column, n_iter: int = 10_000) -> DataFrame:
    """Does the selection beat random picks of the same size?

    The statistic is the selected rows' mean; each iteration takes as many rows of the pool at random. A null
    value counts as 0 in the picks. Without a selection, or if all is selected, the test's columns are null.
    """
    return _permuted(pool, keys, value, selected, n_iter, lambda counts, wanted: subset_sums(counts, wanted, keys, n_iter))


def _permuted(pool: DataFrame, keys: list[str], value: Column, selected: Column, n_iter: int, picks) -> DataFrame:
    """The test by the sums (keys, _it, _sum) that ``picks`` draws from the counts of values and the sizes wanted."""
    base = pool.select(*keys, value.cast("double").alias("_v"), F.coalesce(selected, F.lit(False)).alias("_sel"))
    counts = cut_lineage(base.groupBy(*keys, F.coalesce("_v", F.lit(0.0)).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col("_sel").cast("long")).alias("_s"), F.sum((F.col("_sel") & F.col("_v").isNotNull()).cast("long")).alias("_k")))
    seen = cut_lineage(counts.groupBy(*keys).agg(
        (F.sum(F.col("_v") * F.col("_k")) / F.when(F.sum("_k") > 0, F.sum("_k"))).alias("statistic"),
        F.sum("_s").alias("n_selected"), F.sum("_c").alias("n_pool")))
    real = (F.col("n_selected") > 0) & (F.col("n_selected") < F.col("n_pool"))
    sums = picks(counts.select(*keys, "_v", "_c"), seen.filter(real).select(*keys, "n_selected", "n_pool"))
    null = attach_facts(sums, seen.select(*keys, "n_selected", "statistic"), keys)
    null = null.withColumn("_mean", F.col("_sum") / F.col("n_selected"))
    summary = null.groupBy(*keys).agg(
        F.avg("_mean").alias("null_mean"), F.stddev_pop("_mean").alias("null_std"),
        F.percentile("_mean", 0.95).alias("null_p95"),
        ((F.sum((F.col("_mean") >= F.col("statistic")).cast("long")) + 1) / F.lit(float(n_iter + 1))).alias("p_value"))
    out = attach_facts(seen, summary, keys, how="left")
    return out.select(*keys, "n_selected", "n_pool", *[
        F.when(real, F.col(c)).alias(c) for c in ("statistic", "null_mean", "null_std", "null_p95", "p_value")])


def attach_facts(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-key results.

    With no keys ``small`` is a single row (a global aggregate), which is the
    one case that is broadcast by hand.
    """
    if keys:
        return df.join(small, keys, how)
    one = F.broadcast(small.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one", how).drop("_one")


def _bootstrap_p(means: DataFrame, keys: list[str], n_iter: int) -> DataFrame:
    """Share of means at or below zero; an iteration without a mean is none of them."""
    return means.groupBy(*keys).agg(
        ((F.count_if(F.col("_mean") <= 0) + 1) / F.lit(float(n_iter + 1))).alias("boot_p"),
        F.first("_n").alias("n"))


def bootstrap_mean_pvalue(values: DataFrame, keys: list[str], value: Column, n_iter: int = 5_000,
                          order: list[str] = ["ts", "trade_id"]) -> DataFrame:
    """Share of resampled means at or below zero, with replacement.

    Every row stands for one draw per iteration and points at a row number of its own
    group, so draws are spread over all tasks; sums are combined before they are shuffled
    where the values are few enough to be broadcast.
    """
    finite = values.select(*keys, *order, value.cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    finite = cut_lineage(finite)
    rows = cut_lineage(number_rows(finite, keys, order, time_bucket(F.col(order[0])), "_idx").select(*keys, "_idx", "_v"))
    sizes = finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    seeds = attach_facts(rows.select(*keys, row_seed(*[F.col(k) for k in keys], F.col("_idx")).alias("_seed")), sizes, keys)
    picks = draws_of(seeds, n_iter).select(*keys, "_n", "_it", F.pmod("_h", F.col("_n")).alias("_idx"))
    means = picks.join(rows, [*keys, "_idx"]).groupBy(*keys, "_n", "_it").agg((F.sum("_v") / F.col("_n")).alias("_mean"))
    return _bootstrap_p(means, keys, n_iter)


def poisson_sums(values: DataFrame, keys: list[str], value: Column, n_iter: int = 5_000, trade_id: str = "trade_id") -> DataFrame:
    """keys, _it, _sum, _w, _n: weighted sums, weights and rows of each iteration, by independent Poisson(1) weights of the rows.

    One aggregation, no join; weights come from a hash of row and iteration, so groups of the same rows can share them.
    In a group of few rows an iteration's weights may all be 0: take its mean by ``poisson_mean``.
    """
    steps, acc, k = [], 0.0, 0
    # As many steps as the resolution of the draw and of doubles can tell apart.
    while not steps or acc < 1.0 and acc + math.exp(-1.0) / math.factorial(k) > acc:
        acc += math.exp(-1.0) / math.factorial(k)
        steps.append(acc)
        k += 1
    finite = values.select(*keys, row_seed(F.col(trade_id)).alias("_seed"), value.cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    draws = draws_of(finite, n_iter).withColumn("_u", F.col("_h") / F.lit(2.0 ** DRAW_BITS))
    weight = sum((F.col("_u") >= s).cast("int") for s in steps)
    return draws.withColumn("_w", weight).groupBy(*keys, "_it").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("_sum"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"))


def poisson_mean() -> Column:
    """An iteration's weighted mean; null where all weights are 0."""
    return F.try_divide(F.col("_sum"), F.col("_w"))


def poisson_bootstrap_pvalue(values: DataFrame, keys: list[str], value: Column, n_iter: int = 5_000,
                             trade_id: str = "trade_id") -> DataFrame:
    """Bootstrap by Poisson weights, the form for very large groups: share of resampled means at or below zero."""
    sums = poisson_sums(values, keys, value, n_iter, trade_id)
    return _bootstrap_p(sums.withColumn("_mean", poisson_mean()), keys, n_iter)


# ---------------------------------------------------------------- runs and curves

POSITION_SLICE = 20_000


def position_slice(column: str = "pos") -> Column:
    return F.floor(F.col(column) / POSITION_SLICE).cast("long")


def trade_level_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """Contiguous same-sign runs of ``position`` are trades; statistics of their summed returns."""
    sign = F.signum(F.coalesce(F.col("position").cast("double"), F.lit(0.0)))
    signed = series.select(*keys, "pos", sign.alias("_s"), F.coalesce("strat_ret", F.lit(0.0)).alias("_r"))
    prev = scan(signed, keys, ["pos"], position_slice(), {"_prev": ("last", F.col("_s"))}, exclusive=True)
    starts = cut_lineage(prev.withColumn(
        "_start", ((F.col("_s") != 0) & (F.coalesce("_prev", F.lit(0.0)) != F.col("_s"))).cast("long")))
    numbered = scan(starts, keys, ["pos"], position_slice(), {"_trade": ("sum", F.col("_start"))})
    trades = numbered.filter("_s <> 0").groupBy(*keys, "_trade").agg(F.sum("_r").alias("_pnl"))
    pnl = F.col("_pnl")
    stats = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(pnl <= 0, pnl)), F.lit(0.0)).alias("avg_loss"),
        profit_factor(pnl).alias("profit_factor"))
    return series.select(*keys).distinct().join(stats, keys, "left").fillna(
        0, subset=["num_trades", "win_rate", "avg_win", "avg_loss", "profit_factor"])


def equity_curve(series: DataFrame, keys: list[str], ret: str, order: str, slice_by: Column) -> DataFrame:
    """Compounded curve, its running peak and the drawdown.

    Logs are summed, so long curves do not overflow on the way; from a loss of all or
    more on the curve is 0 and the drawdown -1.
    """
    r = F.col(ret)
    summed = cut_lineage(scan(series, keys, [order], slice_by, {
        "_log": ("sum", F.when(r > -1, F.log1p(r)).otherwise(0.0)), "_lost": ("max", (r <= -1).cast("int"))}))
    lost = F.coalesce(F.col("_lost"), F.lit(0)) == 1
    peaks = scan(summed, keys, [order], slice_by, {"_top": ("max", F.when(~lost, F.col("_log")))})
    return peaks.withColumns({
        "curve": F.when(lost, 0.0).otherwise(F.exp("_log")), "peak": F.coalesce(F.exp("_top"), F.lit(0.0)),
        "drawdown": F.when(lost, -1.0).otherwise(F.exp(F.col("_log") - F.col("_top")) - 1)}).drop("_log", "_lost", "_top")


def trade_list_summary(trades: DataFrame, keys: list[str], capital: float = 10_000.0,
                       fee: float = 0.0005, order: list[str] = ["ts", "trade_id"]) -> DataFrame:
    """P&L summary of (entry price, exit price, qty) lists.

    A sell is valued with the same sign as a buy, as the rule states it.
    """
    cost = F.col("qty") * F.col("price") * fee
    valued = trades.select(*keys, *order, cost.alias("_fee"),
                           (F.coalesce(F.col("exit_price"), F.col("price")) * F.col("qty")
                            - F.col("price") * F.col("qty") - cost).alias("_net"))
    by = time_bucket(F.col(order[0]))
    run = scan(valued, keys, order, by, {"_cum": ("sum", F.col("_net"))})
    run = scan(cut_lineage(run), keys, order, by, {"_peak": ("max", F.col("_cum"))})
    net = F.col("_net")
    down = (F.col("_peak") - F.col("_cum")) / (capital + F.col("_peak")) * 100
    return run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), (F.avg((net > 0).cast("double")) * 100).alias("win_rate"),
        F.coalesce(F.avg(F.when(net > 0, net)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(net <= 0, net)), F.lit(0.0)).alias("avg_loss"),
        F.sum(net).alias("total_pnl"), (F.sum(net) / capital * 100).alias("total_return_pct"),
        F.max(down).alias("max_drawdown_pct"), profit_factor(net).alias("profit_factor"),
        F.sum("_fee").alias("total_fees"), (F.sum("_fee") / capital * 100).alias("fee_drag_pct"))


def performance_report(series: DataFrame, keys: list[str], periods: Column) -> DataFrame:
    """Out-of-sample report of a strategy against holding the asset.

    ``series`` carries pos, position, strat_ret and ret_1d; ``periods`` is the
    number of bars per year.  Calmar counts bars as days.
    """
    curve = equity_curve(series, keys, "strat_ret", "pos", position_slice())
    r = F.col("strat_ret")
    share = lambda cond: F.avg(cond.cast("double"))
    agg = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), compounded_or_lost(r).alias("total_return"), compounded_or_lost(F.col("ret_1d")).alias("buy_hold_return"),
        (F.sqrt(F.first(periods)) * F.avg(r) / (F.stddev_samp(r) + 1e-9)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        (F.sum(F.when(r > 0, r).otherwise(0.0)) / (F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))) + 1e-9)).alias("profit_factor"),
        share(F.col("position") > 0).alias("long_share"), share(F.col("position") < 0).alias("short_share"),
        share(F.col("position") == 0).alias("flat_share"))
    annual = F.pow(1 + F.col("total_return"), 365.0 / F.greatest(F.col("n_bars"), F.lit(1))) - 1
    return agg.select(
        *keys, "n_bars", "total_return", "buy_hold_return",
        (F.col("total_return") - F.col("buy_hold_return")).alias("alpha"), "sharpe",
        F.coalesce(F.try_divide(annual, F.abs(F.col("max_drawdown"))), F.lit(0.0)).alias("calmar"), "max_drawdown",
        "profit_factor", "long_share", "short_share", "flat_share")


def kelly_summary(trades: DataFrame, keys: list[str], payoff: float, cost: float, scale: float = 0.5) -> DataFrame:
    """Kelly-sized economics of taken trades carrying ``p_win``."""
    sized = trades.withColumn("_size", kelly_size(F.col("p_win"), payoff, scale))
    sized = sized.withColumn("_net", F.col("ret") * F.col("_size") - F.col("_size") * cost)
    net = F.col("_net")
    return sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("label") == 1).cast("double")).alias("win_rate"),
        profit_factor(net).alias("profit_factor"), compounded_or_lost(net).alias("total_return"), F.avg(net).alias("avg_net_ret"),
        (F.avg("ret") / (F.avg(F.abs("ret")) + 1e-9)).alias("expectancy_r"))


def fold_stability(trades: DataFrame, n_folds: int, cost: float, n_iter: int = 5_000) -> DataFrame:
    """Economics and bootstrap p per equal-width calendar fold; the last edge belongs to the last fold.

    Fold 0 pools all trades and says how many folds have a positive expectancy and a profit factor above 1.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = trades.agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    at = attach_facts(trades, span, [])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_folds))
    fold = F.least(F.lit(n_folds), F.floor((micros - F.col("_lo")) / width) + 1).cast("int")
    both = at.withColumn("fold", F.explode(F.array(fold, F.lit(0))))
    rows = cut_lineage(net_economics(both, ["fold"], cost))
    # A trade's weights are the same in its fold and in the pool, so the pool's sums are those of its folds.
    sums = cut_lineage(poisson_sums(at.withColumn("fold", fold), ["fold"], F.col("ret") - cost, n_iter))
    pool = sums.groupBy(F.lit(0).alias("fold"), "_it").agg(*[F.sum(c).alias(c) for c in ("_sum", "_w", "_n")])
    boot = _bootstrap_p(sums.unionByName(pool).withColumn("_mean", poisson_mean()), ["fold"], n_iter)
    tested = rows.join(boot.select("fold", "boot_p"), "fold", "left")
    good = rows.filter("fold > 0").agg(F.count(F.when(F.col("expectancy") > 0, 1)).alias("_up"), F.count(F.when(F.col("profit_factor") > 1, 1)).alias("_won"))
    pooled = lambda c: F.when(F.col("fold") == 0, F.col(c))
    return attach_facts(tested, good, []).select(*rows.columns, "boot_p", pooled("_up").alias("positive_folds"), pooled("_won").alias("winning_folds"))


def selection_report(pool: DataFrame, selected: Column, costs: dict[str, float], payoff: float, n_permutations: int = 10_000,
                     n_resamples: int = 5_000) -> DataFrame:
    """Economics of a selection from ``pool`` (trade_id, ts, label, ret) at several costs, with its significance.

    The permutation test asks whether the selection beats random ones of its size, the bootstrap whether the mean
    after costs is above zero, corrected for the number of costs tried; rates are per day of the pool's span.
    """
    chosen = cut_lineage(pool.filter(selected))
    rows = net_economics(per_cost(chosen, costs), ["cost_name", "cost"], F.col("cost"))
    # A cost takes the same from every resampled mean, so all costs share the draws.
    sums = poisson_sums(chosen, [], F.col("ret"), n_resamples).withColumn("_gross", poisson_mean())
    boot = _bootstrap_p(per_cost(sums, costs).withColumn("_mean", F.col("_gross") - F.col("cost")), ["cost_name"], n_resamples).select("cost_name", "boot_p")
    days = pool.agg(F.greatest(F.floor((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 86_400_000_000),
                               F.lit(1)).alias("_days"))
    perm = permutation_test(pool.withColumn("g", F.lit("all")), ["g"], F.col("label"), selected, n_permutations).select(F.col("p_value").alias("perm_p"))
    out = attach_facts(attach_facts(rows.join(boot, "cost_name", "left"), perm, []), days, [])
    return out.select(
        "cost_name", "n", "n_wins", (F.col("n") / F.col("_days")).alias("per_day"), "win_rate", wilson_bound(F.col("n_wins"), F.col("n"), False).alias("wilson_lo"),
        wilson_bound(F.col("n_wins"), F.col("n"), True).alias("wilson_hi"), breakeven_win_rate(payoff, F.col("cost")).alias("breakeven"),
        "profit_factor", "expectancy", "perm_p", "boot_p", sidak(F.col("boot_p"), len(costs)).alias("boot_p_deflated"))


def fifo_round_trips(fills: DataFrame, fee: float = 0.001, order: list[str] = ["ts", "seq"],
                     cell_qty: float = 1000.0) -> DataFrame:
    """First-in-first-out matching of sells to earlier buys, as interval overlap.

    On the axis of bought quantity every buy owns ``(B - qty, B]``.  A sell
    consumes up to what is in stock, so total consumption is
    ``S + min(0, running min(B - S))``; its step is the interval the sell
    takes.  Both are cut into cells of ``cell_qty`` and meet on
    ``(asset, cell)``, so a busy asset is spread over its cells; choose the
    cell a few dozen times the usual lot.
    """
    by = time_bucket(F.col(order[0]))
    signed = fills.select(
        "asset", *order, "side", "price", "qty",
        F.when(F.col("side") == "buy", F.col("qty")).otherwise(0.0).alias("_in"),
        F.when(F.col("side") == "sell", F.col("qty")).otherwise(0.0).alias("_out"))
    run = scan(signed, ["asset"], order, by, {"_bought": ("sum", F.col("_in")), "_sold": ("sum", F.col("_out"))})
    gap = F.col("_bought") - F.col("_sold")
    run = scan(cut_lineage(run), ["asset"], order, by, {"_gap": ("min", gap), "_gap0": ("min", gap)}, exclusive=["_gap0"])
    run = run.withColumn("_used", F.col("_sold") + F.least(F.lit(0.0), F.col("_gap"))).withColumn(
        "_from", F.col("_sold") - F.col("_out") + F.least(F.lit(0.0), F.coalesce("_gap0", F.lit(0.0))))

    cell = F.lit(cell_qty)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long")))
    buys = run.filter("side = 'buy'").select(
        F.col("asset").alias("_ba"), F.col("price").alias("buy_price"),
        (F.col("_bought") - F.col("qty")).alias("_lo"), F.col("_bought").alias("_hi"))
    buys = buys.withColumn("_bc", cells(F.col("_lo"), F.col("_hi")))
    sells = run.filter("side = 'sell'").select("asset", *order, F.col("price").alias("sell_price"), "qty",
                                               "_from", F.col("_used").alias("_to"))
    sells = sells.withColumn("_c", cells(F.col("_from"), F.col("_to")))
    low = F.greatest(F.col("_lo"), F.col("_from"), F.col("_c") * cell)
    high = F.least(F.col("_hi"), F.col("_to"), (F.col("_c") + 1) * cell)
    met = sells.join(buys, (sells.asset == buys["_ba"]) & (sells["_c"] == buys["_bc"])
                     & (buys["_lo"] < sells["_to"]) & (buys["_hi"] > sells["_from"]))
    part = met.withColumn("_q", high - low).filter("_q > 0")
    gross = (F.col("sell_price") - F.col("buy_price")) * F.col("_q")
    paid = (F.col("buy_price") + F.col("sell_price")) * F.col("_q") * fee
    trips = part.groupBy("asset", *order).agg(
        F.sum(gross - paid).alias("pnl"), F.sum("_q").alias("matched"), F.first("qty").alias("qty"))
    # A sell only partly covered is skipped although the lots it took stay taken.
    return trips.filter(F.col("qty") - F.col("matched") <= 1e-9 * F.greatest(F.lit(1.0), F.col("qty"))).select("asset", *order, "qty", "pnl")


def round_trip_stats(trips: DataFrame, keys: list[str]) -> DataFrame:
    return trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        profit_factor(F.col("pnl")).alias("profit_factor"))
