"""Registered queries: significance, curves, splits and score-based decisions."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.catalog.pairs import PAIR_RETURNS, net_pair_returns
from barloom.catalog.signals import ADX, rounded
from barloom.catalog.trades import (
    _CONV, _SC, KEYS, RULES, conviction_trades, labelled, labelled_sql, scored_trades)
from barloom.functions.series import own_rows
from barloom.functions.stats import sidak
from barloom.operators import calibration as cal
from barloom.operators import economics as ec
from barloom.operators import features as ft
from barloom.operators import gating as g
from barloom.operators import splits as sp
from barloom.session import cut_lineage
from barloom.sources import tables as t

_LAB = labelled_sql(RULES)
_COUNTS = "cnt AS (SELECT signal, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins FROM lab GROUP BY signal)"
_BE = "(1 / 3.0::DOUBLE + 0.004 / 3.0::DOUBLE)"
_TAIL = f"""tail AS (SELECT signal, least(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_BE}) + (n - i) * ln(1 - {_BE}))), 1) AS p
  FROM (SELECT signal, n, unnest(range(n_wins, n + 1)) AS i FROM cnt) GROUP BY signal)"""
_WILSON = q.WILSON


def win_counts(spark, sf_dir):
    trades = labelled(spark, sf_dir)
    return trades.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_wins"))


@query(q.with_(_LAB, _COUNTS, _TAIL, recursive=True) + f"""SELECT signal, n, n_wins, round(n_wins / n::DOUBLE, 9) AS win_rate, round({_BE}, 9) AS breakeven,
  round(least(greatest({_WILSON.format(s='-')}, 0), 1), 8) AS wilson_lo, round(least(greatest({_WILSON.format(s='+')}, 0), 1), 8) AS wilson_hi,
  round(p, 7) AS p_value, round(1 - (1 - p) ** 5, 7) AS p_deflated,
  CASE WHEN 1 - (1 - p) ** 5 < 0.05 AND {_WILSON.format(s='-')} > {_BE} THEN 'significant'
       WHEN 1 - (1 - p) ** 5 < 0.05 THEN 'marginal (CI touches breakeven)' ELSE 'NOT significant' END AS verdict
FROM cnt JOIN tail USING (signal)""")
def significance_verdicts(spark, sf_dir):
    """Binomial tail, Wilson bounds, breakeven, correction and verdict per rule."""
    counts = cut_lineage(win_counts(spark, sf_dir))
    out = ec.verdicts(counts, ["signal"], payoff=2.0, cost=0.004, tried=5)
    return rounded(out, win_rate=9, breakeven=9, wilson_lo=8, wilson_hi=8, p_value=7, p_deflated=7)


_PERMUTATIONS, _RESAMPLES = q.PERMUTATIONS, 5_000
_SEVEN = "('0x' || substr(md5({}), {}, 7))::BIGINT"
_ITS = "its AS (SELECT it, {} + 1 AS r, {} + 1 AS t FROM range(1, {{}}) x(it))".format(_SEVEN.format("it::VARCHAR", 1), _SEVEN.format("it::VARCHAR", 8))


def _seeded(name: str) -> str:
    """Four numbers of a row's name."""
    return ", ".join(f"{_SEVEN.format(name, 1 + 7 * i)} AS s{i}" for i in range(4))


_DRAW = "(((s0 * r + s1) % 2147483647) * 2147483648 + (s2 * t + s3) % 2147483647)"


null_means = q.null_means


@query(q.with_(_SC, recursive=True) + f""", pool AS (SELECT signal, trade_id, label, p_win >= 0.7 AS sel FROM scored),
facts AS (SELECT signal, avg(label) FILTER (WHERE sel) AS stat, count(*) FILTER (WHERE sel) AS n_selected, count(*) AS n_pool FROM pool GROUP BY signal),
{_ITS.format(_PERMUTATIONS + 1)}, sp AS (SELECT *, {_seeded("trade_id")} FROM pool),
dr AS (SELECT signal, it, label, row_number() OVER (PARTITION BY signal, it ORDER BY {_DRAW}, trade_id) AS rk FROM sp, its),
nul AS (SELECT signal, it, avg(label) AS m FROM dr JOIN facts USING (signal) WHERE rk <= n_selected GROUP BY signal, it)
SELECT signal, n_selected, n_pool, round(any_value(stat), 9) AS statistic, round(avg(m), 8) AS null_mean, round(stddev_pop(m), 8) AS null_std,
  round(quantile_cont(m, 0.95), 8) AS null_p95, round((count(*) FILTER (WHERE m >= stat) + 1) / {_PERMUTATIONS + 1}.0::DOUBLE, 9) AS p_value
FROM nul JOIN facts USING (signal) GROUP BY signal, n_selected, n_pool""")
def permutation_test(spark, sf_dir):
    trades = scored_trades(spark, sf_dir)
    out = ec.row_permutation_test(trades, ["signal"], F.col("label"), F.col("p_win") >= 0.7, _PERMUTATIONS)
    return rounded(out, statistic=9, null_mean=8, null_std=8, null_p95=8, p_value=9)


@query(q.with_(_SC, recursive=True) + f""", v AS (SELECT signal, ret - 0.0008 AS v, row_number() OVER (PARTITION BY signal ORDER BY ts, trade_id) - 1 AS idx,
    count(*) OVER (PARTITION BY signal) AS n FROM scored),
{_ITS.format(_RESAMPLES + 1)}, sv AS (SELECT *, {_seeded("signal || '_' || idx")} FROM v),
d AS (SELECT signal, n, it, {_DRAW} % n AS pick FROM sv, its),
m AS (SELECT d.signal, d.n, d.it, sum(v.v) / any_value(d.n) AS mean FROM d JOIN v ON v.signal = d.signal AND v.idx = d.pick GROUP BY d.signal, d.n, d.it)
SELECT signal, n, round((count(*) FILTER (WHERE mean <= 0) + 1) / {_RESAMPLES + 1}.0::DOUBLE, 9) AS boot_p FROM m GROUP BY signal, n""")
def bootstrap_mean(spark, sf_dir):
    trades = labelled(spark, sf_dir).withColumn("trade_id", F.concat_ws("_", *KEYS[:2], F.col("bar").cast("string")))
    return rounded(ec.bootstrap_mean_pvalue(trades, ["signal"], F.col("ret") - 0.0008, _RESAMPLES), boot_p=9)


def poisson_means(source: str, key: str, value: str) -> str:
    """boot (key, boot_p) by Poisson weights of the rows of ``source`` (key, trade_id, label, ret)."""
    return f"""steps AS (SELECT list(c ORDER BY k) AS s FROM (SELECT k, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM range(0, 20) r(k))),
bits AS (SELECT it, {_SEVEN.format("it::VARCHAR", 1)} + 1 AS r, {_SEVEN.format("it::VARCHAR", 8)} + 1 AS t FROM range(1, {_RESAMPLES + 1}) x(it)),
seeded AS (SELECT {key}, {value} AS v, {_seeded("trade_id")} FROM {source}),
weighted AS (SELECT {key}, it, v, len(list_filter(s, lambda x: {_DRAW} / 4611686018427387904.0::DOUBLE >= x)) AS w FROM seeded, bits, steps),
boot AS (SELECT {key}, (count(*) FILTER (WHERE mean <= 0) + 1) / {_RESAMPLES + 1}.0::DOUBLE AS boot_p
  FROM (SELECT {key}, it, sum(v * w) / sum(w) AS mean FROM weighted GROUP BY ALL) GROUP BY {key})"""


@query(q.with_(_SC, recursive=True) + f""", steps AS (SELECT list(c ORDER BY k) AS s FROM (SELECT k, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM range(0, 20) r(k))),
{_ITS.format(_RESAMPLES + 1)}, sv AS (SELECT *, {_seeded("trade_id")} FROM scored),
d AS (SELECT signal, it, ret - 0.0008 AS v, {_DRAW} / 4611686018427387904.0::DOUBLE AS u FROM sv, its),
w AS (SELECT d.*, len(list_filter(s, lambda x: u >= x)) AS w FROM d, steps),
m AS (SELECT signal, it, sum(v * w) / sum(w) AS mean, count(*) AS n FROM w GROUP BY ALL)
SELECT signal, n, round((count(*) FILTER (WHERE mean <= 0) + 1) / {_RESAMPLES + 1}.0::DOUBLE, 9) AS boot_p FROM m GROUP BY signal, n""")
def bootstrap_mean_poisson(spark, sf_dir):
    trades = labelled(spark, sf_dir).withColumn("trade_id", F.concat_ws("_", *KEYS[:2], F.col("bar").cast("string")))
    return rounded(ec.poisson_bootstrap_pvalue(trades, ["signal"], F.col("ret") - 0.0008, _RESAMPLES), boot_p=9)


@query(q.with_(_LAB, _COUNTS, _TAIL, recursive=True) + "SELECT signal, k, round(1 - (1 - p) ** k, 7) AS p_deflated FROM tail, (VALUES (1), (5), (20)) v(k)")
def deflated_pvalues(spark, sf_dir):
    counts = cut_lineage(win_counts(spark, sf_dir))
    tails = ec.binomial_tail(counts, ["signal"], F.lit(1 / 3.0) + F.lit(0.004 / 3.0))
    return tails.withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20)))).select(
        "signal", "k", F.round(sidak(F.col("p_value"), F.col("k")), 7).alias("p_deflated"))


# Positions from a repeatable score on bars.
_P = "(('0x' || substr(md5(asset || '_' || pos), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"
_CUT = repr(NormalDist().inv_cdf(0.9))
POSITIONS = f"""pr AS (SELECT asset, ts, pos, close, close / {q.lag('close')} - 1 AS ret_1d, {_P} AS p_up,
    CASE WHEN pos >= 49 THEN avg(close) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sma FROM bars),
zs AS (SELECT *, CASE WHEN count(*) OVER w >= 40 THEN (p_up - avg(p_up) OVER w) / nullif(stddev_samp(p_up) OVER w, 0) END AS z FROM pr
  WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
p0 AS (SELECT *, CASE WHEN z >= {_CUT}::DOUBLE THEN 1.0::DOUBLE WHEN z <= -{_CUT}::DOUBLE AND NOT coalesce(close >= sma, FALSE) THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM zs),
p1 AS (SELECT *, CASE WHEN p <> 0 THEN greatest(least(abs(z) / (2 * {_CUT}::DOUBLE), 1), 0.2) ELSE 0 END AS s FROM p0),
posn AS (SELECT *, coalesce({q.lag('p')}, 0) AS position, coalesce({q.lag('s')}, 0) AS size FROM p1),
pnl0 AS (SELECT *, position * size AS weighted FROM posn),
pnl AS (SELECT *, weighted * coalesce(ret_1d, 0) - abs(coalesce(weighted - {q.lag('weighted')}, 0)) * 0.002 AS strat_ret FROM pnl0)"""


def scored_bars(spark, sf_dir):
    bars = t.numbered_bars(spark, sf_dir)
    return bars.select("asset", "ts", "pos", "close", t.unit_draw(F.col("asset"), F.col("pos")).alias("p_up"))


def position_series(spark, sf_dir):
    """Positions, sizes and net returns from the repeatable score."""
    from barloom.functions.series import change, own_rows, slice_bars

    bars = own_rows(slice_bars(scored_bars(spark, sf_dir), back=1).selectExpr("*", f"{change('close')} AS ret_1d"))
    held = cal.positions_from_probability(bars, confidence=0.9, window=200)
    return cal.position_returns(held, cost=0.002)


@query(q.with_(q.BARS, POSITIONS) + "SELECT asset, pos, position, round(size, 8) AS size FROM posn")
def positions_from_scores(spark, sf_dir):
    out = cal.positions_from_probability(scored_bars(spark, sf_dir), confidence=0.9, window=200)
    return rounded(out.select("asset", "pos", "position", "size"), size=8)


_D = "(('0x' || substr(md5(asset || '_' || pos || '_d'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"


@query(q.with_(q.BARS, POSITIONS) + f""", c AS (SELECT *, p_up AS pu, (1 - p_up) * {_D} AS pd FROM pr),
k AS (SELECT *, CASE WHEN pu >= 0.55 AND pu > pd THEN 1.0::DOUBLE WHEN pd >= 0.55 AND pd > pu AND NOT coalesce(close >= sma, FALSE) THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM c),
k2 AS (SELECT *, CASE WHEN p > 0 THEN least(greatest((2 * pu - 1) / 2, 0), 1) WHEN p < 0 THEN least(greatest((2 * pd - 1) / 2, 0), 1) ELSE 0 END AS s FROM k)
SELECT asset, pos, coalesce({q.lag('p')}, 0) AS position, round(coalesce({q.lag('s')}, 0), 8) AS size FROM k2""")
def positions_three_classes(spark, sf_dir):
    rows = scored_bars(spark, sf_dir).withColumn(
        "p_down", (1 - F.col("p_up")) * t.unit_draw(F.col("asset"), F.col("pos"), F.lit("d")))
    return rounded(cal.positions_from_three_classes(rows).select("asset", "pos", "position", "size"), size=8)


@query(q.with_(q.BARS, POSITIONS) + f"""SELECT asset, pos, coalesce({q.lag('CASE WHEN p_up >= 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END')}, 0) AS position,
  CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS size FROM pr""")
def positions_hard_labels(spark, sf_dir):
    rows = scored_bars(spark, sf_dir).withColumn("prediction", (F.col("p_up") >= 0.5).cast("int"))
    return cal.positions_from_labels(rows).select("asset", "pos", "position", "size")


_LOGS = """lg AS (SELECT *, sum(CASE WHEN strat_ret > -1 THEN ln(1 + strat_ret) ELSE 0 END) OVER w AS l, max(CAST(strat_ret <= -1 AS INT)) OVER w AS lost
  FROM pnl WINDOW w AS (PARTITION BY asset ORDER BY pos))"""


@query(q.with_(q.BARS, POSITIONS, _LOGS) + """SELECT asset, pos, round(strat_ret, 7) AS strat_ret,
  round(CASE WHEN lost = 1 THEN 0 ELSE exp(l) END, 6) AS cum_ret FROM lg""")
def position_pnl(spark, sf_dir):
    """Bar returns and their curve, which a loss of all ends at 0."""
    out = ec.equity_curve(position_series(spark, sf_dir), ["asset"], "strat_ret", "pos", ec.position_slice())
    return rounded(out.select("asset", "pos", "strat_ret", F.col("curve").alias("cum_ret")), strat_ret=7, cum_ret=6)


@query(q.with_(q.BARS, POSITIONS) + """, f AS (SELECT *, sign(position) AS sg, lag(sign(position)) OVER (PARTITION BY asset ORDER BY pos) AS psg FROM pnl),
r AS (SELECT *, sum(CASE WHEN sg <> 0 AND coalesce(psg, 0) <> sg THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY pos) AS tid FROM f),
t AS (SELECT asset, tid, sum(strat_ret) AS pnl FROM r WHERE sg <> 0 GROUP BY asset, tid)
SELECT asset, count(*) AS num_trades, round(avg(CAST(pnl > 0 AS INT)), 9) AS win_rate, round(coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0), 7) AS avg_win,
  round(coalesce(avg(pnl) FILTER (WHERE pnl <= 0), 0), 7) AS avg_loss,
  round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / abs(sum(pnl) FILTER (WHERE pnl <= 0)), 6) AS profit_factor FROM t GROUP BY asset""")
def trade_level_stats(spark, sf_dir):
    out = ec.trade_level_stats(position_series(spark, sf_dir), ["asset"])
    return rounded(out, win_rate=9, avg_win=7, avg_loss=7, profit_factor=6)


@query(q.with_(q.BARS, POSITIONS, _LOGS) + """, pk AS (SELECT *, max(CASE WHEN lost = 0 THEN l END) OVER (PARTITION BY asset ORDER BY pos) AS top FROM lg),
a AS (SELECT asset, count(*) AS n_bars, CASE WHEN max(lost) = 1 THEN -1.0::DOUBLE ELSE exp(sum(ln(1 + strat_ret)) FILTER (WHERE strat_ret > -1)) - 1 END AS total,
  last(close ORDER BY pos) / first(close ORDER BY pos) - 1 AS hold, sqrt(365) * avg(strat_ret) / (stddev_samp(strat_ret) + 1e-9) AS sharpe,
  min(CASE WHEN lost = 1 THEN -1.0::DOUBLE ELSE exp(l - top) - 1 END) AS mdd,
  coalesce(sum(strat_ret) FILTER (WHERE strat_ret > 0), 0) / (abs(coalesce(sum(strat_ret) FILTER (WHERE strat_ret < 0), 0)) + 1e-9) AS pf,
  avg(CAST(position > 0 AS INT)) AS ls, avg(CAST(position < 0 AS INT)) AS ss, avg(CAST(position = 0 AS INT)) AS fs FROM pk GROUP BY asset)
SELECT asset, n_bars, round(total, 6) AS total_return, round(hold, 6) AS buy_hold_return, round(total - hold, 6) AS alpha, round(sharpe, 6) AS sharpe,
  round(coalesce(((1 + total) ** (365.0::DOUBLE / n_bars) - 1) / nullif(abs(mdd), 0), 0), 6) AS calmar, round(mdd, 7) AS max_drawdown,
  round(pf, 6) AS profit_factor, round(ls, 8) AS long_share, round(ss, 8) AS short_share, round(fs, 8) AS flat_share FROM a""")
def performance_report(spark, sf_dir):
    """Every column of the report on the returns as they are."""
    series = position_series(spark, sf_dir).withColumn("ret_1d", F.coalesce("ret_1d", F.lit(0.0)))
    out = ec.performance_report(series, ["asset"], F.lit(365))
    return rounded(out, total_return=6, buy_hold_return=6, alpha=6, sharpe=6, calmar=6, max_drawdown=7, profit_factor=6,
                   long_share=8, short_share=8, flat_share=8)


@query(q.with_(_SC, recursive=True) + """, k AS (SELECT *, least(greatest(0.5 * (p_win - (1 - p_win) / 2.0), 0), 1) AS size FROM scored),
n AS (SELECT *, ret * size - size * 0.004 AS net FROM k)
SELECT signal, count(*) AS n_trades, round(avg(label), 9) AS win_rate,
  round(coalesce(sum(net) FILTER (WHERE net > 0), 0) / abs(sum(net) FILTER (WHERE net <= 0)), 6) AS profit_factor,
  round(CASE WHEN min(net) <= -1 THEN -1 ELSE exp(sum(ln(1 + net)) FILTER (WHERE net > -1)) - 1 END, 6) AS total_return,
  round(avg(net), 7) AS avg_net_ret, round(avg(ret) / (avg(abs(ret)) + 1e-9), 7) AS expectancy_r FROM n GROUP BY signal""")
def kelly_summary(spark, sf_dir):
    out = ec.kelly_summary(scored_trades(spark, sf_dir), ["signal"], 2.0, 0.004)
    return rounded(out, win_rate=9, profit_factor=6, total_return=6, avg_net_ret=7, expectancy_r=7)


@query(q.with_(_CONV, recursive=True) + f""", pool AS (SELECT *, 'all' AS g, score >= 0.6 AS sel, asset || '_' || signal || '_' || bar AS trade_id FROM scd),
c AS (SELECT *, 'taker' AS cost_name, 0.004::DOUBLE AS cost FROM pool WHERE sel UNION ALL SELECT *, 'maker', 0.0008::DOUBLE FROM pool WHERE sel),
e AS (SELECT cost_name, any_value(cost) AS cost, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins, avg(label) AS wr, coalesce(sum(ret - cost) FILTER (WHERE ret > cost), 0) AS w,
  coalesce(sum(ret - cost) FILTER (WHERE ret <= cost), 0) AS l, avg(ret - cost) AS x FROM c GROUP BY cost_name),
days AS (SELECT greatest(date_diff('day', min(ts), max(ts)), 1) AS days FROM pool),
{null_means("g")},
pm AS (SELECT (count(*) FILTER (WHERE m >= stat) + 1) / {_PERMUTATIONS + 1}.0::DOUBLE AS perm_p FROM nul JOIN facts USING (g)),
{poisson_means("c", "cost_name", "ret - cost")}
SELECT cost_name, n, n_wins, round(n / days::DOUBLE, 8) AS per_day, round(wr, 8) AS win_rate, round(least(greatest({_WILSON.format(s='-')}, 0), 1), 8) AS wilson_lo,
  round(least(greatest({_WILSON.format(s='+')}, 0), 1), 8) AS wilson_hi, round(1 / 3.0::DOUBLE + cost / 3.0::DOUBLE, 9) AS breakeven,
  round(w / abs(l), 7) AS profit_factor, round(x, 7) AS expectancy, round(perm_p, 8) AS perm_p, round(boot_p, 9) AS boot_p, round(1 - (1 - boot_p) ** 2, 8) AS boot_p_deflated
FROM e JOIN boot USING (cost_name), pm, days""")
def selection_economics(spark, sf_dir):
    """A ranked selection at two costs: rate per day, interval, breakeven, permutation and bootstrap tests."""
    pool = cut_lineage(conviction_trades(spark, sf_dir).select(*KEYS, "ts", "label", "ret", "score"))
    tagged = pool.withColumn("trade_id", F.concat_ws("_", "asset", "signal", F.col("bar").cast("string")))
    out = ec.selection_report(tagged, F.col("score") >= 0.6, {"taker": 0.004, "maker": 0.0008}, 2.0, _PERMUTATIONS, _RESAMPLES)
    return rounded(out, per_day=8, win_rate=8, wilson_lo=8, wilson_hi=8, breakeven=9, profit_factor=7, expectancy=7, perm_p=8, boot_p=9, boot_p_deflated=8)


@query(q.with_(_LAB, recursive=True) + f""", s AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM lab),
one AS (SELECT lab.*, asset || '_' || signal || '_' || bar AS trade_id, least(6, CAST(floor((epoch_us(ts) - lo) / ((hi - lo) / 6.0::DOUBLE)) AS INT) + 1) AS fold, ret - 0.0008 AS net FROM lab, s),
f AS (SELECT * FROM one UNION ALL SELECT * REPLACE (0 AS fold) FROM one),
e AS (SELECT fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins, avg(label) AS wr,
  coalesce(sum(net) FILTER (WHERE net > 0), 0) / abs(sum(net) FILTER (WHERE net <= 0)) AS pf, avg(net) AS x FROM f GROUP BY fold),
{poisson_means("f", "fold", "net")},
up AS (SELECT count(*) FILTER (WHERE x > 0) AS up, count(*) FILTER (WHERE pf > 1) AS won FROM e WHERE fold > 0)
SELECT fold, n, n_wins, round(wr, 9) AS win_rate, round(pf, 7) AS profit_factor, round(x, 7) AS expectancy, round(boot_p, 9) AS boot_p,
  CASE WHEN fold = 0 THEN up END AS positive_folds, CASE WHEN fold = 0 THEN won END AS winning_folds FROM e JOIN boot USING (fold), up""")
def fold_stability(spark, sf_dir):
    """Folds, and all of them together as fold 0 with the number of folds that are positive."""
    trades = labelled(spark, sf_dir).withColumn("trade_id", F.concat_ws("_", *KEYS[:2], F.col("bar").cast("string")))
    trades = cut_lineage(trades.select("trade_id", "ts", "label", "ret"))
    return rounded(ec.fold_stability(trades, 6, 0.0008, _RESAMPLES), win_rate=9, profit_factor=7, expectancy=7, boot_p=9)


# Fills: returned items are sells.
_FILLS = """fills AS (SELECT asset, ts, row_number() OVER (PARTITION BY asset, ts ORDER BY l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS seq,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, price, qty FROM ticks)"""


def fills(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("asset", "ts").orderBy("seq"))
    return t.ticks(spark, sf_dir).select(
        "asset", "ts", rank.alias("seq"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        "price", "qty")


_FIFO = q.with_(q.TICKS, _FILLS) + """, c AS (SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) OVER w AS b, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) OVER w AS s
  FROM fills WINDOW w AS (PARTITION BY asset ORDER BY ts, seq)),
u AS (SELECT *, s + least(0, min(b - s) OVER (PARTITION BY asset ORDER BY ts, seq)) AS used FROM c),
v AS (SELECT *, coalesce(lag(used) OVER (PARTITION BY asset ORDER BY ts, seq), 0) AS frm FROM u),
m AS (SELECT s.asset, s.ts, s.seq, s.qty, s.price AS sp, b.price AS bp, least(b.b, s.used) - greatest(b.b - b.qty, s.frm) AS q
  FROM v s JOIN v b ON s.asset = b.asset AND s.side = 'sell' AND b.side = 'buy' AND b.b > s.frm AND b.b - b.qty < s.used),
trips AS (SELECT asset, ts, seq, qty, sum((sp - bp) * q - (bp + sp) * q * 0.001) AS pnl FROM m GROUP BY ALL HAVING qty - sum(q) <= 1e-9)
"""


@query(_FIFO + "SELECT asset, ts, seq, qty, round(pnl, 2) AS pnl FROM trips")
def fifo_round_trips(spark, sf_dir):
    return rounded(ec.fifo_round_trips(fills(spark, sf_dir)), pnl=2)


@query(_FIFO + """SELECT asset, count(*) AS num_trades, round(avg(CAST(pnl > 0 AS INT)), 9) AS win_rate,
  round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / abs(sum(pnl) FILTER (WHERE pnl <= 0)), 6) AS profit_factor FROM trips GROUP BY asset""")
def round_trip_stats(spark, sf_dir):
    return rounded(ec.round_trip_stats(ec.fifo_round_trips(fills(spark, sf_dir)), ["asset"]), win_rate=9, profit_factor=6)


@query(q.with_(q.TICKS, _FILLS) + """, e AS (SELECT *, lead(price) OVER (PARTITION BY asset ORDER BY ts, seq) AS x FROM fills),
n AS (SELECT *, qty * price * 0.0005 AS fee, coalesce(x, price) * qty - price * qty - qty * price * 0.0005 AS net FROM e),
k AS (SELECT *, sum(net) OVER (PARTITION BY asset ORDER BY ts, seq) AS cum FROM n),
d AS (SELECT *, max(cum) OVER (PARTITION BY asset ORDER BY ts, seq) AS pk FROM k)
SELECT asset, count(*) AS total_trades, round(avg(CAST(net > 0 AS INT)) * 100, 7) AS win_rate, round(avg(net) FILTER (WHERE net > 0), 3) AS avg_win,
  round(avg(net) FILTER (WHERE net <= 0), 3) AS avg_loss, round(sum(net), 2) AS total_pnl,
  round(sum(net) / 10000 * 100, 2) AS total_return_pct, round(max((pk - cum) / (10000 + pk) * 100), 5) AS max_drawdown_pct,
  round(sum(net) FILTER (WHERE net > 0) / abs(sum(net) FILTER (WHERE net <= 0)), 7) AS profit_factor, round(sum(fee), 2) AS total_fees, round(sum(fee) / 10000 * 100, 2) AS fee_drag_pct FROM d GROUP BY asset""")
def trade_list_summary(spark, sf_dir):
    """Each print exits at the next print of its asset."""
    from barloom.functions.series import scan, time_bucket

    rows = cut_lineage(fills(spark, sf_dir).withColumn("_desc", -F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_dseq", -F.col("seq")))
    nxt = scan(rows, ["asset"], ["_desc", "_dseq"], -time_bucket(F.col("ts")), {"exit_price": ("last", F.col("price"))}, exclusive=True)
    out = ec.trade_list_summary(cut_lineage(nxt), ["asset"], order=["ts", "seq"])
    return rounded(out, win_rate=7, avg_win=3, avg_loss=3, total_pnl=2, total_return_pct=2, max_drawdown_pct=5, profit_factor=7, total_fees=2, fee_drag_pct=2)


# ------------------------------------------------------------------ splits

@query(q.with_(labelled_sql(["breakout"]), recursive=True) + """, e AS (SELECT b.asset, b.ts AS split_ts FROM bars b JOIN (SELECT asset, CAST(floor(count(*) * 0.8) AS BIGINT) AS p FROM bars GROUP BY asset) c
  ON c.asset = b.asset AND b.pos = c.p)
SELECT l.asset, l.bar, l.side, e.split_ts, CASE WHEN l.ts < e.split_ts THEN 'train' ELSE 'test' END AS role FROM lab l JOIN e ON e.asset = l.asset""")
def split_by_position(spark, sf_dir):
    trades = labelled(spark, sf_dir, ["breakout"]).select("asset", "ts", "bar", "side")
    return sp.split_by_position(trades, t.numbered_bars(spark, sf_dir)).select("asset", "bar", "side", "split_ts", "role")


@query(q.with_(q.BARS) + """, n AS (SELECT asset, count(*) AS n, count(*) // 6 AS z FROM bars GROUP BY asset),
p AS (SELECT *, greatest(1, CAST(floor(z * 0.01) AS BIGINT)) AS e FROM n),
r AS (SELECT b.asset, b.pos, f AS fold, CASE WHEN z * f + 5 + z > n THEN NULL WHEN b.pos < z * f - e THEN 'train'
  WHEN b.pos >= z * f + 5 AND b.pos < z * f + 5 + z THEN 'test' END AS role FROM bars b JOIN p USING (asset), range(1, 6) r(f))
SELECT asset, CAST(fold AS INT) AS fold, role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM r WHERE role IS NOT NULL GROUP BY ALL""")
def purged_row_folds(spark, sf_dir):
    rows = t.numbered_bars(spark, sf_dir).select("asset", "pos")
    return sp.purged_folds(rows).groupBy("asset", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_FOLDS = """, num AS (SELECT *, row_number() OVER (ORDER BY ts, trade_id) - 1 AS rn, count(*) OVER () AS n, max(ts) OVER () AS last_ts FROM scored),
st AS (SELECT f, ts AS test_start, last_ts FROM num, range(1, 4) r(f) WHERE rn = CAST(floor(n * f / 4.0::DOUBLE) AS BIGINT)),
ed AS (SELECT CAST(f AS INT) AS fold, test_start, coalesce(lead(test_start) OVER (ORDER BY f), last_ts + INTERVAL 1 second) AS test_end,
  test_start - INTERVAL 18 day AS train_before FROM st),
rl AS (SELECT s.trade_id, s.label, e.fold, CASE WHEN s.ts < e.train_before THEN 'train' ELSE 'test' END AS role FROM scored s JOIN ed e
  ON s.ts < e.train_before OR (s.ts >= e.test_start AND s.ts < e.test_end))
"""


@query(q.with_(_SC, recursive=True) + _FOLDS + "SELECT * FROM ed")
def pooled_fold_edges(spark, sf_dir):
    trades = labelled(spark, sf_dir).withColumn("trade_id", F.concat_ws("_", *KEYS[:2], F.col("bar").cast("string")))
    return sp.fold_edges(trades, 4, 18 * 86400.0)


def _folded(spark, sf_dir, **options):
    trades = labelled(spark, sf_dir).withColumn("trade_id", F.concat_ws("_", *KEYS[:2], F.col("bar").cast("string")))
    lean = cut_lineage(trades.select("trade_id", "ts", "label"))
    return sp.assign_folds(lean, sp.fold_edges(lean, 4, 18 * 86400.0), **options)


@query(q.with_(_SC, recursive=True) + _FOLDS + ", ok AS (SELECT fold FROM rl GROUP BY fold HAVING count(*) FILTER (WHERE role = 'train') >= 100 AND count(*) FILTER (WHERE role = 'test') > 0) "
       "SELECT trade_id, fold, role FROM rl SEMI JOIN ok USING (fold)")
def pooled_walk_forward_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("trade_id", "fold", "role")


@query(q.with_(_SC, recursive=True) + _FOLDS + """, ok AS (SELECT fold FROM rl GROUP BY fold HAVING count(*) FILTER (WHERE role = 'train') >= 150
  AND count(*) FILTER (WHERE role = 'test') > 0 AND count(DISTINCT label) FILTER (WHERE role = 'train') = 2)
SELECT fold, role, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins FROM rl SEMI JOIN ok USING (fold) GROUP BY fold, role""")
def sweep_folds(spark, sf_dir):
    return _folded(spark, sf_dir, min_train=150, two_classes=True).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_wins"))


# ------------------------------------------------------------------ scores

@query(q.with_(_SC, recursive=True) + """, c AS (SELECT signal, quantile_cont(p_win, 0.8) AS cut FROM scored GROUP BY signal)
SELECT signal, count(*) AS support, round(CASE WHEN count(*) >= 10 THEN avg(label) ELSE 0 END, 9) AS precision
FROM scored JOIN c USING (signal) WHERE p_win >= cut GROUP BY signal""")
def top_quantile_precision(spark, sf_dir):
    return rounded(cal.top_quantile_precision(scored_trades(spark, sf_dir), ["signal"]), precision=9)


@query(q.with_(_SC, recursive=True) + """, c AS (SELECT signal, p_win AS score, count(*) OVER w AS n, sum(label) OVER w AS w FROM scored
  WINDOW w AS (PARTITION BY signal ORDER BY p_win DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT signal, min(score) AS t FROM c WHERE w / n::DOUBLE >= 0.3 AND n >= 30 GROUP BY signal),
f AS (SELECT signal, coalesce(any_value(b.t), quantile_cont(p_win, 0.8)) AS threshold, any_value(b.t) IS NOT NULL AS met FROM scored LEFT JOIN b USING (signal) GROUP BY signal)
SELECT signal, round(threshold, 9) AS threshold, met AS target_met, count(*) AS n_trades, round(avg(label), 9) AS precision
FROM scored JOIN f USING (signal) WHERE p_win >= threshold GROUP BY ALL""")
def calibrate_threshold(spark, sf_dir):
    out = cal.calibrate_threshold(scored_trades(spark, sf_dir), ["signal"], target=0.3, min_trades=30)
    return rounded(out, threshold=9, precision=9)


@query(q.with_(_SC, recursive=True) + """SELECT round(0.40 + i * 0.05, 3)::DOUBLE AS threshold, count(*) FILTER (WHERE p_win >= round(0.40 + i * 0.05, 3)) AS n_trades,
  round(avg(label) FILTER (WHERE p_win >= round(0.40 + i * 0.05, 3)), 9) AS win_rate,
  round(count(*) FILTER (WHERE p_win >= round(0.40 + i * 0.05, 3)) / count(*)::DOUBLE, 9) AS pct_of_candidates FROM scored, range(0, 10) r(i) GROUP BY i""")
def threshold_table(spark, sf_dir):
    return rounded(cal.threshold_table(scored_trades(spark, sf_dir)), win_rate=9, pct_of_candidates=9)


_LEAFS = """leafs AS (SELECT trade_id AS row_id, ts < TIMESTAMP '1999-06-01' AS train, CAST(tree AS INT) AS tree,
  CAST(floor(sqrt(('0x' || substr(md5(trade_id || '_' || tree), 1, 15))::BIGINT % 64)) AS INT) AS leaf FROM scored, range(0, 10) r(tree))"""


@query(q.with_(_SC, _LEAFS, recursive=True) + """, o AS (SELECT tree, leaf, count(*) AS k FROM leafs WHERE train GROUP BY ALL),
n AS (SELECT count(DISTINCT row_id) AS n FROM leafs WHERE train),
s AS (SELECT row_id, any_value(train) AS train, sum(coalesce(k, 0)) / (10 * any_value(n)::DOUBLE) AS support FROM leafs LEFT JOIN o USING (tree, leaf), n GROUP BY row_id),
r AS (SELECT quantile_cont(support, 0.1) AS cut, max(support) AS ref FROM s WHERE train)
SELECT row_id, round(support, 9) AS support, round(least(greatest(1 - support / ref, 0), 1), 9) AS score, support < cut AS is_novel FROM s, r""")
def leaf_novelty(spark, sf_dir):
    trades = labelled(spark, sf_dir).withColumn("row_id", F.concat_ws("_", *KEYS[:2], F.col("bar").cast("string")))
    trees = trades.select("row_id", "ts", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tree"))
    leafs = trees.select("row_id", "ts", "tree", F.floor(F.sqrt(
        t.hash_uniform(F.col("row_id"), F.col("tree")) % 64)).cast("int").alias("leaf"))
    leafs = cut_lineage(leafs)
    out = cal.novelty(leafs.filter(F.col("ts") < F.lit("1999-06-01").cast("timestamp_ntz")), leafs)
    return rounded(out, support=9, score=9)


@query(q.with_(q.FEATURES, ADX, *PAIR_RETURNS, recursive=True) + f""", ps AS (SELECT ts, avg(strat_ret) AS pair_ret FROM pr GROUP BY ts),
x AS (SELECT f.asset, f.pos, vol_regime, coalesce(lag(adx) OVER (PARTITION BY f.asset ORDER BY f.pos), 0) AS adx_prior,
    coalesce(ret_1d, 0) AS tr_, -coalesce(ret_1d, 0) * 0.5 AS rr, coalesce(pair_ret, 0) AS pair_ret
  FROM feat f JOIN o ON o.asset = f.asset AND o.pos = f.pos LEFT JOIN ps ON ps.ts = f.ts),
w AS (SELECT *, least(greatest((adx_prior - 20) / 20.0::DOUBLE, 0), 1) AS weight, coalesce({q.lag('vol_regime')}, 1.0) AS v FROM x)
SELECT asset, pos, round(weight, 7) AS weight, round(pair_ret, 9) AS pair_ret,
  round((0.3 * pair_ret + 0.7 * (weight * tr_ + (1 - weight) * rr)) * CASE WHEN v > 2 THEN 0.5 ELSE 1 END, 7) AS blend_ret FROM w""")
def blended_returns(spark, sf_dir):
    """A trend and a range stream mixed by the ADX of the bar before, and 30 % of the mean return of all pairs.

    Pairs are weekly: their return falls on the bar that opens the week, all other bars have none.
    """
    bars = t.numbered_bars(spark, sf_dir)
    strength = ft.average_directional_index(bars).select("asset", "pos", "adx_prior")
    pairs = net_pair_returns(spark, sf_dir).groupBy("ts").agg(F.avg("strat_ret").alias("pair_ret"))
    rows = own_rows(ft.feature_frame(bars, balance=False)).join(strength, ["asset", "pos"]).join(pairs, "ts", "left").select(
        "asset", "pos", "vol_regime", "adx_prior", F.coalesce("ret_1d", F.lit(0.0)).alias("trend_ret"),
        (-F.coalesce("ret_1d", F.lit(0.0)) * 0.5).alias("range_ret"), F.coalesce("pair_ret", F.lit(0.0)).alias("pair_ret"))
    out = cal.blend_returns(rows, third=True).select("asset", "pos", "weight", "pair_ret", "blend_ret")
    return rounded(out, weight=7, pair_ret=9, blend_ret=7)
