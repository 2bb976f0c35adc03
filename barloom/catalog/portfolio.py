"""Registered queries: cross-sectional books on the weekly nation panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.catalog.signals import rounded
from barloom.operators import bars as b
from barloom.operators import portfolio as pf
from barloom.session import cut_lineage
from barloom.sources import tables as t

LAGG = lambda c, k: f"lag({c}, {k}) OVER (PARTITION BY asset ORDER BY d)"
RNK = "row_number() OVER (PARTITION BY {p} ORDER BY value DESC, asset)"


def mom_sql(k: int, sign: str = "") -> str:
    return f"mom AS (SELECT day, d, asset, close, {sign}({LAGG('close', 1)} / {LAGG('close', k + 1)} - 1) AS value FROM grid)"


def book_sql(feature: str, m: int, name: str = "book", part: str = "") -> str:
    p = f"{part}d" if not part else f"{part}, d"
    extra = f"{part}, " if part else ""
    return f"""{name}_r AS (SELECT *, {RNK.format(p=p)} AS r, count(*) OVER (PARTITION BY {p}) AS n FROM {feature} WHERE value IS NOT NULL),
{name}_w AS (SELECT {extra}d, asset, CASE WHEN r <= {m} THEN {1 / (2 * m)!r}::DOUBLE WHEN r > n - {m} THEN -{1 / (2 * m)!r}::DOUBLE ELSE 0 END AS w FROM {name}_r WHERE n >= {2 * m}),
{name} AS (SELECT {extra}g.d, g.day, g.asset, coalesce(w, 0) AS w FROM """ + (
        f"(SELECT * FROM grid, (SELECT DISTINCT {part} FROM {feature})) g LEFT JOIN {name}_w USING ({part}, d, asset))" if part
        else f"grid g LEFT JOIN {name}_w USING (d, asset))")


def ladder_sql(book: str, n: int, name: str, part: str = "") -> str:
    extra = f"{part}, " if part else ""
    return f"""{name} AS (SELECT {extra}d, day, asset, sum(w) OVER (PARTITION BY {extra}asset ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / {n} AS w FROM {book})"""


def pnl_sql(book: str, cost: str, name: str = "pnl", part: str = "", funding: bool = False) -> str:
    extra = f"{part}, " if part else ""
    fund = "- coalesce(sum(w * f.funding), 0)" if funding else ""
    fcol = ", -coalesce(sum(w * f.funding), 0) AS funding" if funding else ""
    fjoin = "LEFT JOIN fp f ON f.day = b.day AND f.asset = b.asset" if funding else ""
    return f"""{name}_f AS (SELECT d, asset, lead(close) OVER (PARTITION BY asset ORDER BY d) / close - 1 AS fwd FROM grid),
{name}_b AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY {extra}asset ORDER BY d), 0)) AS dw FROM {book}),
{name} AS (SELECT {extra}b.day, b.d, coalesce(sum(w * fwd), 0) AS gross, sum(dw) * {cost} AS cost_paid, sum(dw) AS turnover{fcol},
    coalesce(sum(w * fwd), 0) - sum(dw) * {cost} {fund} AS net
  FROM {name}_b b JOIN {name}_f USING (d, asset) {fjoin} WHERE b.d < (SELECT max(d) FROM days) GROUP BY ALL)"""


def stats_sql(pnl: str, keys: str, ret: str = "net", name: str = "st") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    extra = f"{keys}, " if keys else ""
    return f"""{name}_c AS (SELECT *, product(1 + {ret}) OVER ({part}ORDER BY d) AS curve FROM {pnl}),
{name}_d AS (SELECT *, (curve - max(curve) OVER ({part}ORDER BY d)) / max(curve) OVER ({part}ORDER BY d) AS dd FROM {name}_c),
{name} AS (SELECT {extra}count(*) AS n_days, round(product(1 + {ret}) - 1, 7) AS total_return, round((1 + avg({ret})) ** 52 - 1, 5) AS ann_return,
    round(avg({ret}) / stddev_samp({ret}) * sqrt(52), 7) AS sharpe, round(avg({ret}), 9) AS daily_mean, round(stddev_samp({ret}), 9) AS daily_vol,
    round(min(dd), 8) AS max_drawdown, round(avg(CAST({ret} > 0 AS INT)), 9) AS hit_rate FROM {name}_d {'GROUP BY ' + keys if keys else ''})"""


STATS_DIGITS = dict(total_return=7, ann_return=5, sharpe=7, daily_mean=9, daily_vol=9, max_drawdown=8, hit_rate=9)
PNL_DIGITS = dict(gross=9, cost_paid=9, turnover=9, net=9)
PNL_OUT = "day, round(gross, 9) AS gross, round(cost_paid, 9) AS cost_paid, round(turnover, 9) AS turnover, round(net, 9) AS net"
M = 5
#: The panel has a row a week.
WEEKS = 52
_BASE = q.PANEL + ",\n" + mom_sql(14)
_BOOK = _BASE + ",\n" + book_sql("mom", M)
VOL = f"""ret AS (SELECT d, asset, close / {LAGG('close', 1)} - 1 AS r FROM grid),
vol0 AS (SELECT d, asset, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS v FROM ret WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
vol AS (SELECT d, asset, {LAGG('v', 1)} AS vol FROM vol0)"""
FUND = """fp AS (SELECT asset, CAST(date_trunc('week', ts) AS TIMESTAMP) AS day, avg(funding_rate) * 3 AS funding FROM wfund GROUP BY 1, 2)"""


def indexed(spark, sf_dir):
    return pf.index_days(t.week_panel(spark, sf_dir))


def week_funding(spark, sf_dir, days):
    return b.daily_funding(t.week_funding(spark, sf_dir), "1w").join(b.calendar(days), "day")


def base_book(ix, m=M):
    return pf.long_short_book(pf.momentum(ix, 14), m)


@query(q.with_(q.PANEL, mom_sql(14)) + "SELECT d, asset, round(value, 9) AS value FROM mom WHERE value IS NOT NULL")
def momentum_feature(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    last = b.calendar(t.week_panel(spark, sf_dir)).agg(F.max("d")).scalar()
    return rounded(pf.momentum(ix, 14).filter(F.col("d") <= last), value=9)


@query(q.with_(q.PANEL, mom_sql(3, "-")) + "SELECT d, asset, round(value, 9) AS value FROM mom WHERE value IS NOT NULL")
def reversal_feature(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    last = b.calendar(t.week_panel(spark, sf_dir)).agg(F.max("d")).scalar()
    return rounded(pf.momentum(ix, 3, reversal=True).filter(F.col("d") <= last), value=9)


def _real_days(df, spark, sf_dir):
    return df.filter(F.col("d") <= b.calendar(t.week_panel(spark, sf_dir)).agg(F.max("d")).scalar())


@query(q.with_(_BOOK) + "SELECT d, asset, w FROM book WHERE w <> 0")
def long_short_book(spark, sf_dir):
    return _real_days(base_book(indexed(spark, sf_dir)), spark, sf_dir)


@query(q.with_(_BASE, VOL) + f"""SELECT d, asset, round(vol, 9) AS vol FROM vol WHERE vol IS NOT NULL""")
def realized_vol_panel(spark, sf_dir):
    return _real_days(rounded(pf.realized_vol(indexed(spark, sf_dir)), vol=9), spark, sf_dir)


VT = f"""vt_r AS (SELECT mom.*, {RNK.format(p='d')} AS r, count(*) OVER (PARTITION BY d) AS n FROM mom WHERE value IS NOT NULL),
vt_l AS (SELECT v.d, v.asset, CASE WHEN r <= {M} THEN 1 ELSE -1 END AS leg, CASE WHEN vol.vol > 0 THEN 1 / (vol.vol + 1e-9) END AS i0
  FROM vt_r v LEFT JOIN vol ON vol.d = v.d AND vol.asset = v.asset WHERE n >= {2 * M} AND (r <= {M} OR r > n - {M})),
vt_i AS (SELECT *, coalesce(i0, avg(i0) OVER (PARTITION BY d, leg), 1.0) AS i FROM vt_l),
vt_w AS (SELECT d, asset, i / sum(i) OVER (PARTITION BY d, leg) * 0.5 * leg AS w FROM vt_i),
vt AS (SELECT g.d, g.day, g.asset, coalesce(w, 0) AS w FROM grid g LEFT JOIN vt_w USING (d, asset))"""


@query(q.with_(_BASE, VOL, VT) + "SELECT d, asset, round(w, 9) AS w FROM vt WHERE w <> 0")
def vol_target_book(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return _real_days(rounded(pf.vol_target_book(pf.momentum(ix, 14), M, pf.realized_vol(ix)), w=9), spark, sf_dir)


@query(q.with_(_BOOK, ladder_sql("book", 4, "lad")) + "SELECT d, asset, round(w, 9) AS w FROM lad WHERE w <> 0")
def overlapping_book(spark, sf_dir):
    out = pf.overlap_rebalance(base_book(indexed(spark, sf_dir)), 4)
    return _real_days(rounded(out, w=9).filter("w <> 0"), spark, sf_dir)


@query(q.with_(_BOOK, pnl_sql("book", "0.0004")) + f"SELECT {PNL_OUT} FROM pnl")
def book_backtest(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return rounded(pf.backtest_book(ix, base_book(ix), 0.0004).drop("d"), **PNL_DIGITS)


ZS = "z AS (SELECT *, (value - avg(value) OVER (PARTITION BY d)) / (stddev_samp(value) OVER (PARTITION BY d) + 1e-12) AS z FROM mom WHERE value IS NOT NULL)"


@query(q.with_(_BASE, ZS) + "SELECT d, asset, round(z, 8) AS value FROM z WHERE z IS NOT NULL")
def cross_section_zscore(spark, sf_dir):
    return _real_days(rounded(pf.zscore(pf.momentum(indexed(spark, sf_dir), 14), ["d"]), value=8), spark, sf_dir)


COMP = f"""fg AS (SELECT g.d, g.day, g.asset, fp.funding FROM grid g LEFT JOIN fp ON fp.day = g.day AND fp.asset = g.asset),
car0 AS (SELECT d, asset, -({LAGG('funding', 1)}) AS v FROM fg),
car AS (SELECT d, asset, (v - avg(v) OVER (PARTITION BY d)) / (stddev_samp(v) OVER (PARTITION BY d) + 1e-12) AS c FROM car0 WHERE v IS NOT NULL),
comp AS (SELECT z.d, z.day, z.asset, 0.7::DOUBLE * z.z + 0.3::DOUBLE * coalesce(c, 0) AS value FROM z LEFT JOIN car ON car.d = z.d AND car.asset = z.asset WHERE z.z IS NOT NULL)"""
_FBASE = _BASE + ",\n" + q.WEEK_FUNDING + ",\n" + FUND


@query(q.with_(_FBASE, ZS, COMP) + "SELECT d, asset, round(value, 8) AS value FROM comp")
def composite_feature(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    out = pf.composite(ix, week_funding(spark, sf_dir, t.week_panel(spark, sf_dir)), 14, 0.3)
    return _real_days(rounded(out, value=8), spark, sf_dir)


@query(q.with_(_FBASE, book_sql("mom", M), pnl_sql("book", "0.0004", funding=True)) + f"SELECT {PNL_OUT}, round(funding, 12) AS funding FROM pnl")
def book_backtest_with_funding(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    out = pf.backtest_book(ix, base_book(ix), 0.0004, funding=week_funding(spark, sf_dir, t.week_panel(spark, sf_dir)))
    return rounded(out.drop("d"), funding=12, **PNL_DIGITS)


@query(q.with_(_BOOK, pnl_sql("book", "0.0004")) + """, v AS (SELECT *, CASE WHEN count(net) OVER w = 30 THEN stddev_samp(net) OVER w END AS rv FROM pnl
  WINDOW w AS (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, coalesce(least(0.20 / sqrt(52) / (rv + 1e-9), 3.0), 1.0) AS leverage FROM v)
SELECT day, round(leverage, 7) AS leverage, round(net * leverage, 9) AS scaled FROM l""")
def volatility_scaled_book(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    out = pf.volatility_scale(pf.backtest_book(ix, base_book(ix), 0.0004), periods=WEEKS)
    return rounded(out.select("day", "leverage", "scaled"), leverage=7, scaled=9)


@query(q.with_(_BOOK, pnl_sql("book", "0.0004"), stats_sql("pnl", "")) + "SELECT * FROM st")
def equity_statistics(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return rounded(pf.equity_stats(pf.backtest_book(ix, base_book(ix), 0.0004), [], periods=WEEKS), **STATS_DIGITS)


_LOOKS = [3, 7, 14, 30]
_GRID = "feat AS (" + " UNION ALL ".join(
    f"SELECT '{kind}_{k}' AS config_id, d, day, asset, {s}({LAGG('close', 1)} / {LAGG('close', k + 1)} - 1) AS value FROM grid"
    for kind, s in (("momentum", ""), ("reversal", "-")) for k in _LOOKS) + ")"
_SWEEP = q.with_(q.PANEL, _GRID, book_sql("feat", M, part="config_id"), pnl_sql("book", "0.0004", part="config_id"),
                 stats_sql("pnl", "config_id"))


def sweep_pnl(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    book = pf.long_short_book(pf.factor_grid(ix, _LOOKS), M, ["config_id"])
    return pf.backtest_book(ix, book, 0.0004, ["config_id"])


@query(_SWEEP + "SELECT * FROM st")
def factor_sweep(spark, sf_dir):
    """Two factors x four look-backs, all in one job."""
    return rounded(pf.equity_stats(sweep_pnl(spark, sf_dir), ["config_id"], periods=WEEKS), **STATS_DIGITS)


@query(_SWEEP + "SELECT config_id, sharpe FROM st ORDER BY sharpe DESC, config_id DESC LIMIT 1")
def factor_sweep_best(spark, sf_dir):
    return rounded(pf.best_config(pf.equity_stats(sweep_pnl(spark, sf_dir), ["config_id"], periods=WEEKS)), sharpe=7)


_ABL = q.with_(_FBASE, ZS, COMP, VOL, book_sql("mom", M), VT, VT.replace("vt", "vc").replace("FROM mom WHERE", "FROM comp WHERE").replace("mom.*", "comp.*"),
               """ab AS (SELECT '1_momentum' AS config_id, d, day, asset, w FROM book UNION ALL SELECT '2_vol_target', d, day, asset, w FROM vt
  UNION ALL SELECT '3_carry', d, day, asset, w FROM vc)""", ladder_sql("ab", 4, "lad", "config_id"),
               pnl_sql("lad", "0.0004", part="config_id", funding=True), stats_sql("pnl", "config_id"))


def ablation_pnl(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    fund = week_funding(spark, sf_dir, t.week_panel(spark, sf_dir))
    mom, vol = pf.momentum(ix, 14), pf.realized_vol(ix)
    tag = lambda name, w: w.select(F.lit(name).alias("config_id"), "d", "asset", "w")
    books = (tag("1_momentum", pf.long_short_book(mom, M))
             .unionByName(tag("2_vol_target", pf.vol_target_book(mom, M, vol)))
             .unionByName(tag("3_carry", pf.vol_target_book(pf.composite(ix, fund, 14, 0.3), M, vol))))
    books = cut_lineage(pf.overlap_rebalance(books, 4, ["config_id"]))
    return pf.backtest_book(ix, books, 0.0004, ["config_id"], fund)


@query(_ABL + "SELECT * FROM st")
def book_ablation(spark, sf_dir):
    """Equal weight, volatility target, plus carry; laddered, with funding."""
    return rounded(pf.equity_stats(ablation_pnl(spark, sf_dir), ["config_id"], periods=WEEKS), **STATS_DIGITS)


@query(q.with_(_BOOK, pnl_sql("book", "0.0004"), """hs AS (SELECT *, 'FULL' AS segment FROM pnl UNION ALL SELECT *,
  CASE WHEN d < (SELECT count(*) FROM pnl) // 2 THEN 'H1' ELSE 'H2' END FROM pnl)""", stats_sql("hs", "segment")) + "SELECT * FROM st")
def half_sample_stats(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return rounded(pf.equity_stats(pf.half_split(pf.backtest_book(ix, base_book(ix), 0.0004), []), ["segment"], periods=WEEKS), **STATS_DIGITS)


@query(q.with_(_BOOK, pnl_sql("book", "0.0004")) + "SELECT year(day) AS year, round(product(1 + net) - 1, 8) AS year_return FROM pnl GROUP BY 1")
def calendar_year_returns(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return rounded(pf.calendar_year_returns(pf.backtest_book(ix, base_book(ix), 0.0004), []), year_return=8)


@query(q.with_(_BOOK) + """SELECT day, string_agg(asset, ',' ORDER BY asset) FILTER (WHERE w > 0) AS longs,
  string_agg(asset, ',' ORDER BY asset) FILTER (WHERE w < 0) AS shorts FROM book WHERE d = (SELECT max(d) FROM days) GROUP BY day""")
def latest_book(spark, sf_dir):
    panel = t.week_panel(spark, sf_dir)
    return pf.latest_book(base_book(pf.index_days(panel)), b.calendar(panel))


_ROT = q.with_(q.PANEL) + """, sc AS (SELECT day AS ts, asset, close, ('0x' || substr(md5(asset || '_' || epoch_us(day)), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS score FROM panel),
cm AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT ts FROM sc GROUP BY ts HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM sc))),
ck AS (SELECT ts, i // 6 AS c FROM cm WHERE i % 6 = 0),
mv AS (SELECT * FROM (SELECT sc.*, c, lead(close) OVER (PARTITION BY asset ORDER BY c) / close - 1 AS r FROM sc JOIN ck USING (ts)) WHERE r IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, asset) AS b, row_number() OVER (PARTITION BY c ORDER BY score, asset DESC) AS w FROM mv),
pr AS (SELECT ts, c, 0.5 * avg(r - 0.004) FILTER (WHERE b <= 3) + 0.5 * avg(-r - 0.004) FILTER (WHERE w <= 3) AS period_ret, avg(r - 0.004) AS equal_weight_ret FROM rk GROUP BY ts, c)
"""


def rotation_scores(spark, sf_dir):
    panel = t.week_panel(spark, sf_dir)
    score = t.unit_draw(F.col("asset"), F.unix_micros(F.col("day").cast("timestamp")))
    return panel.select(F.col("day").alias("ts"), "asset", "close", score.alias("score"))


@query(_ROT + "SELECT ts, c, round(period_ret, 9) AS period_ret, round(equal_weight_ret, 9) AS equal_weight_ret FROM pr")
def score_rotation(spark, sf_dir):
    return rounded(pf.rotation(rotation_scores(spark, sf_dir), 3, 6, 0.004, True), period_ret=9, equal_weight_ret=9)


@query(_ROT + """SELECT count(*) AS n_periods, round(avg(CAST(period_ret > 0 AS INT)), 9) AS win_rate, round(product(1 + period_ret) - 1, 8) AS total_return,
  round(avg(period_ret) / (stddev_samp(period_ret) + 1e-9) * sqrt(365 / (6 * 4 / 24.0::DOUBLE)), 6) AS sharpe, round(product(1 + equal_weight_ret) - 1, 8) AS equal_weight_total FROM pr""")
def score_rotation_summary(spark, sf_dir):
    out = pf.rotation_summary(pf.rotation(rotation_scores(spark, sf_dir), 3, 6, 0.004, True), 6)
    return rounded(out, win_rate=9, total_return=8, sharpe=6, equal_weight_total=8)
