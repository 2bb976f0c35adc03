"""Registered queries: pairs and price triangles."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.catalog.signals import rounded
from barloom.operators import pairs as pr
from barloom.operators import triangle as tri
from barloom.sources import tables as t

ALIGN = q.PANEL + """,
pp AS (SELECT l.asset AS a, r.asset AS b, l.day AS ts, l.close AS x, r.close AS y FROM panel l JOIN panel r ON l.day = r.day AND l.asset < r.asset),
al AS (SELECT *, pos < floor(n * 0.8) AS in_sample FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY a, b) AS n FROM pp) WHERE n >= 30)"""
HEDGE = "hg AS (SELECT a, b, regr_slope(x, y) AS beta, regr_intercept(x, y) AS alpha FROM al WHERE in_sample GROUP BY a, b)"
SPREAD = "sd AS (SELECT al.*, beta, x - beta * y AS spread FROM al JOIN hg USING (a, b))"
HALF = """hl AS (SELECT a, b, covar_samp(s0, spread - s0) / (var_pop(s0) + 1e-9) AS slope, count(*) AS m, any_value(n) AS n
  FROM (SELECT *, lag(spread) OVER (PARTITION BY a, b ORDER BY pos) AS s0 FROM sd) WHERE in_sample AND s0 IS NOT NULL GROUP BY a, b),
hw AS (SELECT a, b, slope, CAST(CASE WHEN m > 10 AND slope < 0 THEN least(greatest(10, floor(2 * (-ln(2) / slope))), least(n // 4, 120)) ELSE 30 END AS INT) AS win FROM hl)"""
ZS = """zz AS (SELECT d.a, d.b, d.pos, any_value(d.ts) AS ts, any_value(d.x) AS x, any_value(d.y) AS y, any_value(d.n) AS n, any_value(d.in_sample) AS in_sample,
    CASE WHEN d.pos >= any_value(win) - 1 THEN (any_value(d.spread) - avg(e.spread)) / nullif(stddev_samp(e.spread), 0) END AS z
  FROM sd d JOIN hw USING (a, b) JOIN sd e ON e.a = d.a AND e.b = d.b AND e.pos <= d.pos AND e.pos > d.pos - win GROUP BY d.a, d.b, d.pos)"""
HYST = """st AS (SELECT a, b, pos, z, CASE WHEN abs(z) > 1.8 THEN TRUE ELSE FALSE END AS stopped,
    CASE WHEN z IS NULL OR abs(z) > 1.8 THEN 0 WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS cur FROM zz WHERE pos = 0
  UNION ALL
  SELECT n.a, n.b, n.pos, n.z,
    CASE WHEN n.z IS NULL THEN s.stopped WHEN s.stopped AND abs(n.z) >= 0.3 THEN TRUE WHEN abs(n.z) > 1.8 THEN TRUE ELSE FALSE END,
    CASE WHEN n.z IS NULL THEN s.cur WHEN s.stopped AND abs(n.z) >= 0.3 THEN 0 WHEN abs(n.z) > 1.8 THEN 0
         WHEN n.z > 1 THEN -1 WHEN n.z < -1 THEN 1 WHEN abs(n.z) < 0.3 THEN 0 ELSE s.cur END
  FROM st s JOIN zz n ON n.a = s.a AND n.b = s.b AND n.pos = s.pos + 1),
hp AS (SELECT *, coalesce(lag(CASE WHEN z IS NULL THEN 0 ELSE cur END) OVER (PARTITION BY a, b ORDER BY pos), 0) AS position FROM st)"""
_TO_Z = (ALIGN, HEDGE, SPREAD, HALF, ZS)
PAIR_RETURNS = (*_TO_Z, HYST, """j AS (SELECT hp.a, hp.b, hp.pos, hp.position, zz.ts, in_sample, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0,
    lag(position) OVER w AS p0, lag(in_sample) OVER w AS was FROM hp JOIN zz USING (a, b, pos) WINDOW w AS (PARTITION BY a, b ORDER BY pos)),
pr AS (SELECT a, b, pos, ts, position, CASE WHEN was THEN -2 * abs(position) * 0.001 ELSE position * ((x / x0 - 1) - (y / y0 - 1)) - 2 * abs(position - p0) * 0.001 END AS strat_ret
  FROM j WHERE NOT in_sample)""")
RULE = dict(entry=1.0, leave=0.3, stop=1.8)


def aligned(spark, sf_dir):
    return pr.align_pairs(t.week_panel(spark, sf_dir).withColumnRenamed("day", "ts"))


@query(q.with_(ALIGN) + "SELECT a, b, ts, pos, n, in_sample FROM al")
def aligned_pairs(spark, sf_dir):
    return aligned(spark, sf_dir).select("a", "b", "ts", "pos", "n", "in_sample")


@query(q.with_(ALIGN, HEDGE) + "SELECT a, b, round(beta, 8) AS beta, round(alpha, 4) AS alpha FROM hg")
def pair_hedge_ratio(spark, sf_dir):
    return rounded(pr.hedge_ratio(aligned(spark, sf_dir)), beta=8, alpha=4)


@query(q.with_(ALIGN) + """SELECT a, b, pos, CASE WHEN pos >= 59 THEN round(covar_pop(x, y) OVER w / var_pop(y) OVER w, 7) END AS beta FROM al
WINDOW w AS (PARTITION BY a, b ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def pair_rolling_hedge(spark, sf_dir):
    return rounded(pr.rolling_hedge(aligned(spark, sf_dir), 60).select("a", "b", "pos", "beta"), beta=7)


@query(q.with_(ALIGN, HEDGE) + """, e AS (SELECT al.a, al.b, pos, x - alpha - beta * y AS e FROM al JOIN hg USING (a, b) WHERE in_sample),
l AS (SELECT *, lag(e) OVER (PARTITION BY a, b ORDER BY pos) AS e0 FROM e),
s AS (SELECT a, b, count(*) AS m, sum(e0 * (e - e0)) AS sxy, sum(e0 * e0) AS sxx, sum((e - e0) * (e - e0)) AS syy FROM l WHERE e0 IS NOT NULL GROUP BY a, b)
SELECT a, b, m, round(sxy / sxx / sqrt((syy - sxy / sxx * sxy) / (m - 1) / sxx), 6) AS t_stat,
  sxy / sxx / sqrt((syy - sxy / sxx * sxy) / (m - 1) / sxx) < -3.0445 AS cointegrated FROM s""")
def pair_cointegration(spark, sf_dir):
    return rounded(pr.cointegration_screen(aligned(spark, sf_dir)), t_stat=6)


@query(q.with_(ALIGN) + """, r AS (SELECT a, b, avg(x) / avg(y) AS r FROM al WHERE in_sample GROUP BY a, b),
s AS (SELECT al.a, al.b, pos, x - y * r AS s FROM al JOIN r USING (a, b) WHERE in_sample),
t AS (SELECT p.a, p.b, k, stddev_pop(n.s - p.s) AS tau FROM s p, range(2, 100) r(k), s n WHERE n.a = p.a AND n.b = p.b AND n.pos = p.pos + k GROUP BY ALL)
SELECT a, b, round(regr_slope(ln(tau), ln(k)) * 2, 7) AS hurst2 FROM t WHERE tau > 0 GROUP BY a, b""")
def pair_hurst(spark, sf_dir):
    return rounded(pr.hurst_doubled(aligned(spark, sf_dir)), hurst2=7)


@query(q.with_(ALIGN, HEDGE, SPREAD, HALF) + 'SELECT a, b, round(slope, 8) AS slope, win AS "window" FROM hw')
def pair_half_life(spark, sf_dir):
    return rounded(pr.half_life_window(pr.with_spread(aligned(spark, sf_dir))), slope=8)


def scored(spark, sf_dir):
    spreads = pr.with_spread(aligned(spark, sf_dir))
    return pr.spread_zscore(spreads, pr.half_life_window(spreads))


@query(q.with_(*_TO_Z) + "SELECT a, b, pos, round(z, 6) AS z FROM zz")
def pair_zscore(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("a", "b", "pos", "z"), z=6)


@query(q.with_(*_TO_Z, HYST, recursive=True) + "SELECT a, b, pos, stopped, position FROM hp")
def pair_positions(spark, sf_dir):
    return pr.hysteresis_positions(scored(spark, sf_dir), **RULE).select("a", "b", "pos", "stopped", "position")


def net_pair_returns(spark, sf_dir):
    return pr.pair_returns(pr.hysteresis_positions(scored(spark, sf_dir), **RULE), 0.001)


@query(q.with_(*PAIR_RETURNS, recursive=True) + "SELECT a, b, pos, ts, position, round(strat_ret, 9) AS strat_ret FROM pr")
def pair_returns(spark, sf_dir):
    return rounded(net_pair_returns(spark, sf_dir), strat_ret=9)


_TRI = """legs AS (SELECT date_trunc('hour', ts) AS snapshot, CASE WHEN event_type IN ('click', 'signup') THEN 'ab'
    WHEN event_type IN ('view', 'error') THEN 'bc' ELSE 'ac' END AS leg, max(value) + 1 AS p FROM events GROUP BY 1, 2),
w AS (SELECT snapshot, max(p) FILTER (WHERE leg = 'ab') AS ab, max(p) FILTER (WHERE leg = 'bc') AS bc, max(p * p) FILTER (WHERE leg = 'ac') AS ac FROM legs GROUP BY snapshot),
e AS (SELECT *, (greatest(ac / (ab * bc), 1 / (ac / (ab * bc))) * (1 - 0.001::DOUBLE) ** 3 - 1) * 10000 AS edge_bps FROM w WHERE ab IS NOT NULL AND bc IS NOT NULL AND ac IS NOT NULL)"""


def all_legs(spark, sf_dir):
    """Hourly prices of three legs: clicks and signups, views and errors, purchases and any other type.

    The direct leg is scaled to the product of the other two.
    """
    kind = F.col("event_type")
    leg = F.when(kind.isin("click", "signup"), "ab").when(kind.isin("view", "error"), "bc").otherwise("ac")
    hourly = t.table(spark, sf_dir, "events").groupBy(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("snapshot"), leg.alias("leg")).agg((F.max("value") + 1).alias("_p"))
    return hourly.select("snapshot", "leg", F.when(F.col("leg") == "ac", F.col("_p") * F.col("_p")).otherwise(F.col("_p")).alias("price"))


@query(q.with_(_TRI) + "SELECT snapshot, ab, bc, ac, round(edge_bps, 5) AS edge_bps FROM e")
def triangle_edges(spark, sf_dir):
    return rounded(tri.triangle_edges(all_legs(spark, sf_dir)), edge_bps=5)


@query(q.with_(_TRI) + """SELECT count(*) AS n_snapshots, count(*) FILTER (WHERE edge_bps > 50) AS n_viable, round(avg(CAST(edge_bps > 50 AS INT)), 9) AS viable_share,
  round(avg(edge_bps), 4) AS mean_edge_bps, round(max(edge_bps), 4) AS max_edge_bps FROM e""")
def triangle_summary(spark, sf_dir):
    out = tri.triangle_summary(tri.triangle_edges(all_legs(spark, sf_dir)))
    return rounded(out, viable_share=9, mean_edge_bps=4, max_edge_bps=4)


_GRAPH = """g AS (SELECT date_trunc('hour', ts) AS snapshot, 'A' || lpad((user_id % 12)::VARCHAR, 2, '0') AS base,
    'A' || lpad((json_extract_string(props, '$.k')::BIGINT % 12)::VARCHAR, 2, '0') AS quote, 1 + value / 10000 AS price FROM events),
p AS (SELECT snapshot, least(base, quote) AS x, greatest(base, quote) AS y, max(CASE WHEN base < quote THEN price ELSE 1 / price END) AS there,
    max(1 / CASE WHEN base < quote THEN price ELSE 1 / price END) AS back FROM g WHERE base <> quote GROUP BY ALL),
tr AS (SELECT l.snapshot, l.x AS a, l.y AS b, m.y AS c, (greatest(l.there * m.there * n.back, n.there * m.back * l.back) * (1 - 0.001::DOUBLE) ** 3 - 1) * 10000 AS edge_bps
  FROM p l JOIN p m ON m.snapshot = l.snapshot AND m.x = l.y JOIN p n ON n.snapshot = l.snapshot AND n.x = l.x AND n.y = m.y),
ta AS (SELECT asset, count(*) AS n_triangles, sum(CAST(edge_bps > 50 AS INT)) AS n_viable, avg(CAST(edge_bps > 50 AS INT)) AS viable_share,
    avg(edge_bps) AS mean_edge_bps, max(edge_bps) AS max_edge_bps FROM (SELECT edge_bps, unnest([a, b, c]) AS asset FROM tr) GROUP BY asset)"""
_ASSET_COLS = """SELECT asset, n_triangles, n_viable, round(viable_share, 9) AS viable_share, round(mean_edge_bps, 4) AS mean_edge_bps,
  round(max_edge_bps, 4) AS max_edge_bps FROM ta"""


def price_graph(spark, sf_dir):
    """Hourly quotes among twelve assets: every event prices its user's asset in the one its property names."""
    asset = lambda number: F.concat(F.lit("A"), F.lpad((number % 12).cast("string"), 2, "0"))
    return t.table(spark, sf_dir, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("snapshot"), asset(F.col("user_id")).alias("base"),
        asset(F.get_json_object("props", "$.k").cast("long")).alias("quote"), (1 + F.col("value") / 10_000).alias("price"))


@query(q.with_(_GRAPH) + "SELECT snapshot, a, b, c, round(edge_bps, 5) AS edge_bps FROM tr")
def triangle_listing(spark, sf_dir):
    return rounded(tri.list_triangles(price_graph(spark, sf_dir)), edge_bps=5)


@query(q.with_(_GRAPH) + _ASSET_COLS)
def triangle_assets(spark, sf_dir):
    return rounded(tri.triangle_assets(tri.list_triangles(price_graph(spark, sf_dir))), viable_share=9, mean_edge_bps=4, max_edge_bps=4)


@query(q.with_(_GRAPH) + _ASSET_COLS + " ORDER BY ta.max_edge_bps DESC, asset LIMIT 5")
def triangle_top_assets(spark, sf_dir):
    out = tri.top_assets(tri.triangle_assets(tri.list_triangles(price_graph(spark, sf_dir))))
    return rounded(out, viable_share=9, mean_edge_bps=4, max_edge_bps=4)
