"""Registered queries: regimes, remaining features and entry rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.functions.series import number_rows, own_rows
from barloom.operators import bars as b
from barloom.operators import features as ft
from barloom.operators import regime as rg
from barloom.operators import signals as sg
from barloom.session import cut_lineage
from barloom.sources import market as m
from barloom.sources import tables as t


def funded_bars(spark, sf_dir):
    bars = t.bars(spark, sf_dir).join(t.funding(spark, sf_dir), ["asset", "ts"], "left")
    return cut_lineage(number_rows(cut_lineage(bars)))


def rule_bars(spark, sf_dir):
    """Numbered bars with all that the rules read: funding, imbalance and the leader's return."""
    bars = cut_lineage(t.bars(spark, sf_dir).join(t.funding(spark, sf_dir), ["asset", "ts"], "left")
                       .join(t.imbalance(spark, sf_dir), ["asset", "ts"], "left"))
    regime = rg.leader_regime(rg.leader_bars(bars, t.LEADER))
    return cut_lineage(number_rows(cut_lineage(rg.leader_return_on_bars(bars, regime))))


def rounded(df, **digits):
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def win(n: int, shift: int = 1) -> str:
    return f"(PARTITION BY asset ORDER BY bar ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"


def prior(fn: str, value: str, n: int, extra: str = "") -> str:
    arg = f"{value}, {extra}" if extra else value
    return f"CASE WHEN bar >= {n} THEN {fn}({arg}) OVER {win(n)} END"


LAG = lambda c: f'lag({c}) OVER (PARTITION BY asset ORDER BY bar)'

# Bars with funding, and every rule's side on usable bars.
FUNDED = q.TICKS + ",\n" + q.FUNDING + ",\n" + q.BARS.split("bars AS (", 1)[1].join(["bars0 AS (", ""]) + """,
bars AS (SELECT b.*, f.funding_rate FROM bars0 b LEFT JOIN funding f ON f.asset = b.asset AND f.ts = b.ts)"""
FUNDED_FEATURES = FUNDED + ",\n" + q.feature_ctes(", funding_rate")

RANKS = f"""rk0 AS (SELECT asset, bar, bb_width, list(bb_width) OVER {win(100, 0)} AS w FROM tf),
rk AS (SELECT asset, bar, CASE WHEN len(w) = 100 THEN (len(list_filter(w, lambda v: v < bb_width))
    + (len(list_filter(w, lambda v: v = bb_width)) + 1) / 2.0::DOUBLE) / 100.0::DOUBLE END AS r FROM rk0),
tr AS (SELECT tf.*, lag(r) OVER (PARTITION BY tf.asset ORDER BY tf.bar) AS bb_width_rank FROM tf JOIN rk USING (asset, bar))"""

CROSS = f"""x AS (SELECT tr.*, {prior('max', 'high', 20)} AS ph, {prior('min', 'low', 20)} AS pl,
    {prior('max', 'close', 20)} AS pch, {prior('min', 'close', 20)} AS pcl,
    {prior('max', 'obv', 20)} AS poh, {prior('min', 'obv', 20)} AS pol,
    {LAG('"RSI_14"')} AS prsi, {LAG('bb_position')} AS ppos FROM tr),
sides AS (SELECT *,
  CASE WHEN close < pl THEN -1 WHEN close > ph THEN 1 ELSE 0 END AS breakout,
  CASE WHEN prsi > 70 AND "RSI_14" <= 70 THEN -1 WHEN prsi < 30 AND "RSI_14" >= 30 THEN 1 ELSE 0 END AS reversion,
  CASE WHEN close < pl AND bb_width_rank <= 0.35 THEN -1 WHEN close > ph AND bb_width_rank <= 0.35 THEN 1 ELSE 0 END AS vol_breakout,
  CASE WHEN close_to_sma20 < 0 AND close_to_sma50 < 0 AND prsi > 55 AND "RSI_14" <= 55 THEN -1
       WHEN close_to_sma20 > 0 AND close_to_sma50 > 0 AND prsi < 45 AND "RSI_14" >= 45 THEN 1 ELSE 0 END AS trend_pullback,
  CASE WHEN ppos >= 0.9 AND bb_position < 0.9 AND "ATR_ratio" < 1.05 THEN -1
       WHEN ppos <= -0.9 AND bb_position > -0.9 AND "ATR_ratio" < 1.05 THEN 1 ELSE 0 END AS range_fade,
  CASE WHEN close < pcl AND NOT coalesce(obv < pol, FALSE) THEN 1 WHEN close > pch AND NOT coalesce(obv > poh, FALSE) THEN -1 ELSE 0 END AS obv_divergence
  FROM x)"""
SIDES = q.FEATURES + ",\n" + RANKS + ",\n" + CROSS


def plain_sides(bars, *names):
    frame = ft.feature_frame(bars, balance="obv_divergence" in names)
    return sg.signal_sides(frame, {n: sg.RULES[n]() for n in names})


def _rule(name):
    sql = q.with_(SIDES, recursive=True) + f"SELECT asset, ts, bar, {name} AS side FROM sides WHERE {name} <> 0"

    def build(spark, sf_dir):
        return sg.candidates(plain_sides(t.numbered_bars(spark, sf_dir), name), [name]).select("asset", "ts", "bar", "side")
    build.__name__ = f"signal_{name}"
    return query(sql)(build)


for _name in ("breakout", "reversion", "vol_breakout", "trend_pullback", "range_fade", "obv_divergence"):
    _rule(_name)


FUNDING_SIDES = f"""x AS (SELECT *, {prior('quantile_cont', 'funding_rate', 90, '0.9')} AS hi, {prior('quantile_cont', 'funding_rate', 90, '0.1')} AS lo,
    {LAG('funding_rate')} AS pf FROM tf),
fs AS (SELECT *, CASE WHEN pf >= lo AND funding_rate < lo THEN 1 WHEN pf <= hi AND funding_rate > hi THEN -1 ELSE 0 END AS base FROM x)"""
_FSQL = q.with_(FUNDED_FEATURES, FUNDING_SIDES, recursive=True)


def _funding_rule(spark, sf_dir, name):
    frame = ft.feature_frame(funded_bars(spark, sf_dir), balance=False)
    sides = sg.signal_sides(frame, {name: sg.RULES[name]()}, {"funding_rate": 90})
    return sg.candidates(sides, [name]).select("asset", "ts", "bar", "side")


@query(_FSQL + "SELECT asset, ts, bar, base AS side FROM fs WHERE base <> 0")
def signal_funding_reversion(spark, sf_dir):
    return _funding_rule(spark, sf_dir, "funding_reversion")


@query(_FSQL + """SELECT asset, ts, bar, base AS side FROM fs
WHERE (base = 1 AND bb_position < -0.5) OR (base = -1 AND bb_position > 0.5)""")
def signal_funding_reversion_confirmed(spark, sf_dir):
    return _funding_rule(spark, sf_dir, "funding_reversion_confirmed")


@query(_FSQL + 'SELECT asset, ts, bar, base AS side FROM fs WHERE base <> 0 AND "ATR_ratio" < 1.05')
def signal_funding_reversion_regime_filtered(spark, sf_dir):
    return _funding_rule(spark, sf_dir, "funding_reversion_regime_filtered")


@query(_FSQL + """SELECT asset, ts, bar, round(funding_rate - lag(funding_rate) OVER w, 12) AS funding_rate_diff,
  round(avg(funding_rate) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 10) AS funding_sma_5
FROM feat WINDOW w AS (PARTITION BY asset ORDER BY pos) QUALIFY bar >= 0""")
def feature_funding(spark, sf_dir):
    rows = ft.features(funded_bars(spark, sf_dir), balance=False).select("asset", "ts", "bar", *ft.FUNDING_FEATURES)
    return rounded(rows, funding_rate_diff=12, funding_sma_5=10)


# Hourly book bars: imbalance features and the order-flow rule.
_BOOK = q.with_("""raw AS (SELECT CAST(user_id % 5 AS VARCHAR) AS asset, event_id AS seq,
    time_bucket(INTERVAL 1 millisecond, ts) AS ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    event_type IN ('purchase', 'signup') AS buy FROM events),
bb AS (SELECT asset, date_trunc('hour', ts) AS ts, sum(CASE WHEN buy THEN k ELSE k / 2 END) AS bq, sum(CASE WHEN buy THEN k / 2 ELSE k END) AS aq
  FROM raw GROUP BY 1, 2),
ob AS (SELECT asset, ts, bq / (bq + aq + 1e-9) AS obi, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS pos FROM bb),
tf AS (SELECT *, pos - 49 AS bar, obi - lag(obi) OVER (PARTITION BY asset ORDER BY pos) AS obi_diff,
    avg(obi) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS obi_sma_5 FROM ob QUALIFY bar >= 0)""")


def book_frame(spark, sf_dir):
    hourly = b.book_bars(m.normalise_book(t.book_ticks(spark, sf_dir)), "1h", seq_in_time_order=True)
    rows = cut_lineage(hourly.select("asset", "ts", "open", "high", "low", "close", "obi"))
    return ft.feature_frame(cut_lineage(number_rows(rows)))


@query(_BOOK + """SELECT asset, ts, bar, round(obi, 9) AS obi_raw, round(obi - 0.5, 9) AS obi_imbalance,
  round(obi_diff, 9) AS obi_diff, round(obi_sma_5, 9) AS obi_sma_5 FROM tf""")
def feature_book(spark, sf_dir):
    rows = own_rows(book_frame(spark, sf_dir).filter("bar >= 0")).select("asset", "ts", "bar", *ft.BOOK_FEATURES)
    return rounded(rows, **{c: 9 for c in ft.BOOK_FEATURES})


@query(_BOOK + f""", x AS (SELECT *, {prior('quantile_cont', 'obi', 48, '0.9')} AS hi, {prior('quantile_cont', 'obi', 48, '0.1')} AS lo,
    {LAG('obi')} AS p FROM tf),
s AS (SELECT asset, ts, bar, CASE WHEN p >= lo AND obi < lo THEN -1 WHEN p <= hi AND obi > hi THEN 1 ELSE 0 END AS side FROM x)
SELECT * FROM s WHERE side <> 0""")
def signal_obi_momentum(spark, sf_dir):
    sides = sg.signal_sides(book_frame(spark, sf_dir), {"obi_momentum": sg.obi_momentum(48)}, {"obi": 48})
    return sg.candidates(sides, ["obi_momentum"]).select("asset", "ts", "bar", "side")


# Leader regime.
REGIME = f"""reg AS (SELECT ts, CASE WHEN ema_12 - ema_26 > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trend,
    "MACDh_12_26_9" AS trend_strength, CASE WHEN close_to_sma50 IS NOT NULL AND close > s50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS above_sma,
    ret_5d AS leader_ret_5, realized_vol_10 / sqrt(365) * sqrt(365 * 6) AS leader_vol, vol_regime AS leader_vol_ratio0,
    (realized_vol_10 / sqrt(365)) / (realized_vol_30 / sqrt(365) + 1e-9) AS leader_vol_ratio,
    close, s50 FROM feat WHERE asset = 'Brand#1')"""
_LEADER_FEATURES = q.BARS + ",\n" + q.feature_ctes(", s50")


@query(q.with_(_LEADER_FEATURES, REGIME, recursive=True) + """SELECT ts, trend, round(trend_strength, 7) AS trend_strength, above_sma,
  round(leader_ret_5, 8) AS leader_ret_5, round(leader_vol, 6) AS leader_vol, round(leader_vol_ratio, 7) AS leader_vol_ratio FROM reg""")
def leader_regime(spark, sf_dir):
    out = rg.leader_regime(rg.leader_bars(t.bars(spark, sf_dir), t.LEADER))
    return rounded(out, trend_strength=7, leader_ret_5=8, leader_vol=6, leader_vol_ratio=7)


@query(q.with_(SIDES.replace("s20 + 1e-9) AS bb_width", "s20 + 1e-9) AS bb_width, s50"), REGIME, recursive=True) + """
SELECT s.asset, s.ts, s.bar, s.breakout AS side,
  CASE WHEN r.trend IS NOT NULL THEN CAST(sign(s.breakout) = sign(r.trend) AS INT)::DOUBLE END AS alignment,
  CASE WHEN r.above_sma IS NOT NULL THEN CAST(sign(s.breakout) = sign(r.above_sma) AS INT)::DOUBLE END AS alignment_sma,
  round(s.breakout * r.trend_strength, 7) AS alignment_strength, round(s.breakout * r.leader_ret_5, 8) AS ret_5_aligned
FROM sides s LEFT JOIN reg r ON r.ts = s.ts WHERE s.breakout <> 0""")
def regime_alignment(spark, sf_dir):
    trades = sg.candidates(plain_sides(t.numbered_bars(spark, sf_dir), "breakout"), ["breakout"]).select("asset", "ts", "bar", "side")
    regime = rg.leader_regime(rg.leader_bars(t.bars(spark, sf_dir), t.LEADER))
    out = rg.align_with_regime(trades, regime).drop(*rg.REGIME_COLUMNS)
    return rounded(out, alignment_strength=7, ret_5_aligned=8)


STRENGTH = """strength AS (SELECT ts, tanh((close / (CASE WHEN pos >= 49 THEN avg(close) OVER (ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END + 1e-9) - 1.0) * 10.0)
    AS leader_strength FROM bars WHERE asset = 'Brand#1')"""


@query(q.with_(q.BARS, STRENGTH) + "SELECT ts, round(leader_strength, 9) AS leader_strength FROM strength")
def leader_strength(spark, sf_dir):
    return rounded(rg.leader_strength(rg.leader_bars(t.bars(spark, sf_dir), t.LEADER)), leader_strength=9)


@query(q.with_(_LEADER_FEATURES, """lr AS (SELECT ts, ret_5d FROM feat WHERE asset = 'Brand#1'),
lj AS (SELECT b.asset, b.ts, b.pos, last_value(lr.ret_5d IGNORE NULLS) OVER (PARTITION BY b.asset ORDER BY b.ts) AS r
  FROM bars b LEFT JOIN lr ON lr.ts = b.ts),
wm AS (SELECT asset, greatest(69, min(pos) FILTER (WHERE r IS NOT NULL)) AS w FROM lj GROUP BY asset),
ll AS (SELECT lj.*, pos - w AS bar, lag(r) OVER (PARTITION BY lj.asset ORDER BY pos) AS p0 FROM lj JOIN wm ON wm.asset = lj.asset),
ls AS (SELECT *, CASE WHEN bar >= 1 THEN p0 END AS p FROM ll WHERE bar >= 0),
s AS (SELECT asset, ts, bar, CASE WHEN p >= -0.03 AND r < -0.03 THEN -1 WHEN p <= 0.03 AND r > 0.03 THEN 1 ELSE 0 END AS side FROM ls)""",
                 recursive=True) + "SELECT * FROM s WHERE side <> 0")
def signal_btc_lead_lag(spark, sf_dir):
    bars = cut_lineage(t.bars(spark, sf_dir))
    regime = rg.leader_regime(rg.leader_bars(bars, t.LEADER))
    numbered = cut_lineage(number_rows(cut_lineage(rg.leader_return_on_bars(bars, regime))))
    sides = sg.signal_sides(ft.feature_frame(numbered, balance=False), {"btc_lead_lag": sg.btc_lead_lag()})
    return sg.candidates(sides, ["btc_lead_lag"]).select("asset", "ts", "bar", "side")


@query(q.with_(SIDES, recursive=True) + "SELECT asset, ts, bar, bb_width_rank FROM tr")
def feature_width_rank(spark, sf_dir):
    frame = sg.with_helpers(ft.feature_frame(t.numbered_bars(spark, sf_dir), balance=False))
    return own_rows(frame.filter("bar >= 0")).select("asset", "ts", "bar", "bb_width_rank")


# Bars with funding, imbalance and the leader's return; the latest of them decides the first usable bar.
RULE_BARS = FUNDED.split(",\nbars AS (", 1)[0] + """,
imb AS (SELECT asset, ts, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE qty END) AS DOUBLE) / (sum(qty) + 1e-9::DOUBLE) AS obi FROM ticks GROUP BY asset, ts),
lr AS (SELECT ts, close / lag(close, 5) OVER (ORDER BY pos) - 1 AS r FROM bars0 WHERE asset = 'Brand#1'),
bars AS (SELECT b.*, f.funding_rate, i.obi, last_value(lr.r IGNORE NULLS) OVER (PARTITION BY b.asset ORDER BY b.ts) AS leader_ret_5
  FROM bars0 b LEFT JOIN funding f ON f.asset = b.asset AND f.ts = b.ts LEFT JOIN imb i ON i.asset = b.asset AND i.ts = b.ts LEFT JOIN lr ON lr.ts = b.ts)"""
_ALL_FEATURES = q.feature_ctes(", funding_rate, obi, leader_ret_5").replace("tf AS (SELECT * FROM feat WHERE bar >= 0)", """wm AS (
  SELECT asset, greatest(69, min(pos) FILTER (WHERE funding_rate IS NOT NULL) + 4, min(pos) FILTER (WHERE obi IS NOT NULL) + 4,
    min(pos) FILTER (WHERE leader_ret_5 IS NOT NULL)) AS w FROM bars GROUP BY asset),
tf AS (SELECT feat.* REPLACE (pos - w AS bar) FROM feat JOIN wm USING (asset) WHERE pos >= w)""")
_ALL_SIDES = f"""y AS (SELECT *, {prior('quantile_cont', 'funding_rate', 90, '0.9')} AS fhi, {prior('quantile_cont', 'funding_rate', 90, '0.1')} AS flo,
    {prior('quantile_cont', 'obi', 288, '0.9')} AS ohi, {prior('quantile_cont', 'obi', 288, '0.1')} AS olo,
    {LAG('funding_rate')} AS pf, {LAG('obi')} AS po, {LAG('leader_ret_5')} AS pr FROM sides),
y2 AS (SELECT *, CASE WHEN pf >= flo AND funding_rate < flo THEN 1 WHEN pf <= fhi AND funding_rate > fhi THEN -1 ELSE 0 END AS funding_reversion,
  CASE WHEN po >= olo AND obi < olo THEN -1 WHEN po <= ohi AND obi > ohi THEN 1 ELSE 0 END AS obi_momentum,
  CASE WHEN pr >= -0.03 AND leader_ret_5 < -0.03 THEN -1 WHEN pr <= 0.03 AND leader_ret_5 > 0.03 THEN 1 ELSE 0 END AS btc_lead_lag FROM y),
whole AS (SELECT *, CASE WHEN (funding_reversion = 1 AND bb_position < -0.5) OR (funding_reversion = -1 AND bb_position > 0.5)
    THEN funding_reversion ELSE 0 END AS funding_reversion_confirmed,
  CASE WHEN "ATR_ratio" < 1.05 THEN funding_reversion ELSE 0 END AS funding_reversion_regime_filtered FROM y2)"""


@query(q.with_(RULE_BARS, _ALL_FEATURES, RANKS, CROSS, _ALL_SIDES, recursive=True) + " UNION ALL ".join(
    f"SELECT asset, ts, bar, '{n}' AS signal, {n} AS side FROM whole WHERE {n} <> 0" for n in sg.RULES))
def signal_registry(spark, sf_dir):
    """Every rule in one pass over bars that carry all that the rules read."""
    sides = plain_sides(rule_bars(spark, sf_dir), *sg.RULES)
    return sg.candidates(sides, sg.RULES).select("asset", "ts", "bar", "signal", "side")


_W14 = 1.0 / 14


#: Wilder's index by recursion: ``o`` holds it for every bar.
ADX = f"""m AS (SELECT *, greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) AS tr,
    high - {q.lag('high')} AS um, {q.lag('low')} - low AS dm FROM bars),
m2 AS (SELECT *, CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS pdm, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS mdm FROM m),
{q.ewm('ea', 'm2', _W14, 'tr')}, {q.ewm('ep', 'm2', _W14, 'pdm')}, {q.ewm('em', 'm2', _W14, 'mdm')},
di AS (SELECT m2.asset, m2.pos, m2.ts, 100 * (ep.y / nullif(ea.y, 0)) AS plus_di, 100 * (em.y / nullif(ea.y, 0)) AS minus_di
  FROM m2 JOIN ea USING (asset, pos) JOIN ep USING (asset, pos) JOIN em USING (asset, pos)),
dx AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-9) AS dx FROM di),
{q.ewm('ex', 'dx', _W14, 'dx')}, o AS (SELECT dx.*, ex.y AS adx FROM dx LEFT JOIN ex USING (asset, pos))"""


@query(q.with_(q.BARS, ADX, recursive=True) + """SELECT asset, ts, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round(adx, 6) AS adx,
  CASE WHEN adx > 25 THEN 1 ELSE 0 END AS trending,
  round(coalesce(lag(adx) OVER (PARTITION BY asset ORDER BY pos), 0), 6) AS adx_prior FROM o""")
def feature_adx(spark, sf_dir):
    out = ft.average_directional_index(t.numbered_bars(spark, sf_dir))
    return rounded(out.select("asset", "ts", "plus_di", "minus_di", "adx", "trending", "adx_prior"),
                   plus_di=6, minus_di=6, adx=6, adx_prior=6)


@query(q.with_(q.FEATURES, recursive=True) + """, n AS (SELECT asset, ts, bar, lead(ret_1d) OVER (PARTITION BY asset ORDER BY bar) AS r FROM tf)
SELECT asset, ts, bar, CASE WHEN r > 0.05 THEN 1 ELSE 0 END AS target FROM n WHERE r > 0.05 OR r < -0.05""")
def feature_direction_target(spark, sf_dir):
    rows = ft.features(t.numbered_bars(spark, sf_dir), balance=False).select("asset", "ts", "pos", "bar", "ret_1d")
    return ft.direction_target(rows, 0.05).select("asset", "ts", "bar", "target")


@query(q.with_(q.BARS) + f"SELECT asset, ts, round({q.roll('avg', '(high - low)', 60)}, 5) AS range_vol FROM bars")
def feature_quote_volatility(spark, sf_dir):
    out = ft.quote_volatility(t.numbered_bars(spark, sf_dir)).select("asset", "ts", "range_vol")
    return rounded(out, range_vol=5)
