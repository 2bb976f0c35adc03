"""Registered queries: labels, fills, gating and trade economics."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.catalog.signals import SIDES, STRENGTH, plain_sides, rounded
from barloom.functions.stats import wilson_bound
from barloom.operators import economics as ec
from barloom.operators import features as ft
from barloom.operators import gating as g
from barloom.operators import labels as lb
from barloom.operators import regime as rg
from barloom.operators import signals as sg
from barloom.session import cut_lineage
from barloom.sources import tables as t

KEYS = ["asset", "signal", "bar"]
RULES = ["breakout", "reversion", "vol_breakout", "trend_pullback", "range_fade"]


def trade_id():
    return F.concat_ws("_", "asset", "signal", F.col("bar").cast("string"))


def pool_sql(rules) -> str:
    return "cand AS (" + " UNION ALL ".join(
        f"SELECT *, '{n}' AS signal, {n} AS side FROM sides WHERE {n} <> 0" for n in rules) + ")"


def label_sql(out: str, orders: str, horizon: int, pt: str, sl: str, keys: str = "asset, signal, bar") -> str:
    """SQL twin of first-touch labelling; ``orders`` has anchor, side, price, risk."""
    using = f"USING ({keys})"
    own = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    return f"""{out}_o AS (SELECT *, price + CASE WHEN side > 0 THEN {pt} * risk ELSE {sl} * risk END AS upper,
    price - CASE WHEN side > 0 THEN {sl} * risk ELSE {pt} * risk END AS lower FROM {orders}),
{out}_t AS (SELECT {own}, min(b.bar - o.anchor) FILTER (WHERE b.high >= upper OR b.low <= lower) AS hit,
    arg_min(b.high >= upper, b.bar) FILTER (WHERE b.high >= upper OR b.low <= lower) AS hu,
    arg_min(b.low <= lower, b.bar) FILTER (WHERE b.high >= upper OR b.low <= lower) AS hd,
    max(b.bar - o.anchor) AS last_k, arg_max(b.close, b.bar) AS last_close
  FROM {out}_o o JOIN tf b ON b.asset = o.asset AND b.bar > o.anchor AND b.bar <= o.anchor + {horizon} GROUP BY ALL),
{out}_x AS (SELECT o.*, hit, hu, hd, last_k, CASE WHEN hit IS NULL THEN coalesce(last_close, price)
    WHEN hu AND hd THEN CASE WHEN side > 0 THEN lower ELSE upper END WHEN hu THEN upper ELSE lower END AS exit_price
  FROM {out}_o o LEFT JOIN {out}_t t {using}),
{out} AS (SELECT *, side * (exit_price / price - 1) AS ret, coalesce(hit, last_k, 0) AS hold, anchor AS entry_pos,
    anchor + coalesce(hit, last_k, 0) AS exit_pos,
    CASE WHEN hit IS NULL THEN CAST(side * (exit_price / price - 1) > 0 AS INT)
         WHEN side > 0 THEN CAST(NOT hd AS INT) ELSE CAST(NOT hu AS INT) END AS label FROM {out}_x)"""


def labelled_sql(rules, pt=2.0, sl=1.0, horizon=18) -> str:
    return (SIDES + ",\n" + pool_sql(rules) + ",\norders AS (SELECT *, bar AS anchor, close AS price, atr AS risk FROM cand),\n"
            + label_sql("lab", "orders", horizon, f"{pt}::DOUBLE", f"{sl}::DOUBLE"))


FILLS = """fl_o AS (SELECT *, close AS signal_price, bar AS signal_pos, close - side * (0.15::DOUBLE * atr) AS limit_price FROM cand),
fl_t AS (SELECT o.asset, o.signal, o.bar, min(b.bar - o.bar) AS wait_bars FROM fl_o o JOIN tf b
  ON b.asset = o.asset AND b.bar > o.bar AND b.bar <= o.bar + 3
  AND CASE WHEN o.side > 0 THEN b.low <= o.limit_price ELSE b.high >= o.limit_price END GROUP BY ALL),
fills AS (SELECT o.*, wait_bars, wait_bars IS NOT NULL AS filled, CASE WHEN wait_bars IS NOT NULL THEN limit_price END AS fill_price
  FROM fl_o o LEFT JOIN fl_t USING (asset, signal, bar))"""
FILL_LABELS = """forders AS (SELECT * EXCLUDE (wait_bars), wait_bars, bar + wait_bars AS anchor, fill_price AS price, atr AS risk FROM fills WHERE filled),
""" + label_sql("mk", "forders", 18, "2.0::DOUBLE", "1.0::DOUBLE")


def filled_sql(rules) -> str:
    return SIDES + ",\n" + pool_sql(rules) + ",\n" + FILLS


def candidate_pool(spark, sf_dir, rules, extra=()):
    """Price path by trimmed position, and the candidates of all rules."""
    bars = t.numbered_bars(spark, sf_dir)
    sides = plain_sides(bars, *rules)
    cand = sg.candidates(sides, rules).select(
        "asset", "ts", "signal", "bar", "side", "close", "atr", *extra)
    return ft.usable_path(bars), cand


def labelled(spark, sf_dir, rules=RULES, pt=2.0, sl=1.0, horizon=18, extra=()):
    path, cand = candidate_pool(spark, sf_dir, rules, extra)
    return lb.triple_barrier(cand, path, KEYS, pt, sl, horizon)


LABEL_COLS = ["asset", "ts", "signal", "bar", "side", "label", "ret", "hold", "entry_pos", "exit_pos"]
LABEL_SQL_COLS = "asset, ts, signal, bar, side, label, round(ret, 7) AS ret, hold, entry_pos, exit_pos"


@query(q.with_(labelled_sql(["breakout"]), recursive=True) + """SELECT asset, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins,
  round(avg(label), 8) AS win_rate,
  round(CASE WHEN coalesce(sum(ret - 0.004) FILTER (WHERE ret - 0.004 <= 0), 0) <> 0
    THEN coalesce(sum(ret - 0.004) FILTER (WHERE ret - 0.004 > 0), 0) / abs(sum(ret - 0.004) FILTER (WHERE ret - 0.004 <= 0))
    WHEN count(*) FILTER (WHERE ret - 0.004 > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 7) AS profit_factor,
  round(avg(ret - 0.004), 7) AS expectancy FROM lab GROUP BY asset""")
def breakout_economics(spark, sf_dir):
    """Bars -> ATR -> breakout -> triple barrier -> net economics per asset."""
    trades = labelled(spark, sf_dir, ["breakout"])
    return rounded(ec.net_economics(trades, ["asset"], 0.004), win_rate=8, profit_factor=7, expectancy=7)


@query(q.with_(labelled_sql(["breakout"]), recursive=True) + f"SELECT {LABEL_SQL_COLS} FROM lab")
def triple_barrier_labels(spark, sf_dir):
    return rounded(labelled(spark, sf_dir, ["breakout"]).select(*LABEL_COLS), ret=7)


_FILL_COLS = """asset, ts, signal, bar, side, round(limit_price, 5) AS limit_price, filled, round(fill_price, 5) AS fill_price, wait_bars"""


@query(q.with_(filled_sql(["vol_breakout"]), recursive=True) + f"SELECT {_FILL_COLS} FROM fills")
def limit_order_fills(spark, sf_dir):
    path, cand = candidate_pool(spark, sf_dir, ["vol_breakout"])
    out = lb.limit_fills(cand, path, KEYS)
    return rounded(out.select(*KEYS, "ts", "side", "limit_price", "filled", "fill_price", "wait_bars"),
                   limit_price=5, fill_price=5)


@query(q.with_(filled_sql(["vol_breakout"]), FILL_LABELS, recursive=True) + f"SELECT {LABEL_SQL_COLS}, wait_bars FROM mk")
def labels_from_fill(spark, sf_dir):
    path, cand = candidate_pool(spark, sf_dir, ["vol_breakout"])
    out = lb.triple_barrier_from_fill(lb.limit_fills(cand, path, KEYS), path, KEYS)
    return rounded(out.select(*LABEL_COLS, "wait_bars"), ret=7)


@query(q.with_(filled_sql(["breakout"]), recursive=True) + """SELECT coalesce(asset, 'ALL') AS asset, round(avg(CAST(filled AS INT)), 9) AS fill_rate,
  count(*) AS n, count(*) FILTER (WHERE side > 0) AS n_long, count(*) FILTER (WHERE side < 0) AS n_short FROM fills GROUP BY ROLLUP (asset)""")
def fill_rates(spark, sf_dir):
    path, cand = candidate_pool(spark, sf_dir, ["breakout"])
    return rounded(lb.fill_rate(lb.limit_fills(cand, path, KEYS)), fill_rate=9)


_BOTH = filled_sql(["range_fade"]) + """,
orders AS (SELECT *, bar AS anchor, close AS price, atr AS risk FROM cand),
""" + label_sql("lab", "orders", 18, "2.0::DOUBLE", "1.0::DOUBLE")


@query(q.with_(_BOTH, recursive=True) + """, r AS (SELECT count(*) FILTER (WHERE filled) AS n_filled, count(*) FILTER (WHERE NOT filled) AS n_unfilled,
  avg(label) FILTER (WHERE filled) AS fw, avg(label) FILTER (WHERE NOT filled) AS uw FROM lab JOIN fills USING (asset, signal, bar))
SELECT n_filled, n_unfilled, round(fw, 8) AS filled_win_rate, round(uw, 8) AS unfilled_win_rate, round(uw - fw, 8) AS gap,
  coalesce(uw - fw > 0.02, FALSE) AS adverse FROM r""")
def adverse_selection(spark, sf_dir):
    path, cand = candidate_pool(spark, sf_dir, ["range_fade"])
    out = lb.adverse_selection(lb.triple_barrier(cand, path, KEYS, 2.0, 1.0), lb.limit_fills(cand, path, KEYS), KEYS)
    return rounded(out, filled_win_rate=8, unfilled_win_rate=8, gap=8)


_SNAP = ["ATR_ratio", "bb_position", "roc_10"]


@query(q.with_(labelled_sql(["reversion"]), recursive=True) + """SELECT asset, ts, signal, bar, side, label, round("ATR_ratio", 7) AS "ATR_ratio",
  round(bb_position, 7) AS bb_position, round(roc_10, 7) AS roc_10 FROM lab""")
def candidate_snapshot(spark, sf_dir):
    out = labelled(spark, sf_dir, ["reversion"], extra=_SNAP)
    return rounded(out.select(*KEYS, "ts", "side", "label", *_SNAP), ATR_ratio=7, bb_position=7, roc_10=7)


@query(q.with_(labelled_sql(RULES), recursive=True) + f"SELECT {LABEL_SQL_COLS} FROM lab")
def candidate_pool_labels(spark, sf_dir):
    """All rules of all assets labelled in one job."""
    return rounded(labelled(spark, sf_dir).select(*LABEL_COLS), ret=7)


GRID = [(0.5, 1.0), (1.0, 1.0), (1.5, 1.0), (2.0, 1.0), (2.0, 2.0)]
_GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in GRID) + ") v(pt, sl))"


def geometry_grid(cand):
    cells = F.array(*[F.struct(F.lit(a).alias("pt"), F.lit(b).alias("sl")) for a, b in GRID])
    return cand.withColumn("_g", F.explode(cells)).select("*", "_g.pt", "_g.sl").drop("_g")


@query(q.with_(SIDES, pool_sql(RULES), _GRID_SQL, """orders AS (SELECT cand.*, pt, sl, bar AS anchor, close AS price, atr AS risk FROM cand, grid)""",
               label_sql("lab", "orders", 18, "pt", "sl", "asset, signal, bar, pt, sl"), recursive=True)
       + """, e AS (SELECT signal, pt, sl, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins, avg(label) AS win_rate,
  coalesce(sum(ret - 0.004) FILTER (WHERE ret - 0.004 > 0), 0) AS w, coalesce(sum(ret - 0.004) FILTER (WHERE ret - 0.004 <= 0), 0) AS l,
  count(*) FILTER (WHERE ret - 0.004 > 0) AS nw, avg(ret - 0.004) AS x FROM lab GROUP BY ALL)
SELECT signal, pt, sl, round(1 / (1 + pt / sl), 9) AS breakeven, n, n_wins, round(win_rate, 8) AS win_rate,
  round(CASE WHEN l <> 0 THEN w / abs(l) WHEN nw > 0 THEN 'inf'::DOUBLE ELSE 0 END, 7) AS profit_factor, round(x, 7) AS expectancy FROM e""")
def barrier_geometry_sweep(spark, sf_dir):
    path, cand = candidate_pool(spark, sf_dir, RULES)
    trades = lb.triple_barrier(geometry_grid(cand), path, [*KEYS, "pt", "sl"], F.col("pt"), F.col("sl"), 18)
    out = ec.net_economics(trades, ["signal", "pt", "sl"], 0.004).withColumn(
        "breakeven", 1.0 / (1.0 + F.col("pt") / F.col("sl")))
    return rounded(out, breakeven=9, win_rate=8, profit_factor=7, expectancy=7)


_APPROVED = "approved AS (SELECT asset, ts FROM cand WHERE extract(day FROM ts) % 2 = 0)"


@query(q.with_(SIDES, pool_sql(["trend_pullback"]).replace("cand AS", "cand0 AS"),
               _APPROVED.replace("FROM cand", "FROM cand0"), "cand AS (SELECT c.* FROM cand0 c SEMI JOIN approved a ON a.asset = c.asset AND a.ts = c.ts)",
               FILLS, FILL_LABELS, recursive=True) + f"SELECT {LABEL_SQL_COLS}, wait_bars FROM mk")
def relabel_approved(spark, sf_dir):
    """Limit fills and labels for an approved subset only."""
    path, cand = candidate_pool(spark, sf_dir, ["trend_pullback"])
    approved = cand.filter(F.day("ts") % 2 == 0).select("asset", "ts")
    kept = cand.join(approved, ["asset", "ts"], "left_semi")
    out = lb.triple_barrier_from_fill(lb.limit_fills(kept, path, KEYS), path, KEYS)
    return rounded(out.select(*LABEL_COLS, "wait_bars"), ret=7)


@query(q.with_(q.BARS) + f""", v AS (SELECT *, {q.roll('avg', '(high - low)', 60)} AS rv FROM bars),
qs AS (SELECT *, {q.lag('close')} - 2.0::DOUBLE * {q.lag('rv')} AS bid, {q.lag('close')} + 2.0::DOUBLE * {q.lag('rv')} AS ask FROM v)
SELECT asset, count(bid) AS n_quotes, count(*) FILTER (WHERE low <= bid) AS bid_touches, count(*) FILTER (WHERE high >= ask) AS ask_touches,
  round(avg(ask) FILTER (WHERE high >= ask) - avg(bid) FILTER (WHERE low <= bid), 4) AS captured_spread FROM qs GROUP BY asset""")
def quote_touch_study(spark, sf_dir):
    bars = ft.quote_volatility(t.numbered_bars(spark, sf_dir))
    return rounded(lb.quote_touches(bars, 2.0), captured_spread=4)


# ------------------------------------------------------------------ gating

UNIT = "(('0x' || substr(md5(trade_id || '_{salt}'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"
SCORED = """scored AS (SELECT *, {p} AS p_win, {n} < 0.2 AS is_novel,
    CASE WHEN {a} < 0.45 THEN 1.0::DOUBLE WHEN {a} < 0.9 THEN 0.0::DOUBLE END AS alignment
  FROM (SELECT *, asset || '_' || signal || '_' || bar AS trade_id FROM lab))""".format(
    p=UNIT.format(salt="p"), n=UNIT.format(salt="n"), a=UNIT.format(salt="a"))


def with_scores(trades):
    """Repeatable stand-ins for model output on given trades."""
    base = trades.withColumn("trade_id", trade_id())
    unit = lambda salt: t.unit_draw(F.col("trade_id"), F.lit(salt))
    a = unit("a")
    return base.select("*", unit("p").alias("p_win"), (unit("n") < 0.2).alias("is_novel"),
                       F.when(a < 0.45, 1.0).when(a < 0.9, 0.0).alias("alignment"))


def scored_trades(spark, sf_dir, rules=RULES, extra=()):
    return with_scores(labelled(spark, sf_dir, rules, extra=extra))


THRESHOLD = """thr AS (SELECT *, least(greatest(0.55 + CASE WHEN alignment >= 0.5 THEN -0.02 ELSE 0.08 END + CASE WHEN is_novel THEN 0.06 ELSE 0 END,
    greatest(0.55 - 0.10, 0.05)), least(0.55 + 0.15, 0.99)) AS threshold FROM scored)"""
_SC = labelled_sql(RULES) + ",\n" + SCORED


@query(q.with_(_SC, THRESHOLD, recursive=True) + """SELECT trade_id, round(p_win, 9) AS p_win, is_novel, alignment, round(threshold, 9) AS threshold,
  p_win >= threshold AS taken FROM thr""")
def gate_thresholds(spark, sf_dir):
    out = g.gate(scored_trades(spark, sf_dir), F.lit(0.55), alignment="alignment", novel="is_novel")
    return rounded(out.select("trade_id", "p_win", "is_novel", "alignment", "threshold", "taken"), p_win=9, threshold=9)


@query(q.with_(_SC, THRESHOLD, recursive=True) + """SELECT signal, count(*) AS n, count(*) FILTER (WHERE p_win >= threshold AND NOT is_novel) AS n_taken,
  round(avg(label) FILTER (WHERE p_win >= threshold AND NOT is_novel), 8) AS win_rate FROM thr GROUP BY signal""")
def gate_hard_reject(spark, sf_dir):
    out = g.gate(scored_trades(spark, sf_dir), F.lit(0.55), alignment="alignment", novel="is_novel", reject_novel=True)
    return out.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("taken").cast("long")).alias("n_taken"),
        F.round(F.avg(F.when(F.col("taken"), F.col("label"))), 8).alias("win_rate"))


NON_OVERLAP = """ordered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY entry_pos, signal) AS rn FROM {src}),
walk AS (SELECT asset, rn, exit_pos AS busy, TRUE AS keep FROM ordered WHERE rn = 1
  UNION ALL SELECT o.asset, o.rn, CASE WHEN o.entry_pos >= w.busy THEN o.exit_pos ELSE w.busy END, o.entry_pos >= w.busy
  FROM walk w JOIN ordered o ON o.asset = w.asset AND o.rn = w.rn + 1),
kept AS (SELECT o.* FROM ordered o JOIN walk w USING (asset, rn) WHERE w.keep)"""


@query(q.with_(labelled_sql(RULES), NON_OVERLAP.format(src="lab"), recursive=True) + "SELECT asset, signal, bar, side, entry_pos, exit_pos FROM kept")
def non_overlapping_trades(spark, sf_dir):
    trades = labelled(spark, sf_dir).select("asset", "signal", "bar", "side", "entry_pos", "exit_pos")
    return g.non_overlapping(trades, reach=18)


CONVICTION = f"""st AS (SELECT l.*, s.leader_strength FROM lab l ASOF LEFT JOIN (SELECT * FROM strength WHERE leader_strength IS NOT NULL) s ON l.ts >= s.ts),
conv AS (SELECT *, CASE WHEN leader_strength IS NOT NULL THEN 0.40 * least(greatest(0.5 + 0.5 * side * leader_strength, 0), 1)
  + 0.30 * least(greatest(CASE WHEN signal IN ('breakout', 'vol_breakout', 'trend_pullback') THEN 1.0 - coalesce(bb_width_rank, 0.5)
      ELSE least(greatest(1.2 - coalesce("ATR_ratio", 1.0), 0), 1) END, 0), 1)
  + 0.30 * least(greatest(CASE WHEN signal IN ('breakout', 'vol_breakout', 'trend_pullback') THEN 0.5 + 0.5 * side * sign(close_to_sma50)
      ELSE 0.5 - 0.5 * side * sign(close_to_sma50) END, 0), 1) END AS score0 FROM st),
scd AS (SELECT *, round(score0, 9) AS score FROM conv WHERE score0 IS NOT NULL)"""
_CONV = labelled_sql(RULES) + ",\n" + STRENGTH + ",\n" + CONVICTION


def conviction_trades(spark, sf_dir):
    """Labelled candidates of all rules with their ranking score."""
    trades = labelled(spark, sf_dir, extra=["bb_width_rank", "ATR_ratio", "close_to_sma50"])
    strength = rg.leader_strength(rg.leader_bars(t.bars(spark, sf_dir), t.LEADER))
    ranked = rg.strength_at(trades, strength)
    score = g.conviction_score(F.col("side"), F.col("signal"), F.col("bb_width_rank"), F.col("ATR_ratio"),
                               F.col("close_to_sma50"), F.col("leader_strength"))
    return ranked.withColumn("score", F.round(score, 9)).filter("score is not null")


@query(q.with_(_CONV, recursive=True) + "SELECT asset, ts, signal, side, score FROM scd")
def conviction_scores(spark, sf_dir):
    return conviction_trades(spark, sf_dir).select("asset", "ts", "signal", "side", "score")


@query(q.with_(_CONV, recursive=True) + """SELECT asset, ts, signal, side, score FROM scd
QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY score DESC, asset, signal, ts) <= 4""")
def top_signals_per_day(spark, sf_dir):
    return g.top_n_per_day(conviction_trades(spark, sf_dir), 4).select("asset", "ts", "signal", "side", "score")


@query(q.with_(_CONV, recursive=True) + "SELECT asset, ts, signal, side, score FROM scd WHERE score >= 0.6")
def select_by_threshold(spark, sf_dir):
    return g.by_threshold(conviction_trades(spark, sf_dir), 0.6).select("asset", "ts", "signal", "side", "score")


@query(q.with_(_CONV, recursive=True) + """, f AS (SELECT count(*) AS n, greatest(date_diff('day', min(ts), max(ts)), 1) AS span_days, min(score) AS lo,
  list(score ORDER BY score) AS s FROM scd)
SELECT n, span_days, round(CASE WHEN 2.0 * span_days >= n THEN lo ELSE quantile_at END, 8) AS threshold FROM (
  SELECT *, s[CAST(floor(a) AS INT) + 1] + (s[CAST(floor(a) AS INT) + 2] - s[CAST(floor(a) AS INT) + 1]) * (a - floor(a)) AS quantile_at
  FROM (SELECT *, (n - 1) * (1.0::DOUBLE - 2.0::DOUBLE * span_days / n) AS a FROM f))""")
def threshold_for_frequency(spark, sf_dir):
    return rounded(g.threshold_for_frequency(conviction_trades(spark, sf_dir), 2.0), threshold=8)


@query(q.with_(_SC, recursive=True) + "SELECT trade_id, round(least(greatest(0.5 * (p_win - (1 - p_win) / 2.0), 0), 1), 9) AS size FROM scored")
def kelly_sizes(spark, sf_dir):
    from barloom.functions.stats import kelly_size
    out = scored_trades(spark, sf_dir)
    return out.select("trade_id", F.round(kelly_size(F.col("p_win"), 2.0), 9).alias("size"))


@query(q.with_(_CONV, recursive=True) + """, top AS (SELECT asset, signal, bar FROM scd
QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY score DESC, asset, signal, ts) <= 1)
SELECT s.asset, s.signal, s.bar, t.bar IS NOT NULL AS selected FROM scd s LEFT JOIN top t USING (asset, signal, bar)""")
def selection_mask(spark, sf_dir):
    pool = conviction_trades(spark, sf_dir)
    return g.mark_selected(pool, g.top_n_per_day(pool, 1), KEYS).select(*KEYS, "selected")


def _thr_sql(align: str, novel: str) -> str:
    return f"""least(greatest(0.55 + {align} + {novel}, 0.45), 0.70)"""


_AL, _NV = "CASE WHEN alignment >= 0.5 THEN -0.02 ELSE 0.08 END", "CASE WHEN is_novel THEN 0.06 ELSE 0 END"
_VARIANTS = {"all": "TRUE", "fixed_055": "p_win >= 0.55", "calibrated": "p_win >= 0.5",
             "alignment": f"p_win >= {_thr_sql(_AL, '0').replace('0.55', '0.5').replace('0.45', '0.40').replace('0.70', '0.65')}",
             "novelty": f"p_win >= {_thr_sql('0', _NV).replace('0.55', '0.5').replace('0.45', '0.40').replace('0.70', '0.65')}",
             "full": f"p_win >= {_thr_sql(_AL, _NV).replace('0.55', '0.5').replace('0.45', '0.40').replace('0.70', '0.65')}"}
_NET = "(ret * size - size * 0.004)"


@query(q.with_(_SC, "var AS (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS variant, asset || '/{n}' AS grp FROM scored WHERE {c}" for n, c in _VARIANTS.items()) + ")",
    NON_OVERLAP.format(src="var").replace("PARTITION BY asset", "PARTITION BY grp").replace("SELECT asset, rn", "SELECT grp, rn")
    .replace("o.asset, o.rn", "o.grp, o.rn").replace("o.asset = w.asset", "o.grp = w.grp").replace("USING (asset, rn)", "USING (grp, rn)"),
    recursive=True) + f""", k AS (SELECT *, least(greatest(0.5 * (p_win - (1 - p_win) / 2.0), 0), 1) AS size FROM kept),
pool AS ({" UNION ALL ".join(f"SELECT '{n}' AS variant, label, {c} AS sel FROM scored" for n, c in _VARIANTS.items())}), {q.null_means("variant")},
pm AS (SELECT variant, CASE WHEN any_value(facts.n_selected) < any_value(n_pool) THEN (count(*) FILTER (WHERE m >= stat) + 1) / {q.PERMUTATIONS + 1}.0::DOUBLE END AS p
  FROM nul JOIN facts USING (variant) GROUP BY variant),
e AS (SELECT variant, count(*) AS n, sum(label) AS n_wins, round(avg(label), 8) AS win_rate,
  round(coalesce(sum({_NET}) FILTER (WHERE {_NET} > 0), 0) / abs(sum({_NET}) FILTER (WHERE {_NET} <= 0)), 6) AS profit_factor,
  round(CASE WHEN min({_NET}) <= -1 THEN -1 ELSE exp(sum(ln(1 + {_NET})) FILTER (WHERE {_NET} > -1)) - 1 END, 6) AS total_return,
  round(avg({_NET}), 7) AS avg_net_ret, round(avg(ret) / (avg(abs(ret)) + 1e-9), 6) AS expectancy_r FROM k GROUP BY variant)
SELECT variant, n AS n_trades, win_rate, round(least(greatest({q.WILSON.format(s='-')}, 0), 1), 8) AS wilson_lo, round(least(greatest({q.WILSON.format(s='+')}, 0), 1), 8) AS wilson_hi,
  profit_factor, total_return, avg_net_ret, expectancy_r, round(p, 9) AS perm_p FROM e LEFT JOIN pm USING (variant)""")
def gate_ablation(spark, sf_dir):
    """Every gate variant after the overlap filter: economics, interval, and whether its picks beat random ones."""
    trades = cut_lineage(scored_trades(spark, sf_dir).select(
        *KEYS, "side", "label", "ret", "entry_pos", "exit_pos", "p_win", "alignment", "is_novel"))
    taken = cut_lineage(g.non_overlapping(g.gate_variants(trades, F.lit(0.5)), reach=18, keys=["asset", "variant"]))
    bounds = taken.groupBy("variant").agg(F.sum(F.col("label").cast("long")).alias("w"), F.count(F.lit(1)).alias("n")).select(
        "variant", wilson_bound(F.col("w"), F.col("n"), False).alias("wilson_lo"), wilson_bound(F.col("w"), F.col("n"), True).alias("wilson_hi"))
    perm = ec.permutation_test(g.gate_flags(trades, F.lit(0.5)), ["variant"], F.col("label"), F.col("take"), q.PERMUTATIONS)
    out = (ec.kelly_summary(taken, ["variant"], payoff=2.0, cost=0.004).join(bounds, "variant")
           .join(perm.select("variant", F.col("p_value").alias("perm_p")), "variant", "left"))
    return rounded(out, win_rate=8, wilson_lo=8, wilson_hi=8, profit_factor=6, total_return=6, avg_net_ret=7, expectancy_r=6, perm_p=9)


@query(q.with_(_SC, recursive=True) + """SELECT CASE WHEN is_novel THEN 'novel' ELSE 'familiar' END AS novelty,
  CASE WHEN alignment = 1 THEN 'with' WHEN alignment = 0 THEN 'against' ELSE 'unknown' END AS leader,
  count(*) AS n, round(avg(label), 8) AS win_rate, round(corr(p_win, label), 7) AS corr FROM scored GROUP BY 1, 2""")
def gate_breakdown(spark, sf_dir):
    tagged = scored_trades(spark, sf_dir).select(
        F.when(F.col("is_novel"), "novel").otherwise("familiar").alias("novelty"),
        F.when(F.col("alignment") == 1, "with").when(F.col("alignment") == 0, "against").otherwise("unknown").alias("leader"),
        "p_win", "label")
    return tagged.groupBy("novelty", "leader").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 8).alias("win_rate"),
        F.round(F.corr("p_win", "label"), 7).alias("corr"))


# Replies built from events: clean, fenced, broken, out of range, unknown word.
_REPLY_SQL = """replies AS (SELECT event_id, event_type AS asset, ts AS signal_time, CASE event_id % 13
  WHEN 0 THEN '{"decision": "approve", "confidence": 0.9, "reason": "' || event_type || '"}'
  WHEN 1 THEN 'Sure: {"decision": "REJECT ", "confidence": 0.3, "reason": "weak"} done'
  WHEN 2 THEN 'no json here'
  WHEN 3 THEN '{"decision": "approve", "confidence": 7.5, "reason": "too sure"}'
  WHEN 4 THEN '{"decision": "maybe", "confidence": "n/a"}'
  WHEN 5 THEN '{broken'
  WHEN 6 THEN '{''decision'': ''approve'', ''confidence'': 0.9}'
  WHEN 7 THEN '{"decision": "approve", "confidence": 0.9} or {"decision": "reject"}'
  WHEN 8 THEN '{"decision": "approve", "confidence": "nan", "reason": "odd"}'
  WHEN 9 THEN '{"decision": "approve", "confidence": "0.9d", "reason": "odd"}'
  WHEN 10 THEN '{"decision": "approve", "confidence": 0.5}, {"decision": "approve", "confidence": 0.5}'
  WHEN 11 THEN '{"decision": "approve", "confidence": " 0.25 ", "reason": "text"}'
  ELSE '{"decision": "approve", "confidence": ' || (event_id % 100) / 100.0 || ', "reason": "ok"}' END AS text FROM events)"""


def replies(spark, sf_dir):
    n = F.col("event_id") % 13
    text = (F.when(n == 0, F.concat(F.lit('{"decision": "approve", "confidence": 0.9, "reason": "'), F.col("event_type"), F.lit('"}')))
            .when(n == 1, 'Sure: {"decision": "REJECT ", "confidence": 0.3, "reason": "weak"} done')
            .when(n == 2, "no json here")
            .when(n == 3, '{"decision": "approve", "confidence": 7.5, "reason": "too sure"}')
            .when(n == 4, '{"decision": "maybe", "confidence": "n/a"}')
            .when(n == 5, "{broken")
            .when(n == 6, "{'decision': 'approve', 'confidence': 0.9}")
            .when(n == 7, '{"decision": "approve", "confidence": 0.9} or {"decision": "reject"}')
            .when(n == 8, '{"decision": "approve", "confidence": "nan", "reason": "odd"}')
            .when(n == 9, '{"decision": "approve", "confidence": "0.9d", "reason": "odd"}')
            .when(n == 10, '{"decision": "approve", "confidence": 0.5}, {"decision": "approve", "confidence": 0.5}')
            .when(n == 11, '{"decision": "approve", "confidence": " 0.25 ", "reason": "text"}')
            .otherwise(F.concat(F.lit('{"decision": "approve", "confidence": '),
                                ((F.col("event_id") % 100) / F.lit(100.0)).cast("string"), F.lit(', "reason": "ok"}'))))
    return t.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("asset"), F.col("ts").alias("signal_time"), text.alias("text"))


PARSED = r"""bodies AS (SELECT *, nullif(regexp_extract(text, '\{.*\}', 0, 's'), '') AS body FROM replies),
objects AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS obj FROM bodies),
fields AS (SELECT *, lower(trim(json_extract_string(obj, '$.decision'))) AS d, trim(json_extract_string(obj, '$.confidence')) AS c,
  json_extract_string(obj, '$.reason') AS r FROM objects),
parsed AS (SELECT event_id, asset, signal_time, CASE WHEN d IN ('approve', 'reject') THEN d ELSE 'reject' END AS decision,
  least(greatest(CASE WHEN regexp_full_match(coalesce(c, ''), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN CAST(c AS DOUBLE) ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE) AS confidence,
  CASE WHEN obj IS NULL THEN 'unparseable response' ELSE left(coalesce(r, ''), 500) END AS reason FROM fields)"""


@query(q.with_(_REPLY_SQL, PARSED) + "SELECT event_id, decision, confidence, reason FROM parsed")
def parse_replies(spark, sf_dir):
    return replies(spark, sf_dir).withColumn("_r", g.parse_reply(F.col("text"))).select(
        "event_id", "_r.decision", "_r.confidence", "_r.reason")


_CASE = "CASE signal " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in g.DESCRIPTIONS.items()) + " END"
_SHOWN = [f for f in g.REVIEW_FEATURES if not f.startswith("funding")]


@query(q.with_(SIDES, pool_sql(["reversion"]), recursive=True) + f"""SELECT asset, ts, signal, concat_ws(chr(10), 'Asset: ' || asset, 'Signal type: ' || {_CASE},
  'Candidate: ' || CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END || ' at close ' || format('{{:.6g}}', close),
  'ATR(14, price units): ' || format('{{:.6g}}', atr), """ + ", ".join(
    f"""'{f}: ' || format('{{:.6g}}', "{f}")""" for f in _SHOWN) + ", '" + g.CLOSING.replace("'", "''") + "') AS text FROM cand")
def review_texts(spark, sf_dir):
    """What a reviewer is shown for each candidate."""
    _, cand = candidate_pool(spark, sf_dir, ["reversion"], extra=_SHOWN)
    return cand.select("asset", "ts", "signal", g.review_text(cand.columns).alias("text"))


_DECISIONS = """dec AS (SELECT asset, ts AS signal_time, CASE WHEN extract(day FROM ts) % 3 = 0 THEN 'approve' ELSE 'reject' END AS decision,
    (extract(day FROM ts) % 10) / 10.0::DOUBLE AS confidence FROM lab WHERE extract(day FROM ts) % 4 <> 0)"""


def decisions(trades):
    day = F.day("ts")
    return trades.filter(day % 4 != 0).select(
        "asset", F.col("ts").alias("signal_time"), F.when(day % 3 == 0, "approve").otherwise("reject").alias("decision"),
        ((day % 10) / F.lit(10.0)).alias("confidence"))


@query(q.with_(labelled_sql(["vol_breakout"]), _DECISIONS, recursive=True) + """, d AS (SELECT l.*, decision = 'approve' AND confidence >= 0.3 AS approved
  FROM lab l JOIN dec ON dec.asset = l.asset AND dec.signal_time = l.ts),
c AS (SELECT *, 'taker' AS cost_name, ret - 0.004 AS net FROM d UNION ALL SELECT *, 'maker', ret - 0.0008 FROM d),
e AS (SELECT cost_name, 'all' AS chosen, label, net FROM c UNION ALL SELECT cost_name, 'approved', label, net FROM c WHERE approved)
SELECT cost_name, chosen, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins, round(avg(label), 8) AS win_rate,
  round(coalesce(sum(net) FILTER (WHERE net > 0), 0) / abs(sum(net) FILTER (WHERE net <= 0)), 7) AS profit_factor, round(avg(net), 7) AS expectancy
FROM e GROUP BY ALL""")
def decision_gate(spark, sf_dir):
    trades = labelled(spark, sf_dir, ["vol_breakout"])
    known = g.decided(trades, decisions(trades), 0.3)
    chosen = F.when(F.col("approved"), F.array(F.lit("all"), F.lit("approved"))).otherwise(F.array(F.lit("all")))
    costed = ec.per_cost(known.withColumn("chosen", F.explode(chosen)), {"taker": 0.004, "maker": 0.0008})
    return rounded(ec.net_economics(costed, ["cost_name", "chosen"], F.col("cost")),
                   win_rate=8, profit_factor=7, expectancy=7)


@query(q.with_(labelled_sql(["vol_breakout"]), _DECISIONS, recursive=True) + """SELECT asset, ts, side FROM lab l
ANTI JOIN dec ON dec.asset = l.asset AND dec.signal_time = l.ts""")
def decision_backlog(spark, sf_dir):
    trades = labelled(spark, sf_dir, ["vol_breakout"])
    return g.undecided(trades, decisions(trades)).select("asset", "ts", "side")
