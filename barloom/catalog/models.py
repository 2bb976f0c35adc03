"""Registered queries: fitted models (rows-only) and whole studies."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import sqltext as q
from barloom.catalog.registry import query
from barloom.catalog.signals import FUNDED_FEATURES, FUNDING_SIDES, funded_bars, rounded, rule_bars
from barloom.catalog.trades import _CONV, FILL_LABELS, FILLS, SIDES, conviction_trades, label_sql, pool_sql
from barloom.operators import calibration as cal
from barloom.operators import economics as ec
from barloom.operators import features as ft
from barloom.operators import gating as g
from barloom.operators import learning as ml
from barloom.operators import signals as sg
from barloom.operators import splits as sp
from barloom.plans import research as rs
from barloom.session import cut_lineage
from barloom.sources import tables as t

COLUMNS = rs.MODEL_FEATURES + ["alignment_strength"]
RULES = list(sg.RULES)
MODEL = dict(trees=ml.TREES, depth=ml.DEPTH)
WALK_FOLDS = 4


def dataset(spark, sf_dir):
    rows = rs.meta_label_dataset(rule_bars(spark, sf_dir), t.LEADER, RULES)
    return cut_lineage(ml.with_cv_fold(ml.finite_rows(rows, COLUMNS), "trade_id"))


def train_test(spark, sf_dir):
    split = cut_lineage(sp.split_by_position(dataset(spark, sf_dir), t.numbered_bars(spark, sf_dir)))
    return split.filter("role = 'train'"), split.filter("role = 'test'")


@query()
def meta_model_scores(spark, sf_dir):
    """Pooled classifier fitted on the first 80% of bars, scored on the rest."""
    _, scored = ml.fit_and_score(*train_test(spark, sf_dir), COLUMNS, **MODEL)
    return scored.select("trade_id", "label", "p_win")


@query()
def model_search(spark, sf_dir):
    """15 drawn settings x 5 folds, scored by top-quantile precision."""
    return ml.search(dataset(spark, sf_dir), COLUMNS)


@query()
def out_of_fold_scores(spark, sf_dir):
    return ml.out_of_fold(dataset(spark, sf_dir), COLUMNS, **MODEL).select("trade_id", "cv_fold", "label", "p_win")


@query()
def model_leaf_novelty(spark, sf_dir):
    model, _ = ml.fit_and_score(*train_test(spark, sf_dir), COLUMNS, **MODEL)
    return cal.novelty(model.leaves(0, False), model.leaves(0, True))


@query()
def model_walk_forward(spark, sf_dir):
    """Per-fold search (8 settings, 3 inner folds), calibration, novelty, gate, overlap filter and summary."""
    rows = dataset(spark, sf_dir).drop("cv_fold")
    edges = sp.fold_edges(rows, WALK_FOLDS, 18 * 86400.0)
    folded = sp.assign_folds(rows, edges)
    trades = ml.walk_forward(folded, COLUMNS, target=0.3, min_trades=20)
    taken = g.non_overlapping(trades.filter("taken"), reach=18, keys=["asset", "fold"])
    return ec.kelly_summary(taken, ["fold"], payoff=1.0, cost=0.004)


@query()
def feature_importances(spark, sf_dir):
    """Top features of a model fitted on the first half of the training rows."""
    train, test = train_test(spark, sf_dir)
    middle = train.groupBy("asset").agg(F.percentile("bar", 0.5).alias("_mid"))
    half = train.join(middle, "asset").filter("bar <= _mid")
    model, _ = ml.fit_and_score(half, test, COLUMNS, **MODEL)
    return ml.importances(model, spark)


@query()
def direction_model_report(spark, sf_dir):
    """Next-bar direction classifier: precision and recall per class."""
    rows = ft.features(t.numbered_bars(spark, sf_dir), balance=False)
    labelled = ft.direction_target(rows.select("asset", "ts", "pos", "bar", *rs.MODEL_FEATURES, "ret_1d"), ft.bar_scale(24))
    data = ml.finite_rows(labelled, rs.MODEL_FEATURES).withColumn("row_id", F.concat_ws("_", "asset", F.col("bar").cast("string")))
    split = cut_lineage(sp.split_by_position(cut_lineage(data), t.numbered_bars(spark, sf_dir)))
    _, scored = ml.fit_and_score(split.filter("role = 'train'"), split.filter("role = 'test'"), rs.MODEL_FEATURES, row_id="row_id", label="target", **MODEL)
    return ml.class_report(scored.withColumn("prediction", (F.col("p_win") >= 0.5).cast("int")), "target")


@query()
def geometry_model_slice(spark, sf_dir):
    """Base signal against its top score decile after the overlap filter."""
    scored = ml.out_of_fold(dataset(spark, sf_dir), COLUMNS, **MODEL)
    scored = cut_lineage(scored.select("asset", "signal", "entry_pos", "exit_pos", "label", "ret", "p_win"))
    cut = cal.score_quantile(cut_lineage(cal.score_counts(scored, [])), [], 0.9)
    top = ec.attach_facts(scored, cut, []).filter("p_win >= cut").drop("cut").withColumn("chosen", F.lit("top_decile"))
    both = scored.withColumn("chosen", F.lit("all")).unionByName(top)
    kept = g.non_overlapping(both, reach=18, keys=["asset", "chosen"])
    return ec.net_economics(kept, ["chosen"], 0.004)


_ECON = """e AS (SELECT execution, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins, avg(label) AS wr, coalesce(sum(net) FILTER (WHERE net > 0), 0) AS w,
  coalesce(sum(net) FILTER (WHERE net <= 0), 0) AS l, avg(net) AS x FROM x2 GROUP BY execution)"""


@query(q.with_(SIDES, pool_sql(["vol_breakout"]), FILLS, FILL_LABELS, "orders AS (SELECT *, bar AS anchor, close AS price, atr AS risk FROM cand)",
               label_sql("lab", "orders", 18, "2.0::DOUBLE", "1.0::DOUBLE"),
               "x2 AS (SELECT 'taker' AS execution, label, ret - 0.004 AS net FROM lab UNION ALL SELECT 'maker', label, ret - 0.0008 FROM mk)", _ECON, recursive=True)
       + "SELECT execution, n, n_wins, round(wr, 8) AS win_rate, round(w / abs(l), 7) AS profit_factor, round(x, 7) AS expectancy FROM e")
def maker_study(spark, sf_dir):
    """Instant fills at taker cost against limit fills at maker cost."""
    return rounded(rs.maker_study(t.numbered_bars(spark, sf_dir), "vol_breakout"), win_rate=8, profit_factor=7, expectancy=7)


_FUNDING_RULES = ["funding_reversion", "funding_reversion_confirmed", "funding_reversion_regime_filtered"]


@query(q.with_(FUNDED_FEATURES, FUNDING_SIDES, """sides AS (SELECT *, base AS funding_reversion,
  CASE WHEN (base = 1 AND bb_position < -0.5) OR (base = -1 AND bb_position > 0.5) THEN base ELSE 0 END AS funding_reversion_confirmed,
  CASE WHEN "ATR_ratio" < 1.05 THEN base ELSE 0 END AS funding_reversion_regime_filtered FROM fs)""",
               pool_sql(_FUNDING_RULES), FILLS, FILL_LABELS, "orders AS (SELECT *, bar AS anchor, close AS price, atr AS risk FROM cand)",
               label_sql("lab", "orders", 18, "2.0::DOUBLE", "1.0::DOUBLE"),
               "x2 AS (SELECT signal, 'taker' AS execution, label, ret - 0.004 AS net FROM lab UNION ALL SELECT signal, 'maker', label, ret - 0.0008 FROM mk)",
               _ECON.replace("SELECT execution", "SELECT signal, execution").replace("GROUP BY execution", "GROUP BY signal, execution"), recursive=True)
       + "SELECT signal, execution, n, n_wins, round(wr, 8) AS win_rate, round(w / abs(l), 7) AS profit_factor, round(x, 7) AS expectancy FROM e")
def funding_study(spark, sf_dir):
    """The funding rules labelled, filled and costed both ways."""
    return rounded(rs.rule_study(funded_bars(spark, sf_dir), _FUNDING_RULES), win_rate=8, profit_factor=7, expectancy=7)


@query(q.with_(_CONV, recursive=True) + """, f AS (SELECT *, (n - 1) * (1.0::DOUBLE - 2.0::DOUBLE * span / n) AS rk FROM (
  SELECT count(*) AS n, greatest(date_diff('day', min(ts), max(ts)), 1) AS span, min(score) AS lo, list(score ORDER BY score) AS s FROM scd)),
th AS (SELECT CASE WHEN 2.0 * span >= n THEN lo ELSE s[CAST(floor(rk) AS INT) + 1] + (s[CAST(floor(rk) AS INT) + 2] - s[CAST(floor(rk) AS INT) + 1]) * (rk - floor(rk)) END AS threshold FROM f),
sel AS (SELECT 'top_per_day' AS selection, label, ret FROM scd QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY score DESC, asset, signal, ts) <= 2),
al AS (SELECT * FROM sel UNION ALL SELECT 'threshold', label, ret FROM scd, th WHERE score >= threshold),
c AS (SELECT selection, 'taker' AS cost_name, label, ret - 0.004 AS net FROM al UNION ALL SELECT selection, 'maker', label, ret - 0.0008 FROM al)
SELECT selection, cost_name, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_wins, round(avg(label), 8) AS win_rate,
  round(sum(net) FILTER (WHERE net > 0) / abs(sum(net) FILTER (WHERE net <= 0)), 7) AS profit_factor, round(avg(net), 7) AS expectancy FROM c GROUP BY ALL""")
def daily_digest(spark, sf_dir):
    """Best signals per day against the frequency-matched threshold at two costs."""
    pool = conviction_trades(spark, sf_dir).select("asset", "signal", "ts", "label", "ret", "score")
    out = rs.daily_digest(pool, 2, {"taker": 0.004, "maker": 0.0008})
    return rounded(out, win_rate=8, profit_factor=7, expectancy=7)
