"""Meta-label and direction classifiers on boosted trees.

All fits of a search, of out-of-fold scoring or of walk-forward folds grow together
(``boosting.grow``); everything around them (search metric, calibration, novelty, gate)
runs once for all of them, keyed by fit or fold.
"""
from __future__ import annotations

import random
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import boosting as bo
from barloom.operators import calibration as cal
from barloom.operators import economics as ec
from barloom.operators import gating as g
from barloom.session import cut_lineage
from barloom.sources.tables import hash_uniform

SEED = 42
TREES, DEPTH, FOLDS, SETTINGS = 100, 3, 5, 15
#: Fixed values of the search.
GRID = {
    "maxDepth": [2, 3, 4],
    "maxIter": [50, 100, 200],
    "stepSize": [0.01, 0.03, 0.05],
    "subsamplingRate": [0.6, 0.7, 0.8],
    "featureShare": [0.5, 0.6, 0.8],
    "minChildWeight": [5, 10, 20],
    "leafL1": [0.1, 1.0, 5.0],
    "leafL2": [3.0, 5.0, 10.0],
}
#: Fixed values of the search inside a walk-forward fold, and the number of settings drawn there.
FOLD_GRID = {
    "maxDepth": [2, 3],
    "maxIter": [50, 100],
    "stepSize": [0.03, 0.05],
    "subsamplingRate": [0.6, 0.8],
    "featureShare": [0.6, 0.8],
    "minChildWeight": [5, 10, 20],
    "leafL1": [0.1, 1.0],
    "leafL2": [3.0, 5.0],
}
FOLD_SETTINGS = 8
_FIELDS = {"maxDepth": "depth", "maxIter": "trees", "stepSize": "rate", "subsamplingRate": "rows", "featureShare": "columns",
           "minChildWeight": "min_child", "leafL1": "l1", "leafL2": "l2"}


def fit_of(setting: dict, number: int = 0, **more) -> bo.Fit:
    """A fit with the settings of a grid."""
    return bo.Fit(**{_FIELDS[k]: v for k, v in setting.items()}, setting=number, **more)


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose model inputs are all present and finite."""
    good = reduce(lambda a, b: a & b, [
        F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf")) for c in columns])
    return df.filter(good)


def drawn_settings(settings: int = SETTINGS, grid: dict[str, list] = GRID) -> list[dict]:
    """Repeatable draw of different settings from the grid; all of them if it has no more."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return random.Random(SEED).sample(every, min(settings, len(every)))


def search(train: DataFrame, columns: list[str], folds: int = FOLDS, settings: int = SETTINGS, grid: dict[str, list] = GRID,
           fold_col: str = "cv_fold", row_id: str = "trade_id", label: str = "label") -> DataFrame:
    """setting, params, precision: drawn settings by their mean top-quantile precision over the folds.

    A fold with too few confident rows counts as 0; all settings x folds grow as one batch.
    """
    drawn = drawn_settings(settings, grid)
    fits = [fit_of(s, i, left_out=k) for i, s in enumerate(drawn) for k in range(folds)]
    model = bo.grow(train, columns, fits, [fold_col], label, row_id)
    return search_table(mean_precision(model, train, row_id, label), drawn, folds)


def mean_precision(model: bo.Model, rows: DataFrame, row_id: str = "trade_id", label: str = "label") -> DataFrame:
    """group, setting, fold, precision of a batch's held-out rows."""
    spark = rows.sparkSession
    # One row a fit: as many as the batch has.
    named = spark.createDataFrame([(i, f.group, f.setting, f.left_out) for i, f in enumerate(model.fits)], "fit int, group int, setting int, fold int")
    scored = model.scores().join(rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(label).alias("label")).distinct(), "row_id")
    found = cal.top_quantile_precision(cut_lineage(scored), ["fit"])
    return cut_lineage(named.join(found, "fit", "left").select("group", "setting", "fold", F.coalesce("precision", F.lit(0.0)).alias("precision")))


def search_table(precision: DataFrame, drawn: list[dict], folds: int) -> DataFrame:
    """Mean precision per setting, named by its parameters."""
    spark = precision.sparkSession
    names = spark.createDataFrame([(i, ", ".join(f"{k}={v}" for k, v in sorted(s.items()))) for i, s in enumerate(drawn)], "setting int, params string")
    means = precision.groupBy("setting").agg((F.sum("precision") / folds).alias("precision"))
    return names.join(means, "setting").select("params", "precision")


def with_cv_fold(df: DataFrame, row_id: str, folds: int = FOLDS) -> DataFrame:
    """Repeatable fold number from a hash of the row id."""
    return df.withColumn("cv_fold", (hash_uniform(F.col(row_id), F.lit("cv")) % folds).cast("int"))


def _scored(model: bo.Model, rows: DataFrame, which, row_id: str) -> DataFrame:
    """The held-out rows of the fits with their scores."""
    return rows.join(model.scores(which).withColumnRenamed("row_id", "_row"), F.col(row_id).cast("string") == F.col("_row")).drop("_row")


def fit_and_score(train: DataFrame, test: DataFrame, columns: list[str], trees: int = TREES, depth: int = DEPTH, row_id: str = "trade_id",
                  label: str = "label") -> tuple[bo.Model, DataFrame]:
    """One model of the training rows and the test rows with ``p_win``; row ids differ between both."""
    both = cut_lineage(train.select(row_id, label, *columns, F.lit(0).alias("_member"))
                       .unionByName(test.select(row_id, label, *columns, F.lit(bo.TEST).alias("_member"))))
    model = bo.grow(both, columns, [bo.Fit(trees=trees, depth=depth)], ["_member"], label, row_id)
    return model, _scored(model, test, [0], row_id).drop("fit")


def out_of_fold(train: DataFrame, columns: list[str], folds: int = FOLDS, fold_col: str = "cv_fold", trees: int = TREES, depth: int = DEPTH,
                row_id: str = "trade_id", label: str = "label") -> DataFrame:
    """Scores of every training row from a model that did not see it."""
    fits = [bo.Fit(trees=trees, depth=depth, left_out=k) for k in range(folds)]
    model = bo.grow(train, columns, fits, [fold_col], label, row_id)
    return _scored(model, train, range(folds), row_id).drop("fit")


def importances(model: bo.Model, session, fit: int = 0, top: int = 15) -> DataFrame:
    """Most important features of a fitted model: a row per feature at most."""
    ranked = model.importances(fit)[:top]
    return session.createDataFrame([(i + 1, c, w) for i, (c, w) in enumerate(ranked)], "rank int, feature string, importance double")


def class_report(scored: DataFrame, label: str) -> DataFrame:
    """Precision, recall and support per class from the confusion counts."""
    cells = scored.groupBy(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")))).alias("_c")).select("_c.*")
    return both.groupBy("class").agg(
        F.try_divide(F.sum("hit"), F.sum("called")).alias("precision"),
        F.try_divide(F.sum("hit"), F.sum("actual")).alias("recall"), F.sum("actual").alias("support"))


def nested_fits(outer: list[int], drawn: list[dict], inner_folds: int) -> list[bo.Fit]:
    """Every setting on every inner fold of every walk-forward fold."""
    return [fit_of(s, i, group=o, left_out=k) for o in range(len(outer)) for i, s in enumerate(drawn) for k in range(inner_folds)]


def walk_forward(folded: DataFrame, columns: list[str], target: float = 0.65, min_trades: int = 20, inner_folds: int = 3,
                 settings: int = FOLD_SETTINGS, grid: dict[str, list] = FOLD_GRID, trees: int | None = None, depth: int = DEPTH) -> DataFrame:
    """Per-fold search, fit, calibration, novelty and gate; out-of-sample trades of all folds.

    ``folded`` carries (fold, role) and the trade columns with alignment; every fold in it is run. Inside a fold's
    training rows, ``settings`` drawn settings are compared by cross-validation, the best one gives the
    out-of-fold scores that set the threshold, and is fitted on all of them. All folds, settings and inner folds grow
    as one batch, the chosen settings as a second one. ``trees`` fixes one setting instead of a search.
    """
    data = cut_lineage(with_cv_fold(finite_rows(folded, columns), "trade_id", inner_folds))
    outer = sorted(r["fold"] for r in data.select("fold").distinct().collect())
    drawn = [{"maxIter": trees, "maxDepth": depth}] if trees else drawn_settings(settings, grid)
    member = F.when(F.col("role") == "train", F.col("cv_fold")).otherwise(bo.TEST)
    # A trade has one row per fold it is part of: laid side by side, one column a fold.
    wide = cut_lineage(data.groupBy("trade_id", "label", *columns).agg(*[F.max(F.when(F.col("fold") == f, member)).alias(f"_fold_{i}") for i, f in enumerate(outer)]))
    members = [f"_fold_{i}" for i in range(len(outer))]
    fits = nested_fits(outer, drawn, inner_folds)
    inner = bo.grow(wide, columns, fits, members)
    means = mean_precision(inner, wide).groupBy("group", "setting").agg((F.sum("precision") / inner_folds).alias("precision"))
    # One row per fold and setting: the driver picks each fold's best, ties to the first drawn.
    best: dict[int, tuple[float, int]] = {}
    for r in means.collect():
        best[r["group"]] = max(best.get(r["group"], (-1.0, 0)), (r["precision"], -r["setting"]))
    chosen = {o: -best[o][1] if o in best else 0 for o in range(len(outer))}
    numbered = {(f.group, f.setting, f.left_out): i for i, f in enumerate(fits)}
    oof = [numbered[o, chosen[o], k] for o in range(len(outer)) for k in range(inner_folds)]
    final = bo.grow(wide, columns, [replace(fits[numbered[o, chosen[o], 0]], left_out=-1) for o in range(len(outer))], members)
    fold_of = lambda fit, of: F.element_at(F.create_map(*[F.lit(x) for i, o in of for x in (i, outer[o])]), fit)
    labels = wide.select(F.col("trade_id").alias("row_id"), "label")
    held_out = inner.scores(oof).withColumn("fold", fold_of(F.col("fit"), [(i, fits[i].group) for i in oof])).join(labels, "row_id")
    threshold = cal.calibrate_threshold(cut_lineage(held_out), ["fold"], target, min_trades).select("fold", F.col("threshold").alias("fold_threshold"))
    scored = final.scores().withColumn("fold", fold_of(F.col("fit"), [(i, i) for i in range(len(outer))])).withColumnRenamed("row_id", "trade_id").drop("fit")
    unusual = reduce(DataFrame.unionByName, [
        cal.novelty(final.leaves(o, False), final.leaves(o, True)).select(F.col("row_id").alias("trade_id"), "is_novel", F.lit(f).alias("fold"))
        for o, f in enumerate(outer)])
    tested = data.filter("role = 'test'").join(scored, ["trade_id", "fold"]).join(unusual, ["trade_id", "fold"])
    based = ec.attach_facts(tested, threshold, ["fold"])
    return cut_lineage(g.gate(based, F.col("fold_threshold"), alignment="alignment", novel="is_novel"))
