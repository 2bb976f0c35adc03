"""Batched boosting against a plain loop over rows, and the studies on top of it."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as bo
from barloom.operators import learning as ml


def table(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.choice([0.0, 1.0, 2.0, 3.0]), rng.gauss(0, 1), rng.random(), 1.0]
        rows.append((f"r{i}", int(rng.random() < 1 / (1 + math.exp(-(x[0] - 1.5 + x[1])))), i % 3, rng.choice([-1, 0, 1, bo.TEST, None]), *x))
    return rows, spark.createDataFrame(rows, "trade_id string, label int, cv_fold int, other int, a double, b double, c double, same double")


def plain_trees(x, y, fit, edges, keys):
    """The same rules, one row and one tree at a time."""
    share = min(max(sum(y) / len(y), 1e-6), 1 - 1e-6)
    margin = [math.log(share / (1 - share))] * len(y)
    bins = [[int(np.searchsorted(edges[j], v, "left")) for j, v in enumerate(row)] for row in x]
    t1 = lambda g: math.copysign(max(abs(g) - fit.l1, 0), g)
    worth = lambda g, h: t1(g) ** 2 / (h + fit.l2)
    trees = []
    for t in range(fit.trees):
        use = bo._sampled(np.array(keys, np.int64).astype(np.uint64), fit, t)
        gr = [(1 / (1 + math.exp(-m)) - v) for m, v in zip(margin, y, strict=True)]
        he = [(1 / (1 + math.exp(-m))) * (1 - 1 / (1 + math.exp(-m))) for m in margin]
        columns = bo.allowed_columns(fit, t, len(edges))

        def grow(rows, depth, top):
            g, h = sum(gr[i] for i in rows), sum(he[i] for i in rows)
            best = None
            if depth < fit.depth:
                for j in columns:
                    for cut in range(bo.BINS - 1):
                        left = [i for i in rows if bins[i][j] <= cut]
                        gl, hl = sum(gr[i] for i in left), sum(he[i] for i in left)
                        if hl >= fit.min_child and h - hl >= fit.min_child:
                            gain = worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                                best = (gain, int(j), cut, left)
            if best is None:
                return -t1(g) / (h + fit.l2) if rows else 0.0
            rest = set(best[3])
            return best[1], best[2], grow(best[3], depth + 1, False), grow([i for i in rows if i not in rest], depth + 1, False)

        tree = grow([i for i in range(len(y)) if use[i]], 0, True)

        def leaf(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        margin = [m + fit.rate * leaf(tree, r) for m, r in zip(margin, bins, strict=True)]
        trees.append(tree)
    return trees, margin


def as_plain(tree, i=0):
    if i >= len(tree.feature) or tree.feature[i] < 0:
        return float(tree.value[i])
    return int(tree.feature[i]), int(tree.cut[i]), as_plain(tree, 2 * i + 1), as_plain(tree, 2 * i + 2)


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if isinstance(a, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return abs(a - b) < 1e-6


SETTINGS = [bo.Fit(trees=3, depth=2, rate=0.3, l1=0.5, l2=2.0, left_out=1), bo.Fit(trees=2, depth=3, rate=0.1, min_child=2.0, rows=0.7, columns=0.5, setting=1, left_out=0)]


def test_trees_equal_a_plain_booster(spark):
    rows, df = table(spark)
    columns = ["a", "b", "c", "same"]
    keys = {r.trade_id: r.k for r in df.select("trade_id", F.xxhash64("trade_id").alias("k")).collect()}
    model = bo.grow(df.repartition(3), columns, SETTINGS, ["cv_fold"])
    edges = bo.quantile_edges(df, columns)
    got = {(r.fit, r.row_id): r.p_win for r in model.train_scores([0, 1]).collect()}
    for k, fit in enumerate(SETTINGS):
        used = [r for r in rows if r[2] != fit.left_out]
        trees, margin = plain_trees([r[4:] for r in used], [r[1] for r in used], fit, edges, [keys[r[0]] for r in used])
        assert len(model.trees[k]) == fit.trees
        assert all(same(as_plain(a), b) for a, b in zip(model.trees[k], trees, strict=True))
        for r, m in zip(used, margin, strict=True):
            assert abs(got[k, r[0]] - 1 / (1 + math.exp(-m))) < 1e-6


def test_a_model_does_not_depend_on_the_spread_of_rows(spark):
    _, df = table(spark)
    made = [bo.grow(df.repartition(n), ["a", "b", "c"], SETTINGS, ["cv_fold"]) for n in (1, 7)]
    for a, b in zip(*(m.trees for m in made), strict=True):
        assert all((x.feature == y.feature).all() and (x.cut == y.cut).all() and (x.value == y.value).all() for x, y in zip(a, b, strict=True))


def test_each_fit_scores_the_rows_it_left_out(spark):
    rows, df = table(spark)
    fits = [bo.Fit(trees=1, left_out=2), bo.Fit(trees=1, group=1), bo.Fit(trees=1, group=1, left_out=0)]
    got = bo.grow(df, ["a", "b"], fits, ["cv_fold", "other"]).scores().collect()
    assert {r.row_id for r in got if r.fit == 0} == {r[0] for r in rows if r[2] == 2}
    assert {r.row_id for r in got if r.fit == 1} == {r[0] for r in rows if r[3] == bo.TEST}
    assert {r.row_id for r in got if r.fit == 2} == {r[0] for r in rows if r[3] == 0}


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([("x", 1, 0, 1.0), ("y", 1, 0, 2.0), ("z", 0, bo.TEST, 3.0)], "trade_id string, label int, m int, a double")
    (row,) = bo.grow(df, ["a"], [bo.Fit(trees=2)], ["m"]).scores().collect()
    assert row.row_id == "z" and row.p_win > 0.99
    (row,) = bo.grow(df.filter("m = 100"), ["a"], [bo.Fit(trees=2)], ["m"]).scores().collect()
    assert row.p_win == pytest.approx(0.5)
    assert bo.grow(df.limit(0), ["a"], [bo.Fit(trees=1)], ["m"]).scores().collect() == []


def test_search_prefers_a_setting_that_learns(spark):
    _, df = table(spark, 900)
    grid = {"maxDepth": [2], "maxIter": [1, 8], "stepSize": [0.3], "minChildWeight": [1, 10_000]}
    found = {r.params: r.precision for r in ml.search(df, ["a", "b", "c"], 3, 4, grid).collect()}
    assert len(found) == 4
    learns = max(v for k, v in found.items() if "minChildWeight=1," in k)
    assert learns > 0.75 and learns > max(v for k, v in found.items() if "10000" in k)


def test_nested_search_in_every_fold(spark):
    _, df = table(spark, 600)
    folded = df.drop("cv_fold", "other").withColumn("alignment", F.lit(1.0)).withColumn("fold", F.explode(F.array(F.lit(4), F.lit(9))))
    folded = folded.withColumn("role", F.when(F.pmod(F.hash("trade_id"), F.lit(4)) == 0, "test").otherwise("train"))
    grid = {"maxDepth": [1], "maxIter": [2], "stepSize": [0.3], "minChildWeight": [1, 10_000]}
    out = ml.walk_forward(folded, ["a", "b"], target=0.5, min_trades=5, settings=2, grid=grid).collect()
    tested = {(r.trade_id, r.fold) for r in folded.filter("role = 'test'").collect()}
    assert {(r.trade_id, r.fold) for r in out} == tested and len(out) == len(tested)
    # The setting that cannot split scores all rows alike; the chosen one does not.
    assert len({round(r.p_win, 9) for r in out if r.fold == 4}) > 1


def test_importances_name_what_splits(spark):
    _, df = table(spark, 900)
    model = bo.grow(df, ["a", "b", "c", "same"], [bo.Fit(trees=6, depth=2, min_child=1.0)], ["cv_fold"])
    ranked = ml.importances(model, spark).collect()
    assert {ranked[0].feature, ranked[1].feature} == {"a", "b"} and ranked[-1].importance == 0.0
    assert sum(r.importance for r in ranked) == pytest.approx(1.0)


def test_class_report_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "target int, prediction int")
    got = {r["class"]: (round(r.precision, 6), round(r.recall, 6), r.support) for r in ml.class_report(df, "target").collect()}
    assert got == {0: (round(2 / 3, 6), round(2 / 3, 6), 3), 1: (0.5, 0.5, 2)}


def test_a_level_of_few_rows_is_one_stage(spark):
    """Rows of one task need no shuffle, and a level reads kept arrays: the stages of six more trees of depth 2 are one a level."""
    _, df = table(spark, 200)
    sc = spark.sparkContext

    def stages(trees):
        sc.setJobGroup(f"grow {trees}", "")
        model = bo.grow(df, ["a", "b", "c", "same"], [bo.Fit(trees=trees, depth=2, min_child=1.0, left_out=0)], ["cv_fold"])
        assert all(t.feature[0] >= 0 for t in model.trees[0])
        tracker = sc.statusTracker()
        return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"grow {trees}"))

    assert stages(10) - stages(4) == 12
    sc.setLocalProperty("spark.jobGroup.id", None)
