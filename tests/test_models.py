"""The fitted models' inputs and settings: every rule, every fold, the whole search."""
from pyspark.sql import functions as F

from barloom.catalog import models
from barloom.operators import learning as ml
from barloom.operators import signals as sg


def test_search_draws_the_reference_number_of_settings():
    drawn = ml.drawn_settings()
    assert len({tuple(s.items()) for s in drawn}) == 15 and ml.FOLDS == 5
    assert {s["maxIter"] for s in drawn} <= {50, 100, 200} and 50 <= models.MODEL["trees"] <= 200
    assert ml.drawn_settings() == drawn and len(ml.drawn_settings(15, {"maxDepth": [2, 3]})) == 2


def test_candidates_of_every_rule_are_in_the_data_set(spark):
    rows = models.dataset(spark, "/root/testdata/sf0.01")
    assert {r.signal for r in rows.select("signal").distinct().collect()} == set(sg.RULES)
    assert {r.cv_fold for r in rows.select("cv_fold").distinct().collect()} == set(range(5))


def test_walk_forward_runs_every_fold_it_is_given(spark):
    rows = spark.range(240).select(
        F.concat(F.lit("t"), "id").alias("trade_id"), (F.col("id") % 3 + 1).cast("int").alias("fold"),
        F.when(F.col("id") < 180, "train").otherwise("test").alias("role"),
        (F.hash("id") % 2 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("alignment"))
    out = ml.walk_forward(rows, ["x"], target=0.1, min_trades=1, trees=1, depth=1)
    assert {(r["fold"], r["count"]) for r in out.groupBy("fold").count().collect()} == {(1, 20), (2, 20), (3, 20)}
