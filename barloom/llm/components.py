"""Connected components by contraction, as DataFrame jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) for every node of ``edges`` (a, b bigint).

    Each round points every node to its smallest neighbour (or itself), follows the pointers
    once more, and replaces nodes by what they point to; edges inside a component vanish and
    rounds are about logarithmic in its diameter. Every round is written, so its plan stays
    short. Repeated edges and self-edges are fine; no edges give no rows.
    """
    live = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    loops = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = loops.withColumn("label", F.col("node"))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        onward = point.select(F.col("a").alias("to"), F.col("to").alias("onward"))
        point = point.join(onward, "to", "left").select("a", F.coalesce("onward", "to").alias("to"))
        labels = cut_lineage(labels.join(point.withColumnRenamed("a", "label"), "label", "left")
                             .select("node", F.coalesce("to", "label").alias("label")))
        of_a, of_b = point.select("a", F.col("to").alias("x")), point.select(F.col("a").alias("b"), F.col("to").alias("y"))
        live = cut_lineage(live.join(of_a, "a").join(of_b, "b").where(F.col("x") != F.col("y"))
                           .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return labels
