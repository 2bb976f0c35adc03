"""Three-leg price consistency per snapshot: a fixed triple, or all triples of the price graph."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def triangle_edges(legs: DataFrame, fee: float = 0.001) -> DataFrame:
    """Edge in bps of buying A/B x B/C against A/C, net of three taker legs.

    ``legs`` carries (snapshot, leg, price) with legs ab, bc and ac; the three
    prices of a snapshot meet in one aggregation instead of two self joins.
    """
    price = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("price")))
    wide = legs.groupBy("snapshot").agg(price("ab").alias("ab"), price("bc").alias("bc"), price("ac").alias("ac"))
    gross = F.col("ac") / (F.col("ab") * F.col("bc"))
    best = F.greatest(gross, 1 / gross) * (1 - fee) ** 3 - 1
    return wide.na.drop().select("snapshot", "ab", "bc", "ac", (best * 10_000).alias("edge_bps"))


def triangle_summary(edges: DataFrame, min_edge_bps: float = 50.0) -> DataFrame:
    good = (F.col("edge_bps") > min_edge_bps).cast("long")
    return edges.agg(F.count(F.lit(1)).alias("n_snapshots"), F.sum(good).alias("n_viable"),
                     F.avg(good.cast("double")).alias("viable_share"), F.avg("edge_bps").alias("mean_edge_bps"),
                     F.max("edge_bps").alias("max_edge_bps"))


def list_triangles(quotes: DataFrame, fee: float = 0.001) -> DataFrame:
    """Every three assets of a snapshot that are priced against each other, with the best edge in bps.

    ``quotes`` carries (snapshot, base, quote, price): one unit of base costs ``price`` of quote. Several
    quotes of a pair, in either direction, leave the best rate each way. A triple a < b < c has two
    cycles, a-b-c-a and a-c-b-a; ``edge_bps`` is the better one net of three taker legs. Nulls,
    prices that are not positive and finite, and assets quoted in themselves take no part.

    Every pair points from its rarer asset to its commoner one (by priced partners, then by name). A triple
    is then found once, at the asset that points to the other two. No asset points to more than
    sqrt(2 x pairs) others, so a hub that is priced against everything opens no wedges of its own.
    """
    price = F.col("price")
    usable = quotes.filter((price > 0) & (price < float("inf")) & (F.col("base") != F.col("quote")) & F.col("snapshot").isNotNull())
    up = F.col("base") < F.col("quote")
    rate = F.when(up, price).otherwise(1 / price)
    pairs = cut_lineage(usable.groupBy("snapshot", F.least("base", "quote").alias("a"), F.greatest("base", "quote").alias("b")).agg(
        F.max(rate).alias("there"), F.max(1 / rate).alias("back")))
    ends = pairs.select("snapshot", F.explode(F.array("a", "b")).alias("asset"))
    partners = ends.groupBy("snapshot", "asset").agg(F.count(F.lit(1)).alias("n"))
    known = pairs
    for end in ("a", "b"):
        known = known.join(partners.select("snapshot", F.col("asset").alias(end), F.struct("n", "asset").alias(f"{end}_place")),
                           ["snapshot", end])
    upward = F.col("a_place") < F.col("b_place")
    pointed = known.select(
        "snapshot", F.when(upward, F.col("a")).otherwise(F.col("b")).alias("low"),
        F.when(upward, F.col("b")).otherwise(F.col("a")).alias("high"),
        F.greatest("a_place", "b_place").alias("place"))
    left = pointed.select("snapshot", "low", F.col("high").alias("x"), F.col("place").alias("x_place"))
    right = pointed.select("snapshot", "low", F.col("high").alias("y"), F.col("place").alias("y_place"))
    wedges = left.join(right, ["snapshot", "low"]).filter(F.col("x_place") < F.col("y_place"))
    closed = wedges.join(pointed.select("snapshot", F.col("low").alias("x"), F.col("high").alias("y")), ["snapshot", "x", "y"], "left_semi")
    names = F.array_sort(F.array("low", "x", "y"))
    triples = closed.select("snapshot", names[0].alias("a"), names[1].alias("b"), names[2].alias("c"))
    for one, two in (("a", "b"), ("b", "c"), ("a", "c")):
        legs = pairs.select("snapshot", F.col("a").alias(one), F.col("b").alias(two),
                            F.col("there").alias(f"{one}{two}"), F.col("back").alias(f"{two}{one}"))
        triples = triples.join(legs, ["snapshot", one, two])
    gross = F.greatest(F.col("ab") * F.col("bc") * F.col("ca"), F.col("ac") * F.col("cb") * F.col("ba"))
    return triples.select("snapshot", "a", "b", "c", ((gross * (1 - fee) ** 3 - 1) * 10_000).alias("edge_bps"))


def triangle_assets(triangles: DataFrame, min_edge_bps: float = 50.0) -> DataFrame:
    """Per asset: its triangles, the viable ones among them and their share, mean and largest edge."""
    each = triangles.select(F.explode(F.array("a", "b", "c")).alias("asset"), "edge_bps")
    good = (F.col("edge_bps") > min_edge_bps).cast("long")
    return each.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_triangles"), F.sum(good).alias("n_viable"), F.avg(good.cast("double")).alias("viable_share"),
        F.avg("edge_bps").alias("mean_edge_bps"), F.max("edge_bps").alias("max_edge_bps"))


def top_assets(assets: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` assets of largest edge, ties by name (a report of k rows)."""
    return assets.orderBy(F.desc("max_edge_bps"), "asset").limit(k)
