"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's target is filled up from its weight and stops at a number of times its size.
Every document is taken as many whole times as the target holds the whole source; for what
is left, each document has an inclusion probability p and a repeatable random number u, and
documents with the smallest (u / (1 - u)) / (p / (1 - p)) are taken until their words meet
what is left. Long documents are drawn first and hand their rounding on to shorter ones
(``TIERS``), so a source misses its target by about half of one of its short documents.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import number_in_order
from barloom.session import cut_lineage

#: A word is a run of signs other than blank, tab, line feeds and returns.
WORD = r"[^\x20\x09-\x0D]+"
#: A tier's documents are up to STEP times as long as the next one's; the last tier holds all shorter ones.
TIERS, STEP = 6, 4
#: Order values are histogrammed in so many bins; only documents of the bin where a tier ends are ordered.
BINS = 65_536


def source_targets(sums: DataFrame, weights: Sequence[int], share: int, most: int) -> DataFrame:
    """key, source_size, target from (key, source, source_size), one row a source.

    Sources ordered by code point, null last, get ``weights`` in turn, and ``share`` percent of
    all sizes in proportion to them. A target stops at ``most`` times its source's size; the
    excess is shared again by weight until no target is above. Sources of size 0 get 0.
    """
    placed = number_in_order(sums, [F.col("source").isNull(), F.col("source")], "place")
    cases = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    open_ = cut_lineage(placed.select("key", "source_size", cases.cast("bigint").alias("weight")))
    total = open_.agg(F.sum("source_size")).first()[0] or 0
    above, level, stopped = F.lit(False), 0.0, -1
    while True:
        # Each round is one sum over a row per source; a source that has stopped stays stopped.
        row = open_.agg(F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w"),
                        F.sum(F.when(above, F.col("source_size") * most).otherwise(0)).alias("c"),
                        F.count(F.when(above, 1)).alias("n")).first()
        if not row["w"] or row["n"] == stopped:
            break
        stopped, level = row["n"], (share * total - 100 * row["c"]) / (100 * row["w"])
        above = F.col("weight") * F.lit(level) > F.col("source_size") * most
    target = F.when(above, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return cut_lineage(open_.select("key", "source_size", target.alias("target")))


def order_value(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds, as a number from 0 to 1 that grows with them."""
    odds = (u / (1.0 - u)) / (p / (1.0 - p))
    return F.when(p >= 1.0, 0.0).otherwise(odds / (1.0 + odds))


def _tier_cuts(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """key, bin, before, taken for each of ``goals`` (key, goal, p): the bin in which the words of
    ``docs`` (key, doc_id, size, u) in order pass the goal, the words before it, and all words taken."""
    valued = _valued(docs, goals)
    bins = valued.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    passed = (bins.withColumn("upto", upto).join(goals, "key").where(F.col("upto") > F.col("goal"))
              .groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("at")))
    cuts = goals.join(passed, "key", "left").select(
        "key", "goal", "p", F.coalesce("at.bin", F.lit(BINS + 1)).alias("cut"), F.col("at.before").alias("before"))
    cuts = cut_lineage(cuts)
    at_cut = _in_order(valued.drop("goal", "p").join(cuts, "key").where(F.col("bin") == F.col("cut")), "key")
    last = at_cut.groupBy("key").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("more"))
    all_ = docs.groupBy("key").agg(F.sum("size").alias("words"))
    taken = F.when(F.col("before").isNull(), F.col("words")).otherwise(F.col("before") + F.coalesce("more", F.lit(0)))
    return cut_lineage(cuts.join(all_, "key").join(last, "key", "left").select("key", "goal", "p", "cut", "before", taken.alias("taken")))


def _valued(docs: DataFrame, goals: DataFrame) -> DataFrame:
    value = docs.join(goals, "key").withColumn("value", order_value(F.col("u"), F.col("p")))
    return value.withColumn("bin", F.floor(F.col("value") * BINS).cast("int"))


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Marks the rows of a cut's bin that are taken: those of which half or more lies below the goal."""
    order = Window.partitionBy(*keys).orderBy("value", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    return rows.withColumn("drawn", 2.0 * start + F.col("size") <= 2.0 * F.col("goal"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: int = 150, most: int = 2, seed: int = 13,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row.

    ``size`` is the number of words (null text: 0), ``copies`` how many whole times the mix takes
    the row and ``taken`` its words times copies; no row is taken more than ``most`` times. A null
    source is a source of its own. Random numbers are hashes of seed and id (null as empty), so
    reruns agree; rows with one id are drawn side by side and each keeps a row. A row without words is
    taken with its source's whole copies only. An empty table gives no rows; other columns are ignored.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10)
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0))
    source = F.col(source_col).cast("string")
    sized = cut_lineage(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), source.alias("source"), words.cast("bigint").alias("size"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), ((h.cast("double") + 0.5) / float(1 << 52)).alias("u")))
    sums = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - F.col("whole") * F.col("source_size")
    tier = F.lit(TIERS)
    for i in reversed(range(TIERS)):
        tier = F.when(F.col("size") * float(STEP ** (i + 1)) > F.col("left"), i).otherwise(tier)
    placed = cut_lineage(sized.drop("source").join(targets, "key").withColumn("whole", whole.cast("bigint")).withColumn("left", left)
                         .withColumn("tier", F.when((F.col("left") > 0) & (F.col("size") > 0), tier)))
    by_tier = placed.where(F.col("tier").isNotNull()).groupBy("key", "tier", "left", "source_size").agg(F.sum("size").alias("words"))
    # What a source's tiers are to hold up to each one; at most TIERS + 1 rows a source.
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("tier").rowsBetween(Window.unboundedPreceding, 0))
    due = cut_lineage(by_tier.withColumn("due", F.col("left") * (upto / F.col("source_size"))))
    done, cuts = None, None
    for i in sorted(r["tier"] for r in due.select("tier").distinct().collect()):
        goals = due.where(F.col("tier") == i)
        goals = goals.join(done, "key", "left") if done is not None else goals.withColumn("so_far", F.lit(0).cast("bigint"))
        goal = F.least(F.greatest(F.col("due") - F.coalesce("so_far", F.lit(0)), F.lit(0.0)), F.col("words").cast("double"))
        goals = goals.withColumn("goal", goal).where(F.col("goal") > 0).select("key", "goal", (F.col("goal") / F.col("words")).alias("p"))
        docs_ = placed.where(F.col("tier") == i).select("key", "doc_id", "size", "u")
        found = _tier_cuts(docs_, goals)
        mine = found.select("key", F.col("taken").alias("so_far"))
        done = cut_lineage(mine if done is None else done.unionByName(mine).groupBy("key").agg(F.sum("so_far").alias("so_far")))
        found = found.withColumn("tier", F.lit(i))
        cuts = found if cuts is None else cuts.unionByName(found)
    if cuts is None:
        drawn = placed.withColumn("drawn", F.lit(False))
    else:
        cuts = cut_lineage(cuts).withColumnRenamed("key", "k").withColumnRenamed("tier", "t")
        met = placed.join(cuts, (F.col("key") == F.col("k")) & (F.col("tier") == F.col("t")), "left")
        met = met.withColumn("value", order_value(F.col("u"), F.col("p"))).withColumn("bin", F.floor(F.col("value") * BINS).cast("int"))
        at_cut = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
        clear = met.where(~at_cut).withColumn("drawn", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)))
        drawn = clear.unionByName(_in_order(met.where(at_cut), "key", "tier"))
    copies = F.col("whole") + F.col("drawn").cast("bigint")
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes their id; for tables whose ids are unique."""
    times = mixed.where(F.col("copies") > 0).select(F.col("doc_id").alias("_taken_id"), F.col("copies").alias("_copies"))
    met = docs.join(times, F.col(id_col) == F.col("_taken_id")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return met.select(*(F.col(f"`{c}`") for c in docs.columns))
