"""Decision layer: thresholds, gates, overlap, ranking and review texts."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from barloom.functions.series import scan
from barloom.operators.economics import attach_facts
from barloom.operators.signals import FAMILY
from barloom.session import cut_lineage

# The decision layer's knobs.
MISALIGNMENT_PENALTY = 0.08
ALIGNMENT_BONUS = 0.02
NOVELTY_PENALTY = 0.06
MAX_OFFSET = 0.15
MIN_OFFSET = 0.10
HARD_FLOOR = 0.05
HARD_CEILING = 0.99


def effective_threshold(base: Column, alignment: Column | None = None, novel: Column | None = None) -> Column:
    """Context-adjusted confidence bar of one trade.

    Unknown alignment counts as misaligned; the result stays inside a band
    around the trade's own base.
    """
    bar = base
    if alignment is not None:
        bar = bar + F.when(alignment >= 0.5, -ALIGNMENT_BONUS).otherwise(MISALIGNMENT_PENALTY)
    if novel is not None:
        bar = bar + F.when(novel, NOVELTY_PENALTY).otherwise(0.0)
    low = F.greatest(base - MIN_OFFSET, F.lit(HARD_FLOOR))
    high = F.least(base + MAX_OFFSET, F.lit(HARD_CEILING))
    return F.least(F.greatest(bar, low), high)


def gate(trades: DataFrame, base: Column, p: str = "p_win", alignment: str | None = None,
         novel: str | None = None, reject_novel: bool = False) -> DataFrame:
    """Adds ``threshold`` and ``taken``."""
    bar = effective_threshold(base, F.col(alignment) if alignment else None, F.col(novel) if novel else None)
    taken = F.col(p) >= F.col("threshold")
    if reject_novel and novel:
        taken = taken & ~F.col(novel)
    return trades.withColumn("threshold", bar).withColumn("taken", taken)


def non_overlapping(trades: DataFrame, reach: int, keys: list[str] = ["asset"], tie: list[str] = ["signal"],
                    slice_rows: int = 4096) -> DataFrame:
    """Greedy single-position filter in entry order per key.

    A trade is kept when it enters at or after the exit of the last kept one.
    Trades live at most ``reach`` bars, so a slice of positions is a function
    from "bars still busy on entry" (0..reach) to "busy until".  Slices are
    summarised in parallel, the summaries are chained per key (one short row
    per slice), and every slice is then walked once with its true start.
    """
    cols = trades.columns
    part = [*keys, "_slice"]
    sliced = cut_lineage(trades).withColumn("_slice", F.floor(F.col("entry_pos") / slice_rows).cast("long"))
    lean = sliced.select(*part, "entry_pos", "exit_pos", *tie)
    key_types = ", ".join(f"{k} {trades.schema[k].dataType.simpleString()}" for k in keys)
    first_sort = ["entry_pos", *tie]

    def summarise(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(first_sort, kind="mergesort")
        entry, leave = pdf["entry_pos"].to_numpy(), pdf["exit_pos"].to_numpy()
        if (leave - entry).max() > reach:
            raise ValueError("a trade outlives the stated reach")
        n = len(entry)
        follow = np.maximum(np.searchsorted(entry, leave, side="left"), np.arange(n) + 1)
        final = leave.copy()
        for i in range(n - 1, -1, -1):
            if follow[i] < n:
                final[i] = final[follow[i]]
        start = int(pdf["_slice"].iloc[0]) * slice_rows
        busy = start + np.arange(reach + 1)
        at = np.searchsorted(entry, busy, side="left")
        done = np.where(at < n, final[np.minimum(at, n - 1)], busy)
        row = {k: [pdf[k].iloc[0]] for k in part}
        return pd.DataFrame({**row, "_until": [np.maximum(done, busy).astype("int64").tolist()]})

    def chain(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_slice")
        busy, starts = 0, []
        for number, until in zip(pdf["_slice"], pdf["_until"]):
            starts.append(busy)
            busy = int(until[max(0, min(reach, busy - int(number) * slice_rows))])
        return pd.DataFrame({**{k: pdf[k] for k in part}, "_busy": starts})

    def walk(pdf):
        pdf = pdf.sort_values(first_sort, kind="mergesort")
        busy, kept = int(pdf["_busy"].iloc[0]), []
        for entry, leave in zip(pdf["entry_pos"], pdf["exit_pos"]):
            keep = entry >= busy
            kept.append(keep)
            if keep:
                busy = leave
        return pdf.assign(_keep=kept)[out_cols]

    out_cols = [*cols, "_keep"]
    summary = lean.groupBy(*part).applyInPandas(summarise, f"{key_types}, _slice bigint, _until array<bigint>")
    starts = summary.groupBy(*keys).applyInPandas(chain, f"{key_types}, _slice bigint, _busy bigint")
    walked = sliced.join(starts, part).groupBy(*part).applyInPandas(
        walk, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema) + ", _keep boolean")
    return walked.filter("_keep").drop("_keep")


def conviction_score(side: Column, signal: Column, bb_rank: Column, atr_ratio: Column, own_trend: Column,
                     leader: Column) -> Column:
    """Fixed-weight ranking in [0, 1]: leader 0.4, regime fit 0.3, own trend 0.3."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    trend = signal.isin(*[name for name, family in FAMILY.items() if family == "trend"])
    with_leader = unit(0.5 + 0.5 * side * leader)
    fit = F.when(trend, 1.0 - F.coalesce(bb_rank, F.lit(0.5))).otherwise(
        unit(1.2 - F.coalesce(atr_ratio, F.lit(1.0))))
    agree = side * F.signum(own_trend)
    with_trend = unit(F.when(trend, 0.5 + 0.5 * agree).otherwise(0.5 - 0.5 * agree))
    return 0.40 * with_leader + 0.30 * unit(fit) + 0.30 * with_trend


def top_n_per_day(scored: DataFrame, n: int = 4, tie: list[str] = ["asset", "signal"]) -> DataFrame:
    """Best ``n`` scores of each UTC day.

    Ranks use the whole day, so early trades are compared with later ones.
    A first cut inside (day, asset, signal) keeps one day from becoming one
    large sort: no row dropped there could rank among the day's best.
    """
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    order = [F.col("score").desc(), *[F.col(c) for c in tie], F.col("ts")]
    local = Window.partitionBy("_day", *tie).orderBy(*order)
    whole = Window.partitionBy("_day").orderBy(*order)
    first = scored.withColumn("_day", day).withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n).drop("_day", "_r")


def by_threshold(scored: DataFrame, threshold: float | Column) -> DataFrame:
    return scored.filter(F.col("score") >= threshold)


def threshold_for_frequency(scored: DataFrame, per_day: float, digits: int = 6) -> DataFrame:
    """Score cut that admits about ``per_day`` trades per day: one-row frame.

    Scores are reduced to counts per distinct value first; the interpolated
    quantile then needs only two of them.
    """
    counts = cut_lineage(scored.groupBy("score").agg(
        F.count(F.lit(1)).alias("_c"), F.min("ts").alias("_first"), F.max("ts").alias("_last")))
    facts = counts.agg(F.sum("_c").alias("n"), F.min("score").alias("lowest"), F.greatest(
        F.timestamp_diff("DAY", F.min("_first"), F.max("_last")), F.lit(1)).alias("span_days"))
    facts = facts.withColumn("_q", 1.0 - per_day * F.col("span_days") / F.col("n"))
    facts = facts.withColumn("_at", (F.col("n") - 1) * F.col("_q"))
    ranked = scan(counts, [], ["score"], F.floor(F.col("score") * 1000).cast("long"), {"_upto": ("sum", F.col("_c"))})
    ranked = attach_facts(ranked, facts, [])
    holds = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("score")))
    low = F.floor(F.col("_at"))
    cut = ranked.groupBy("n", "lowest", "span_days", "_at").agg(
        holds(low).alias("_lo"), holds(F.least(low + 1, F.col("n") - 1)).alias("_hi"))
    frac = F.col("_at") - low
    value = F.when(per_day * F.col("span_days") >= F.col("n"), F.col("lowest")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac)
    return cut.select("n", "span_days", value.alias("threshold"))


def mark_selected(pool: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Boolean membership of each pool row in a selection."""
    flags = chosen.select(*keys).distinct().withColumn("_in", F.lit(True))
    return pool.join(flags, keys, "left").withColumn("selected", F.coalesce("_in", F.lit(False))).drop("_in")


def gate_flags(trades: DataFrame, base: Column) -> DataFrame:
    """One copy of each trade per gate variant, and whether the variant takes it."""
    p, align, novel = F.col("p_win"), F.col("alignment"), F.col("is_novel")
    takes = {
        "all": F.lit(True), "fixed_055": p >= 0.55, "calibrated": p >= base,
        "alignment": p >= effective_threshold(base, align), "novelty": p >= effective_threshold(base, None, novel),
        "full": p >= effective_threshold(base, align, novel)}
    flags = F.array(*[F.struct(F.lit(n).alias("variant"), F.coalesce(c, F.lit(False)).alias("take")) for n, c in takes.items()])
    return trades.withColumn("_v", F.explode(flags)).select("*", "_v.variant", "_v.take").drop("_v")


def gate_variants(trades: DataFrame, base: Column) -> DataFrame:
    """One copy of each trade per gate variant that takes it."""
    return gate_flags(trades, base).filter("take").drop("take")


def gate_breakdown(trades: DataFrame, tag: str) -> DataFrame:
    return trades.groupBy(tag).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("win_rate"))


# ---------------------------------------------------------------- review texts

# What each rule bets on, as shown to a reviewer.
DESCRIPTIONS = {
    "breakout": "price left its recent channel and should keep going",
    "reversion": "momentum is stretched and should fall back",
    "vol_breakout": "price left its channel after a quiet spell and should keep going",
    "trend_pullback": "price dipped against a trend that should resume",
    "range_fade": "price touched the edge of a steady range and should return",
    "obi_momentum": "resting orders lean to one side and should pull price along",
    "funding_reversion": "holders of one side pay an extreme rate and should unwind",
    "obv_divergence": "price broke out without volume behind it and should return",
    "btc_lead_lag": "the leading coin has moved and this one should follow",
}
# Features a reviewer may see, in display order.
REVIEW_FEATURES = ["RSI_14", "RSI_70", "ATR_ratio", "bb_width", "bb_position", "close_to_sma20", "close_to_sma50",
                   "vol_regime", "roc_10", "roc_20", "funding_rate", "funding_rate_diff", "funding_sma_5"]
CLOSING = "Say approve if the figures bear out this bet in this direction; say reject if they are mixed, unclear or missing."


@F.pandas_udf(StringType())
def _six_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None or v != v else f"{v:.6g}")


def significant(value: Column) -> Column:
    """Six significant digits of the exact binary value, ties to even.

    The JVM's formatter rounds the shortest decimal form half up, so this is an
    Arrow function; texts are made for the few candidates under review only.
    """
    return _six_digits(value.cast("double"))


def review_text(columns: list[str]) -> Column:
    """Text shown for one candidate; features that are absent or null are left out."""
    premise = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv]),
                                      F.col("signal")), F.col("signal"))
    number = significant
    lines = [
        F.concat(F.lit("Asset: "), F.col("asset")),
        F.concat(F.lit("Signal type: "), premise),
        F.concat(F.lit("Candidate: "), F.when(F.col("side") > 0, "LONG").otherwise("SHORT"),
                 F.lit(" at close "), number(F.col("close"))),
        F.concat(F.lit("ATR(14, price units): "), number(F.col("atr")))]
    lines += [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), number(F.col(f))))
              for f in REVIEW_FEATURES if f in columns]
    lines.append(F.lit(CLOSING))
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


#: Characters of a reply's reason that are kept.
REASON_CHARS = 500
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_reply(text: Column, reason_chars: int = REASON_CHARS) -> Column:
    """Model reply to (decision, confidence, reason); anything unclear rejects.

    The text from the first to the last brace must be one strict JSON object: inside
    brackets it parses as an array of exactly one element. A confidence that is not a
    plain number counts as 0.
    """
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.concat(F.lit("["), F.when(body != "", body), F.lit("]")))
    field = lambda name: F.try_variant_get(parsed, f"$[0].{name}", "string")
    readable = F.coalesce(F.size(F.try_variant_get(parsed, "$", "array<variant>")) == 1, F.lit(False))
    decision = F.lower(F.trim(field("decision")))
    number = F.when(field("confidence").rlike(_NUMBER), F.trim(field("confidence")).try_cast("double"))
    confidence = F.least(F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(readable, F.struct(
        F.when(decision.isin("approve", "reject"), decision).otherwise("reject").alias("decision"),
        confidence.alias("confidence"),
        F.substring(F.coalesce(field("reason"), F.lit("")), 1, reason_chars).alias("reason"))).otherwise(F.struct(
            F.lit("reject").alias("decision"), F.lit(0.0).alias("confidence"),
            F.lit("unparseable response").alias("reason")))


def decided(trades: DataFrame, decisions: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Trades with a cached decision, flagged approved."""
    joined = trades.join(decisions, (trades.asset == decisions.asset) & (trades.ts == decisions.signal_time))
    return joined.drop(decisions.asset).drop("signal_time").withColumn(
        "approved", (F.col("decision") == "approve") & (F.col("confidence") >= min_confidence))


def undecided(trades: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates still waiting for a decision."""
    return trades.join(decisions, (trades.asset == decisions.asset) & (trades.ts == decisions.signal_time), "left_anti")
