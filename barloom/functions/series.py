"""Ordered-series toolkit: every window in the library is built from these.

One asset may hold a third of all rows, so nothing here sorts a whole asset in
one task.  Two layouts split a series:

* ``slice_bars`` cuts numbered bars into fixed runs of positions and copies the
  rows just before (and after) each run into it, so bounded look-backs need a
  single shuffle on ``(asset, slice)``;
* ``scan`` cuts by any monotone slice column and carries a small per-slice
  summary forward, so running sums, maxima and last-known values are exact
  over the whole history.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One decay block.  It must be long enough that the slowest average (1/70)
# forgets everything older than one block (d^2800 = 3e-18) and short enough
# that the fastest (2/10) does not overflow a double inside it (0.8^-2800 = 1e271).
BLOCK_ROWS = 2800
SLICE_BLOCKS = 10
BUCKET_DAYS = 32

_DAY_US = 86_400_000_000


def time_bucket(ts: Column, days: float = BUCKET_DAYS) -> Column:
    """Integer bucket of ``days`` that grows with time."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(int(days * _DAY_US))).cast("long")


# ---------------------------------------------------------------- running scans

def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "product":
        return F.product(value)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    raise ValueError(f"unknown scan kind {kind!r}")


def _running(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}[kind](value).over(window)


def _merge(kind: str, local: Column, before: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNull() & before.isNull(), None).otherwise(
            F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0)))
    if kind == "product":
        return F.coalesce(before, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
    if kind == "max":
        return F.greatest(local, before)
    if kind == "min":
        return F.least(local, before)
    return F.coalesce(local, before)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
         outputs: Mapping[str, tuple[str, Column]], exclusive: bool | Sequence[str] = False) -> DataFrame:
    """Running aggregates over the full history of each key.

    ``outputs`` maps a new column to ``(kind, value)`` with kind one of sum,
    product, max, min, last (latest non-null).  ``slice_by`` must never decrease along
    ``order``.  Rows are sorted only inside ``(keys, slice)``; what crosses a
    slice border is one summary row per slice.  Outputs named in ``exclusive``
    (or all of them, if true) leave the current row out.

    The input is read twice, so chains of scans should be separated by
    ``barloom.session.cut_lineage``.
    """
    keys = list(keys)
    order_struct = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    sliced = df.withColumn("_slice", slice_by)
    part = [*keys, "_slice"]
    open_end = list(outputs) if exclusive is True else list(exclusive or [])

    def local(name: str):
        return Window.partitionBy(*part).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1 if name in open_end else 0)

    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    summary = sliced.groupBy(*part).agg(
        *[_total(kind, value, order_struct).alias(f"_t_{name}") for name, (kind, value) in outputs.items()])
    summary = summary.select(*part, *[
        _running(kind, F.col(f"_t_{name}"), earlier).alias(f"_b_{name}")
        for name, (kind, _) in outputs.items()])

    out = sliced.select("*", *[
        _running(kind, value, local(name)).alias(f"_l_{name}") for name, (kind, value) in outputs.items()])
    out = out.join(summary, part, "left")
    keep = [F.col(c) for c in df.columns if c not in outputs]
    return out.select(*keep, *[
        _merge(kind, F.col(f"_l_{name}"), F.col(f"_b_{name}")).alias(name)
        for name, (kind, _) in outputs.items()])


def number_rows(df: DataFrame, keys: Sequence[str] = ("asset",), order: Sequence[str] = ("ts",),
                slice_by: Column | None = None, name: str = "pos") -> DataFrame:
    """Zero-based position of every row inside its key."""
    slice_by = time_bucket(F.col(order[0])) if slice_by is None else slice_by
    counted = scan(df, keys, order, slice_by, {name: ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(name, F.col(name) - 1)


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("asset",),
                 order: Sequence[str] = ("ts",), slice_by: Column | None = None) -> DataFrame:
    """Replace nulls by the latest earlier value of the same key."""
    slice_by = time_bucket(F.col(order[0])) if slice_by is None else slice_by
    filled = scan(df, keys, order, slice_by,
                  {f"_f_{c}": ("last", F.col(c)) for c in columns})
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- sliced bars

def slice_bars(bars: DataFrame, back: int, ahead: int = 0,
               slice_rows: int = BLOCK_ROWS * SLICE_BLOCKS) -> DataFrame:
    """Lay numbered bars out for bounded windows.

    Adds ``slice`` and ``own``.  The ``back`` rows before a slice and the
    ``ahead`` rows after it are copied in with ``own = false``; compute over
    ``bar_frame()`` and keep ``own`` rows.
    """
    if back > slice_rows or ahead > slice_rows:
        raise ValueError("a look-back must fit inside one slice")
    home = F.floor(F.col("pos") / slice_rows).cast("long")
    offset = F.col("pos") % slice_rows
    copies = [F.struct(home.alias("slice"), F.lit(True).alias("own"))]
    if back:
        copies.append(F.when(offset >= slice_rows - back,
                             F.struct((home + 1).alias("slice"), F.lit(False).alias("own"))))
    if ahead:
        copies.append(F.when((offset < ahead) & (home > 0),
                             F.struct((home - 1).alias("slice"), F.lit(False).alias("own"))))
    laid = bars.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
    return laid.select(*[c for c in bars.columns], F.col("_copy.slice"), F.col("_copy.own"))


FRAME = "PARTITION BY asset, slice ORDER BY pos"


def bar_frame():
    return Window.partitionBy("asset", "slice").orderBy("pos")


def own_rows(laid: DataFrame) -> DataFrame:
    return laid.filter("own").drop("slice", "own")


# The builders below return SQL text for ``selectExpr``: a feature is one
# string, parsed once in the JVM.

def back_rows(n: int, shift: int = 0) -> str:
    """Window over the ``n`` rows ending ``shift`` rows before the current one."""
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"({FRAME} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"


def shifted(value: str, k: int = 1) -> str:
    return f"lag({value}, {k}) OVER ({FRAME})"


def change(value: str, k: int = 1) -> str:
    """Relative change over ``k`` rows; null when the earlier value is missing or zero."""
    return f"try_divide({value}, {shifted(value, k)}) - 1"


def rolling(fn: str, value: str, n: int, shift: int = 0, first: int | None = None) -> str:
    """``fn`` over a full window of ``n`` values, null while the window is short.

    ``first`` is the position of the first value of a column without later
    gaps; the guard is then a comparison instead of a second windowed count.
    """
    window = back_rows(n, shift)
    full = f"count({value}) OVER {window} = {n}" if first is None else f"pos >= {first + n - 1 + shift}"
    return f"CASE WHEN {full} THEN {fn}({value}) OVER {window} END"


def rolling_rank(value: str, n: int) -> str:
    """Average-rank percentile of the newest value inside its last ``n``; reads ``_seen``."""
    return (f"CASE WHEN size(_seen) = {n} THEN (size(filter(_seen, v -> v < {value}))"
            f" + (size(filter(_seen, v -> v = {value})) + 1) / 2.0D) / {float(n)}D END")


def seen_values(value: str, n: int, shift: int = 0) -> str:
    return f"collect_list({value}) OVER {back_rows(n, shift)}"


def sorted_window(value: str, n: int, shift: int) -> str:
    seen = seen_values(value, n, shift)
    return f"CASE WHEN size({seen}) = {n} THEN sort_array({seen}) END"


def quantile_of_sorted(values: str, n: int, q: float) -> str:
    """Linear-interpolated quantile of a sorted array of known length."""
    at = (n - 1) * q
    low = math.floor(at)
    lo, hi = f"{values}[{low}]", f"{values}[{low + 1}]"
    return lo if at == low else f"({lo} + ({hi} - {lo}) * {at - low!r}D)"


def add_ewm(laid: DataFrame, specs: Mapping[str, tuple[str, float]],
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Recursive exponential averages ``y = alpha*x + (1-alpha)*y_prev``.

    ``specs`` maps a new column to ``(source column, alpha)``.  The source must
    be null only before its series starts; the average is seeded with the first
    value.  Inside one block the recursion is a running sum of ``x*d^-k``
    scaled by ``d^k``; the value at the end of the previous block, decayed,
    carries everything older.
    """
    rates = {name: -math.log(1 - alpha) for name, (_, alpha) in specs.items()}
    if any(rate * block_rows > 700 or rate * block_rows < 36 for rate in rates.values()):
        raise ValueError("block length does not suit these decay rates")
    k = f"(pos % {block_rows})"
    in_block = (f"(PARTITION BY asset, slice, floor(pos / {block_rows}) ORDER BY pos"
                " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    before = f"({FRAME} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sources = sorted({source for source, _ in specs.values()})
    # A series starts where the value appears and nothing precedes it; at the
    # head of a copied-in border the true predecessor is unknown but pos > 0.
    flagged = laid.selectExpr("*", *[
        f"{s} IS NOT NULL AND (pos = 0 OR ({shifted(s)} IS NULL AND {shifted('pos')} IS NOT NULL)) AS _first_{s}"
        for s in sources])
    local = flagged.selectExpr("*", *[
        f"exp({-rates[name]!r}D * {k}) * sum(CASE WHEN _first_{source} THEN 1.0D ELSE {alpha!r}D END * {source}"
        f" * exp({rates[name]!r}D * {k})) OVER {in_block} AS _loc_{name}"
        for name, (source, alpha) in specs.items()])
    carried = local.selectExpr("*", *[
        f"last_value(CASE WHEN {k} = {block_rows - 1} THEN _loc_{name} END) IGNORE NULLS OVER {before} AS _end_{name}"
        for name in specs])
    return carried.selectExpr(*[f"`{c}`" for c in laid.columns], *[
        f"CASE WHEN {source} IS NOT NULL THEN _loc_{name} + exp({-rates[name]!r}D * ({k} + 1))"
        f" * coalesce(_end_{name}, 0D) END AS {name}" for name, (source, _) in specs.items()])


# ---------------------------------------------------------------- as-of

def attach_asof(left: DataFrame, right: DataFrame, columns: Sequence[str],
                keys: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """Latest right-hand value at or before each left row, never a later one."""
    keys = list(keys)
    left_cols = left.columns
    tagged_left = left.select("*", F.lit(1).alias("_side"),
                              *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns])
    tagged_right = right.select(
        *[F.col(c) if c in keys or c == ts else F.lit(None).cast(left.schema[c].dataType).alias(c)
          for c in left_cols],
        F.lit(0).alias("_side"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = tagged_left.unionByName(tagged_right)
    known = scan(both, keys, [ts, "_side"], time_bucket(F.col(ts)),
                 {f"_k_{c}": ("last", F.col(f"_r_{c}")) for c in columns})
    return known.filter("_side = 1").select(*left_cols, *[F.col(f"_k_{c}").alias(c) for c in columns])
