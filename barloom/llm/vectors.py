"""Shared parts of the vector searches: valid rows, fixed-size units, query blocks, merged results."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Index rows of one unit and queries of one block that meet in a task.
UNIT_ROWS = 32_768
QUERY_ROWS = 16_384


def finite_vectors(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """vec_id, vec (array<double>): rows whose vector has no null or non-finite component; null ids are left out."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = df.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("vec"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(~bad)
    return found.where(F.exists("vec", lambda c: c != 0)) if drop_zero else found


def sizes() -> list[Column]:
    """Aggregates of a vector table: n, and the longest and shortest vector."""
    return [F.count("*").alias("n"), F.max(F.size("vec")).alias("longest"), F.min(F.size("vec")).alias("shortest")]


def one_length(tables: list[DataFrame], facts: list[Row]) -> list[DataFrame]:
    """The tables with shorter vectors filled up with zeros, which no inner product between them notices."""
    longest = max(f["longest"] for f in facts)
    if all(f["shortest"] == longest for f in facts):
        return tables

    def fill(df: DataFrame) -> DataFrame:
        zero = F.lit(0).cast(df.schema["vec"].dataType.elementType)
        return df.withColumn("vec", F.concat("vec", F.array_repeat(zero, F.lit(longest) - F.size("vec"))))

    return [fill(df) for df in tables]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column; vectors of one table have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), flat.dtype)


def top_k(vec_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((vec_ids[near], -scores[near]))[:k]]


def merge_top_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score from the units' own best rows."""
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_units(index: DataFrame, routed: DataFrame, search: Callable[[pa.Table, pa.Table], dict], score_type: str) -> DataFrame:
    """Meet index rows (unit, block) with query rows (unit, block) and collect each query's best.

    Both sides are bounded: a unit by ``UNIT_ROWS``, a block by ``QUERY_ROWS`` (on average;
    both are dealt by hashes of unique rows).
    """
    kind = pa.int64() if score_type == "bigint" else pa.float64()
    arrow = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return arrow.empty_table()
        return pa.table({n: pa.array(v) for n, v in search(rows, queries).items()}).cast(arrow)

    return (index.groupBy("unit", "block").cogroup(routed.groupBy("unit", "block"))
            .applyInArrow(meet, f"query_row bigint, query_id bigint, vec_id bigint, score {score_type}"))
