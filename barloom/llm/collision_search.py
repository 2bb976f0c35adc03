"""Approximate nearest neighbours by collision counting over single projections.

Vectors get one more coordinate, sqrt(M^2 - |v|^2), so that the largest inner product is the
smallest Euclidean distance. Each of ``PROJECTIONS`` random directions gives one sorted array
of projected values. A query opens a window around its own projection in every array
and widens all of them together (virtual rehashing: radius R, c R, c^2 R, ...); a vector
that falls into the windows of at least ``THRESHOLD`` arrays is verified. The search ends
when k verified vectors lie within the current radius: every vector within it collides
often enough with a probability of about 0.97, so that is the expected recall. No number
of candidates ends it earlier.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.vectors import QUERY_ROWS, UNIT_ROWS, matrix, merge_top_k, one_length, search_units, sizes, top_k
from barloom.session import cut_lineage

#: Projections, collisions that make a candidate, half a window's width in radii, growth of the radius, seed.
PROJECTIONS, THRESHOLD, HALF_WIDTH, GROWTH, SEED = 32, 20, 1.2, 1.2, 11


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def in_order_dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed component by component in double precision, alike for equal rows."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * q[j]
    return total


class SortedProjections:
    """The index of one unit: per direction the projected values in order and whose they are."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, norm2: float):
        self.ids, self.rows, self.norm2 = ids, rows, norm2
        lift = np.sqrt(np.maximum(norm2 - (rows * rows).sum(1), 0.0))
        values = np.hstack([rows, lift[:, None]]) @ projections(rows.shape[1] + 1)
        self.whose = np.argsort(values, axis=0, kind="stable").astype(np.int32).T.copy()
        self.values = np.take_along_axis(values.T, self.whose, 1)

    def first_radius(self, k: int) -> float:
        """Half the k-th distance that is usual in the unit (of some rows as queries); the start only affects time."""
        some = self.rows[:: max(1, len(self.rows) // 32)]
        scores = np.partition(some @ self.rows.T, max(0, len(self.rows) - k), axis=1)[:, max(0, len(self.rows) - k)]
        d2 = (some * some).sum(1) + self.norm2 - 2.0 * scores
        return max(0.5 * float(np.sqrt(np.maximum(np.median(d2), 0.0))), 1e-6 * (1.0 + np.sqrt(self.norm2)))

    def search(self, query_id: int, q: np.ndarray, at: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest found; ``at`` holds the query's projections."""
        n, q2 = len(self.ids), float(q @ q)
        counts = np.zeros(n, np.int64)
        low = high = None
        checked = np.zeros(n, bool)
        found, scores = [], []
        own = self.ids == query_id
        while True:
            half = HALF_WIDTH * radius
            new_low = np.array([np.searchsorted(v, x - half, "left") for v, x in zip(self.values, at, strict=True)])
            new_high = np.array([np.searchsorted(v, x + half, "right") for v, x in zip(self.values, at, strict=True)])
            if low is None:
                fresh = [w[a:b] for w, a, b in zip(self.whose, new_low, new_high, strict=True)]
            else:
                fresh = [w[a:b] for w, a, b in zip(self.whose, new_low, low, strict=True)] + [w[a:b] for w, a, b in zip(self.whose, high, new_high, strict=True)]
            low, high = new_low, new_high
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((counts >= THRESHOLD) & ~checked)
            checked[new] = True
            new = new[~own[new]]
            found.append(new)
            scores.append(self.rows[new] @ q)
            reached = np.concatenate(scores)
            within = np.count_nonzero(q2 + self.norm2 - 2.0 * reached <= radius * radius)
            if within >= k or (low == 0).all() and (high == n).all():
                break
            radius *= GROWTH
        near = np.concatenate(found)
        if len(near) > k:
            cut = np.partition(reached, len(reached) - k)[len(reached) - k]
            near = near[reached >= cut - 1e-9 * (1.0 + abs(cut))]
        exact = in_order_dots(self.rows[near], q)
        best = top_k(self.ids[near], exact, k)
        return self.ids[near][best], exact[best]


def collision_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query row.

    Both tables have vec_id bigint and vec array<double>; shorter vectors count as filled up with zeros. A query's own row (same id)
    is no candidate; with fewer than k candidates all are returned; ties go to the smaller id;
    repeated rows count as often as they occur; an empty table gives no rows. Rows are dealt to units by a
    hash and queries to blocks; every row is indexed.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    facts, asked = vectors.agg(*sizes(), F.max(norm).alias("norm2")).first(), queries.agg(*sizes()).first()
    n_queries = asked["n"]
    if not facts["n"] or not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors, queries = one_length([vectors, queries], [facts, asked])
    norm2 = float(facts["norm2"])
    # At least a few units, so that a small table is searched side by side as well.
    units, blocks = max(1, -(-facts["n"] // UNIT_ROWS)), -(-n_queries // QUERY_ROWS)
    spread = max(1, -(-8 // units)) if n_queries > 256 else 1
    blocks = max(blocks, spread)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = vectors.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(units)).cast("int").alias("unit"), every(blocks).alias("block"))
    q = cut_lineage(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.monotonically_increasing_id().alias("query_row")))
    routed = q.select("*", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int").alias("block"), every(units).alias("unit"))

    def search(rows: pa.Table, asked: pa.Table) -> dict:
        at = SortedProjections(rows.column("vec_id").to_numpy(), matrix(rows.column("vec")), norm2)
        qs = matrix(asked.column("query"))
        where = np.hstack([qs, np.zeros((len(qs), 1))]) @ projections(qs.shape[1] + 1)
        q_ids, q_rows = asked.column("query_id").to_numpy(), asked.column("query_row").to_numpy()
        radius = at.first_radius(k)
        best = [at.search(i, v, w, k, radius) for i, v, w in zip(q_ids, qs, where, strict=True)]
        n = [len(v) for v, _ in best]
        return {"query_row": np.repeat(q_rows, n), "query_id": np.repeat(q_ids, n),
                "vec_id": np.concatenate([v for v, _ in best]), "score": np.concatenate([s for _, s in best])}

    return merge_top_k(search_units(index, routed, search, "double"), k)
