"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more coordinate, sqrt(M^2 - |v|^2), so that all have norm M and the largest
inner product is the smallest Euclidean distance. Each is keyed by its nearest pivot and its
distance to it. A query visits a pivot's vectors in sorted annuli, nearest bound first: by
the triangle inequality no vector of the annulus [a, b] is nearer than a - d(q, p) or
d(q, p) - b, so the search stops once that bound passes the k-th distance found.
Scores are whole numbers and exact; bounds carry a margin above rounding errors.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import share_bound, share_hash
from barloom.llm.vectors import QUERY_ROWS, UNIT_ROWS, matrix, merge_top_k, one_length, search_units, sizes, top_k
from barloom.session import cut_lineage

#: Pivots, and the rows (at most about) they are chosen from.
PIVOTS, SAMPLE_ROWS = 16, 4_000
#: Rows of one annulus.
ANNULUS = 256


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of the sample, then a few rounds of centring."""
    if not len(sample):
        return np.zeros((1, 0))
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen].astype(np.float64)
    for _ in range(5):
        near = distances(sample, pivots).argmin(1)
        pivots = np.array([sample[near == i].mean(0) if (near == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def lifted(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0.0))[:, None]])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products; doubles are exact while they stay under 2^53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_annuli(ids: np.ndarray, rows: np.ndarray, dist: np.ndarray, q_ids: np.ndarray, queries: np.ndarray,
                  q_dist: np.ndarray, reach: np.ndarray, norm2: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (ids, scores) of its best k rows of one pivot, rows sorted by ``dist``.

    ``reach`` is a distance within which each query's k best are known to lie (inf if not known).
    """
    starts = np.arange(0, len(ids), ANNULUS)
    low, high = dist[starts], dist[np.minimum(starts + ANNULUS, len(ids)) - 1]
    bound = np.maximum(np.maximum(low[None, :] - q_dist[:, None], q_dist[:, None] - high[None, :]), 0.0)
    order = np.argsort(bound, axis=1, kind="stable")
    margin = 1e-6 * (1.0 + np.sqrt(norm2))
    q2 = (queries.astype(np.float64) ** 2).sum(1)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
    limit = reach.copy()
    done, width = 0, 1
    while done < len(starts):
        # The next annuli of every query, twice as many each time, as far as its limit reaches.
        ranks = order[:, done:done + width]
        wanted = np.take_along_axis(bound, ranks, 1) <= limit[:, None] + margin
        if not wanted.any():
            break
        who, col = np.nonzero(wanted)
        where = ranks[who, col]
        gathered: dict[int, list] = {}
        for a in np.unique(where):
            q = who[where == a]
            part = slice(starts[a], min(starts[a] + ANNULUS, len(ids)))
            scores = dots(queries[q], rows[part])
            for i, s in zip(q, scores, strict=True):
                other = ids[part] != q_ids[i]
                gathered.setdefault(int(i), []).append((ids[part][other], s[other]))
        for i, found in gathered.items():
            v = np.concatenate([best[i][0], *(f[0] for f in found)])
            s = np.concatenate([best[i][1], *(f[1] for f in found)])
            near = top_k(v, s, k)
            best[i] = (v[near], s[near])
            if len(near) == k:
                limit[i] = min(limit[i], np.sqrt(max(q2[i] + norm2 - 2.0 * s[near[-1]], 0.0)))
        done += width
        width *= 2
    return best


def pivot_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k largest inner products.

    Both tables have vec_id bigint and vec array<bigint> (whole numbers; shorter vectors
    count as filled up with zeros). A query's own row (same id) is no candidate; fewer than k candidates are all returned; ties go to
    the smaller id; repeated rows count as often as they occur; an empty table gives no rows.
    The driver holds the pivots and four numbers a pivot. Pivots with many vectors are dealt
    to units by a hash, queries to blocks, so no task grows with a pivot.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts, asked = vectors.agg(*sizes(), F.max(norm).alias("norm2")).first(), queries.agg(*sizes()).first()
    n_queries = asked["n"]
    if not facts["n"] or not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    vectors, queries = one_length([vectors, queries], [facts, asked])
    # A margin above the largest norm keeps queries that are no candidates inside as well.
    norm2 = float(facts["norm2"])
    sample = vectors.where(share_hash("vec_id") < share_bound(SAMPLE_ROWS / facts["n"])).select("vec").toArrow()
    if not sample.num_rows:
        sample = vectors.select("vec").limit(1).toArrow()
    pivots = choose_pivots(lifted(matrix(sample.column("vec")).astype(np.float64), norm2), PIVOTS)
    shared = spark.sparkContext.broadcast(pivots)

    def key(batches):
        for b in batches:
            d = distances(lifted(matrix(b.column(1)).astype(np.float64), norm2), shared.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near], pa.float64())],
                                             names=["vec_id", "vec", "pivot", "dist"])

    keyed = cut_lineage(vectors.select("vec_id", "vec").mapInArrow(key, "vec_id bigint, vec array<bigint>, pivot int, dist double"))
    about = {r["pivot"]: r for r in keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    units = {p: -(-r["n"] // UNIT_ROWS) for p, r in about.items()}
    blocks = -(-n_queries // QUERY_ROWS)
    per_pivot = F.create_map(*(F.lit(x) for p, u in units.items() for x in (p, u)))
    index = (keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), per_pivot[F.col("pivot")]).cast("int"))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
             .withColumn("unit", F.col("pivot").cast("bigint") * F.lit(1 << 20) + F.col("salt")))
    # A query from outside the table may be longer than all candidates; its lifted coordinate is 0 by choice.
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.monotonically_increasing_id().alias("query_row"))
    q = cut_lineage(q.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int")))

    schema = ("query_row bigint, query_id bigint, query array<bigint>, block int, unit bigint, q_dist double, reach double")

    def route(first_round: bool):
        def run(batches):
            ps = sorted(about)
            lo, hi = (np.array([about[p][c] for p in ps]) for c in ("lo", "hi"))
            for b in batches:
                v = matrix(b.column("query")).astype(np.float64)
                d = query_distances(v, shared.value[ps], norm2)
                if first_round:
                    near = d.argmin(1)
                    rows, cols = np.arange(len(near)), near
                    reach = np.full(len(near), np.inf)
                else:
                    reach_of = b.column("reach").to_numpy(zero_copy_only=False)
                    bound = np.maximum(np.maximum(lo[None, :] - d, d - hi[None, :]), 0.0)
                    rows, cols = np.nonzero(bound <= reach_of[:, None] + 1e-6 * (1.0 + np.sqrt(norm2)))
                    reach = reach_of[rows]
                counts = np.array([1 if first_round else units[ps[c]] for c in cols], np.int64)
                take = np.repeat(np.arange(len(rows)), counts)
                salt = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, np.int64)
                picked = b.select(["query_row", "query_id", "query", "block"]).take(pa.array(rows[take]))
                unit = np.array(ps, np.int64)[cols[take]] * (1 << 20) + salt
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(unit), pa.array(d[rows[take], cols[take]]), pa.array(reach[take])],
                                                 names=[*picked.schema.names, "unit", "q_dist", "reach"])
        return run

    def search(rows: pa.Table, asked: pa.Table) -> dict:
        dist = rows.column("dist").to_numpy()
        order = np.argsort(dist, kind="stable")
        ids, vecs = rows.column("vec_id").to_numpy()[order], matrix(rows.column("vec"))[order]
        q_ids, q_rows = asked.column("query_id").to_numpy(), asked.column("query_row").to_numpy()
        best = search_annuli(ids, vecs, dist[order], q_ids, matrix(asked.column("query")), asked.column("q_dist").to_numpy(),
                             asked.column("reach").to_numpy().copy(), norm2, k)
        n = [len(v) for v, _ in best]
        return {"query_row": np.repeat(q_rows, n), "query_id": np.repeat(q_ids, n),
                "vec_id": np.concatenate([v for v, _ in best]), "score": np.concatenate([s for _, s in best])}

    # First round: one unit of the nearest pivot gives each query a distance that its k best cannot pass.
    home = search_units(index, q.mapInArrow(route(True), schema), search, "bigint")
    q2 = F.aggregate("query", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kth = home.groupBy("query_row").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    reach = (q.join(kth, "query_row", "left")
             .withColumn("reach", F.when(F.col("found") >= k, F.sqrt(F.greatest(F.lit(0.0), q2 + norm2 - 2.0 * F.col("kth")))).otherwise(float("inf"))))
    found = search_units(index, reach.select(*q.columns, "reach").mapInArrow(route(False), schema), search, "bigint")
    return merge_top_k(found, k)


def query_distances(v: np.ndarray, pivots: np.ndarray, norm2: float) -> np.ndarray:
    """Distances of queries, lifted by 0, to pivots: |q|^2 + M^2 - 2 q.v orders candidates as q.v does."""
    return distances(np.hstack([v, np.zeros((len(v), 1))]), pivots)
