import numpy as np
import pytest

from barloom.llm import collision_search, pivot_search, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, unit int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, 1) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    v = centres[rng.integers(0, 6, 600)] + 0.4 * rng.standard_normal((600, 16))
    v[100:110] = v[7]  # copies tie
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def whole(df):
    from pyspark.sql import functions as F

    fine = vectors.finite_vectors(df, "vec_id", "embedding", drop_zero=False)
    return fine.select("vec_id", F.transform("vec", lambda x: F.floor(256 * x).cast("bigint")).alias("vec"))


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    out = set()
    for q in queries:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out |= {(q, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    return out


def test_pivot_search_is_exact(spark, clustered):
    df = whole(table(spark, clustered))
    got = {tuple(r) for r in pivot_search.pivot_top_k(df, df.where("vec_id % 50 = 0"), 5).collect()}
    assert got == brute(clustered, range(0, 600, 50), 5)


def test_pivot_search_over_many_units(spark, clustered, monkeypatch):
    monkeypatch.setattr(pivot_search, "UNIT_ROWS", 40)
    monkeypatch.setattr(pivot_search, "QUERY_ROWS", 7)
    df = whole(table(spark, clustered))
    got = {tuple(r) for r in pivot_search.pivot_top_k(df, df.where("vec_id % 50 = 0"), 5).collect()}
    assert got == brute(clustered, range(0, 600, 50), 5)


def test_fewer_candidates_and_invalid_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [1.0, float("nan")]), (3, None), (4, [1.0, None]), (None, [1.0, 1.0]), (5, [-1.0, 0.5])]
    df = whole(table(spark, rows))
    got = {tuple(r) for r in pivot_search.pivot_top_k(df, df.where("vec_id = 0"), 5).collect()}
    assert got == {(0, 1, 1, 0), (0, 2, 5, -256 * 256 + 512 * 128)}
    near = vectors.finite_vectors(table(spark, rows), "vec_id", "embedding", drop_zero=True)
    found = collision_search.collision_top_k(near, near.where("vec_id = 0"), 5).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 5, 0.0)]


def test_empty_tables(spark):
    df = whole(table(spark, [(0, None)]))
    assert pivot_search.pivot_top_k(df, df, 5).count() == 0
    near = vectors.finite_vectors(table(spark, [(0, None)]), "vec_id", "embedding", drop_zero=True)
    assert collision_search.collision_top_k(near, near, 5).count() == 0


def test_collision_search_recall_and_scores(spark, clustered):
    df = vectors.finite_vectors(table(spark, clustered), "vec_id", "embedding", drop_zero=True)
    got = collision_search.collision_top_k(df, df.where("vec_id % 20 = 0"), 20).collect()
    m = np.array([v for _, v in clustered])
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - m[r.query_id] @ m[r.vec_id]) < 1e-9
    hits = 0
    for q, rows in found.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        s = m @ m[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {v for _, v, _ in rows})
    assert len(found) == 30 and hits / 600 >= 0.9


def test_equal_vectors_tie_to_the_smaller_id(spark, clustered):
    short = [(i, [float(x / np.linalg.norm(v)) for x in v]) for i, v in clustered]
    df = vectors.finite_vectors(table(spark, short), "vec_id", "embedding", drop_zero=True)
    got = collision_search.collision_top_k(df, df.where("vec_id = 7"), 10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(100, 110))


def test_unequal_lengths_are_filled_up(spark, clustered):
    cut = [(i, v[:16 - i % 5]) for i, v in clustered[:200]]
    filled = [(i, v + [0.0] * (16 - len(v))) for i, v in cut]
    df = whole(table(spark, cut))
    got = {tuple(r) for r in pivot_search.pivot_top_k(df, df.where("vec_id % 50 = 1"), 5).collect()}
    assert got == brute(filled, range(1, 200, 50), 5)
    near, even = (vectors.finite_vectors(table(spark, rows), "vec_id", "embedding", drop_zero=True) for rows in (cut, filled))
    search = lambda found: {tuple(r) for r in collision_search.collision_top_k(found, found.where("vec_id % 50 = 1"), 5).collect()}
    assert search(near) == search(even) and len(search(near)) == 20


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.5, 1.0]), (5, [0.5, 1.0]), (7, [0.25, 0.0])]
    df = whole(table(spark, rows))
    got = sorted(tuple(r) for r in pivot_search.pivot_top_k(df, df.where("vec_id = 0"), 5).collect())
    assert got == sorted(2 * [(0, 1, 5, 128 * 256), (0, 2, 5, 128 * 256), (0, 3, 7, 64 * 256)])
    near = vectors.finite_vectors(table(spark, rows), "vec_id", "embedding", drop_zero=True)
    got = sorted(tuple(r) for r in collision_search.collision_top_k(near, near.where("vec_id = 0"), 5).collect())
    assert got == sorted(2 * [(0, 1, 5, 0.5), (0, 2, 5, 0.5), (0, 3, 7, 0.25)])
