"""Triangles of a price graph against every triple of its assets."""
import itertools
import random

import pytest

from barloom.operators import triangle as tri

SCHEMA = "snapshot int, base string, quote string, price double"


def brute_force(rows, fee):
    best: dict = {}
    for s, x, y, p in rows:
        if None in (s, x, y, p) or x == y or not 0 < p < float("inf"):
            continue
        for a, b, r in ((x, y, p), (y, x, 1 / p)):
            best[s, a, b] = max(best.get((s, a, b), 0), r)
    out = {}
    for s in {k[0] for k in best}:
        for a, b, c in itertools.combinations(sorted({k[1] for k in best if k[0] == s}), 3):
            legs = [[best.get((s, *leg)) for leg in cycle] for cycle in (((a, b), (b, c), (c, a)), ((a, c), (c, b), (b, a)))]
            if all(all(leg) for leg in legs):
                out[s, a, b, c] = (max(x * y * z for x, y, z in legs) * (1 - fee) ** 3 - 1) * 10_000
    return out


def test_listing_equals_all_triples(spark):
    rng = random.Random(3)
    rows = [(s, rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH"), rng.uniform(0.5, 2)) for s in range(4) for _ in range(14 + 8 * s)]
    # A hub priced against everything, repeated and null rows, prices that take no part.
    rows += [(9, "HUB", f"N{i}", 1.0 + i / 100) for i in range(40)] + [(9, f"N{i}", f"N{i + 1}", 1.01) for i in range(0, 40, 2)]
    rows += rows[:5] + [(None, "A", "B", 1.0), (0, None, "B", 1.0), (0, "A", "B", None), (0, "A", "B", 0.0),
                        (0, "A", "C", -1.0), (0, "B", "C", float("nan")), (0, "B", "C", float("inf"))]
    got = {(r.snapshot, r.a, r.b, r.c): r.edge_bps for r in tri.list_triangles(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_force(rows, 0.001)
    assert got.keys() == want.keys() and sum(k[0] == 9 for k in got) == 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_assets_and_report(spark):
    rows = [(1, "A", "B", 2.0), (1, "B", "C", 2.0), (1, "A", "C", 4.4), (1, "C", "D", 1.0), (1, "B", "D", 2.0)]
    found = tri.list_triangles(spark.createDataFrame(rows, SCHEMA), fee=0.0)
    assets = {r.asset: r for r in tri.triangle_assets(found).collect()}
    # A-C costs 4.4 where A-B-C costs 4; B-C-D is consistent.
    assert (assets["A"].n_triangles, assets["A"].n_viable) == (1, 1)
    assert (assets["B"].n_triangles, assets["B"].n_viable, assets["B"].viable_share) == (2, 1, 0.5)
    assert assets["D"].max_edge_bps == pytest.approx(0) and assets["A"].max_edge_bps == pytest.approx(1000)
    assert [r.asset for r in tri.top_assets(tri.triangle_assets(found), 2).collect()] == ["A", "B"]
    empty = tri.list_triangles(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and tri.triangle_assets(empty).count() == 0
