"""Nearest vectors by pivots against all pairs."""

import numpy as np
import pytest

from larder.plans import vectors as V

RNG = np.random.default_rng(8)


def table(spark, vectors, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors], f"{key} long, vector array<float>")


def brute(rows, queries, limit):
    unit = lambda v: (x := np.asarray(v, np.float32).astype(float)) / (np.linalg.norm(x) or 1)
    out = {}
    for q, v in queries:
        if v is not None:
            found = sorted((-round(float(np.clip(unit(v) @ unit(w), -1, 1)), 9) + 0.0, i) for i, w in rows if w is not None and i != q)
            out[q] = [i for _, i in found[:limit]]
    return {q: f for q, f in out.items() if f}


@pytest.mark.parametrize("clusters", [0, 12])
def test_nearest_equals_all_pairs(spark, clusters, monkeypatch):
    monkeypatch.setattr(V, "CELL_PART_ROWS", 40)
    monkeypatch.setattr(V, "QUERIES_PER_PART", 3)
    centres = RNG.normal(size=(clusters or 1, 16))
    vectors = [(i, centres[i % len(centres)] * bool(clusters) * 5 + RNG.normal(size=16)) for i in range(600)]
    vectors += [(600, np.zeros(16)), (601, None), (602, vectors[7][1]), (603, vectors[7][1] * 3), (604, np.zeros(16))]
    queries = [v for v in vectors if v[0] % 50 == 0] + [(7, vectors[7][1]), (601, None), (604, np.zeros(16)), (9_000, vectors[3][1])]
    seen, looked = [], V._looked
    monkeypatch.setattr(V, "_looked", lambda visits, *a: seen.append(visits.count()) or looked(visits, *a))
    got = {}
    for r in V.nearest(table(spark, vectors, "id"), table(spark, queries, "query_id"), 5, pivots=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == brute(vectors, queries, 5)
    if clusters:  # vectors in groups: most cells are out of reach
        assert sum(seen) < 0.6 * 15 * 16


def test_empty_tables(spark):
    none, some = table(spark, [], "id"), table(spark, [(1, [1.0, 0.0])], "query_id")
    assert V.nearest(none, some).collect() == []
    assert V.nearest(some.withColumnRenamed("query_id", "id"), some.limit(0)).collect() == []
    assert V.nearest(some.withColumnRenamed("query_id", "id"), some).collect() == []
