"""op11: recall against brute force, exact scores, odd vectors."""

import math
import random

import numpy as np
import pytest

from seamline.llm import neighbours, registry
from seamline.sources.tables import table


def brute(rows, every=50, k=5):
    """{query: [(vec_id, score)]} over vectors that take part, of rows that repeat a key the least vector."""
    kept = {}
    for key, v in rows:
        if key is None or v is None or not all(x is not None and math.isfinite(x) for x in v) or not any(v):
            continue
        kept[key] = min(kept.get(key, v), v)
    cos = lambda a, b: float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b)))
    found = {}
    for q in (q for q in kept if q % every == 0):
        scored = [(-round(cos(kept[q], v), 12), key) for key, v in kept.items() if key != q and len(v) == len(kept[q])]
        found[q] = [(key, -s) for s, key in sorted(scored)[:k]]
    return {q: f for q, f in found.items() if f}


def as_dict(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_odd_vectors_are_searched_in_full(spark):
    """Copies, scaled copies, ties, other lengths and vectors that take no part; few enough that all are visited."""
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, base[i % 30] if i % 3 else [2 * x for x in base[i % 30]]) for i in range(200)]
    rows += [(1000 + i, [1.0, 1.0, 0.0]) for i in range(120)] + [(2000, [1.0, 2.0, 2.5]), (2050, [0.5])]
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [1.0, None] * 4), (3150, [float("nan")] * 8), (3200, [float("inf")] * 8), (3250, []), (None, base[0]), (50, base[7]), (50, base[7]), (150, [9.0] * 8)]
    df = spark.createDataFrame([(v, k, "x", 1, 0.5) for k, v in rows], "embedding array<double>, vec_id long, label string, rank int, score double").repartition(3)
    got, want = as_dict(neighbours.nearest(df)), brute(rows)
    assert got == want
    assert got[1000] == [(k, 1.0) for k in range(1001, 1006)]
    assert neighbours.nearest(df.limit(0)).collect() == []


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    got, want = as_dict(registry.op11_stable_projections(spark, folder)), brute(rows)
    hits = sum(len({k for k, _ in got[q]} & {k for k, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(f) for q, f in want.items()}
    assert all(abs(s - scores[q][k]) < 1e-9 for q in got for k, s in got[q] if k in scores[q])


def test_stopping_test_prunes_clusters():
    """Queries in tight clusters look at their own cluster only, and find what brute force finds."""
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 48))
    vectors = np.repeat(centres, 50, axis=0) + 0.01 * r.standard_normal((2000, 48))
    point, ids = neighbours.project(vectors), np.arange(2000)
    asked = np.arange(0, 2000, 50)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.argsort(-(unit[asked] @ unit.T), axis=1)[:, :6]
    found = neighbours.search(vectors, point, vectors[asked], point[asked], np.full(40, np.inf), 6, ids)
    assert sum(len(set(f[0].tolist()) & set(w.tolist())) for f, w in zip(found, want)) >= 0.9 * 240
    kth = 2 - 2 * (unit[asked] @ unit.T)[np.arange(40)[:, None], want][:, -1]
    near = ((point[asked][:, None] - point) ** 2).sum(axis=2) < neighbours.chi2_point() * kth[:, None]
    assert near.mean() < 0.05


@pytest.mark.parametrize("sure", [0.5, 0.9, 0.96])
def test_chi_square(sure):
    x = neighbours.chi2_point(sure)
    draws = (np.random.default_rng(7).standard_normal((200_000, neighbours.DIMS)) ** 2).sum(axis=1)
    assert abs((draws <= x).mean() - sure) < 0.005
