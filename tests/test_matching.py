"""Nearest vectors against all pairs."""

import random

import numpy as np
import pytest

from tessera.operators import matching

SCHEMA = "vec_id long, material_key string, supplier_id long, embedding array<double>"


def clusters(seed, n, size=12, unit=True):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, size))
    x = centres[r.integers(0, 7, n)] + 0.05 * r.normal(size=(n, size))
    x[::9] = x[0]  # equal ones
    return x / np.linalg.norm(x, axis=1)[:, None] if unit else x * r.uniform(0.1, 3, n)[:, None]


def brute(rows, queries, k):
    out = {}
    for qid, q, own in queries:
        scored = sorted((-round(float(np.dot(v, q)), 6) + 0.0, i) for i, _, s, v in rows if own is None or s != own)
        out[qid] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("unit, k, chunk", [(True, 5, 1 << 16), (True, 40, 20), (False, 10, 1 << 16), (True, 1000, 1 << 16), (True, 1, 7)])
def test_nearest_equals_all_pairs(spark, monkeypatch, unit, k, chunk):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    x = clusters(k, 400, unit=unit)
    rows = [(i, f"k{i % 13}", i % 5, v.tolist()) for i, v in enumerate(x)]
    r = random.Random(k)
    queries = [(100 + j, x[r.randrange(400)].tolist() if j % 3 else (-x[j]).tolist(), r.choice((None, 1, 2))) for j in range(25)] + [(7, [0.0] * 12, None)]
    odd = [(900, "n", 1, None), (901, "n", 1, [None] * 12), (902, "n", 1, [float("nan")] * 12), (903, "n", 1, [1.0]), (904, "n", 1, [])]
    vectors = spark.createDataFrame(rows + odd, SCHEMA)
    asked = spark.createDataFrame([*queries, (8, None, None), (9, [1.0], None)], "query_id long, query array<double>, own long")
    got = {}
    for m in matching.nearest(vectors, asked, k).collect():
        got.setdefault(m.query_id, []).append((m.rank, m.vec_id, m.score))
    want = brute(rows, queries, k)
    assert got.keys() == want.keys()
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(len(want[q])))
        assert [f[1] for f in found] == [i for i, _ in want[q]] and [f[2] for f in found] == pytest.approx([s for _, s in want[q]])
    assert matching.nearest(vectors.limit(0), asked, k).count() == 0 == matching.nearest(vectors, asked.limit(0), k).count()


def test_clusters_are_passed_over():
    x = clusters(3, 3000)
    pivots = x[:54]
    angle = matching._angles(x, pivots)
    cell = angle.argmin(axis=1)
    cells = matching.Cells(pivots, [dict(cell=c, n=int((cell == c).sum()), near=angle[cell == c, c].min(), far=angle[cell == c, c].max(), least=1.0, most=1.0) for c in np.unique(cell).tolist()])
    kth = np.sort(x[:40] @ x.T, axis=1)[:, -10]
    read = (cells.reached(x[:40], kth) * cells.n).sum() / (40 * 3000)
    assert read < 0.4


def test_best_products(spark):
    x = clusters(5, 300)
    rows = [(i, f"k{i % 11}", i % 5, v.tolist()) for i, v in enumerate(x)]
    asked = [(j, x[j].tolist(), None) for j in (3, 50)]
    got = {}
    for b in matching.best_products(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([a[:2] for a in asked], "query_id long, query array<double>"), 4).collect():
        got.setdefault(b.query_id, []).append((b.rank, b.material_key, b.score))
    for q, near in brute(rows, asked, 200).items():
        best = {}
        for i, s in near:
            best[rows[i][1]] = max(best.get(rows[i][1], -2), s)
        order = sorted(best, key=lambda key: (-best[key], key))[:4]
        assert [(k, pytest.approx(best[k])) for k in order] == [(k, s) for _, k, s in sorted(got[q])]
