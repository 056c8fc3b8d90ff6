"""Neighbour search against brute force: recall, exact scores, ties, vectors that take no part."""

from __future__ import annotations

import numpy as np
import pytest

from kpiforge.llm import neighbours


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            s[ids == i] = -np.inf
            top = np.lexsort((ids, -s))[:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in top if s[j] > -np.inf]
    return out


@pytest.mark.parametrize("cell_rows", [8192, 60])
def test_recall_and_scores(spark, cell_rows):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((12, 24))
    x = (centre[rng.integers(0, 12, 900)] + 0.5 * rng.standard_normal((900, 24))).astype(np.float32).astype(float)
    x[100:160] = x[99]  # one vector many times
    ids = np.arange(900)
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.nearest(frame, cell_rows=cell_rows, max_sample=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want, hit = brute(ids, x, 20), 0
    assert got.keys() == want.keys()
    for q, near in want.items():
        ranks = got[q]
        assert sorted(ranks) == list(range(1, 21))
        found = [ranks[i] for i in range(1, 21)]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx((x[v] * x[q]).sum(), abs=1e-12) for v, s in found)
        hit += len({v for v, _ in found} & {v for v, _ in near})
    assert hit / (20 * len(want)) >= 0.9
    assert [v for v, _ in (got[100][i] for i in range(1, 4))] == [99, 101, 102]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (20, [0.0, 2.0])]
    rows += [(None, [1.0, 1.0]), (7, []), (8, [1.0]), (1, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(frame).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 0")).count() == 0


def test_chi_square():
    assert neighbours.chi_square(np.array([0.0, 15.507, 1e9]), 8) == pytest.approx([0, 0.95, 1], abs=1e-4)
