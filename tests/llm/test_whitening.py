"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from proselens.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, component string"


def plain(data):
    """n, exact deviations by id, eigenvalues and vectors by falling value, trace, centred rows."""
    rows = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v, *_ in data]
    n = len(rows)
    sums = [sum(c) for c in zip(*(x for _, x in rows), strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in rows]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for _, x in rows])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, values[::-1], vectors[:, ::-1], np.trace(centred.T @ centred / n), centred


def check(spark, data, usable, k=8, parts=3):
    df = spark.createDataFrame([(*r, "clash") for r in data], VECTORS).repartition(parts)
    rows = whitening.whiten(df).collect()
    n, deviations, values, vectors, trace, centred = plain(usable)
    k = min(k, sum(values > trace * 1e-12))
    assert len(rows) == n * k
    key = lambda r: (r[0] is None, r[0] or 0)
    got = {}
    for r in rows:
        got.setdefault((key((r.vec_id,)), r.deviation), []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10)
    ids = sorted((key(u), d) for u, d in zip(usable, deviations, strict=True))
    assert sorted((key((r.vec_id,)), r.deviation) for r in rows if r.component == 1) == ids
    if len({u[0] for u in usable}) == n:
        by = {r: i for i, r in enumerate(u[0] for u in usable)}
        y = np.zeros((n, k))
        for r in rows:
            y[by[r.vec_id], r.component - 1] = r.whitened
        assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-9
        for c in range(k):
            gap = min(abs(values[c] - v) for j, v in enumerate(values) if j != c) if len(values) > 1 else values[0]
            if gap > 1e-6 * values[0]:
                own = centred @ vectors[:, c] / np.sqrt(values[c])
                assert min(np.abs(y[:, c] - own).max(), np.abs(y[:, c] + own).max()) < 1e-6
    return rows


def draw(n, d, seed=0, scale=None):
    data = np.random.default_rng(seed).standard_normal((n, d)) * (1 if scale is None else np.array(scale))
    return [(i, [float(np.float32(c)) for c in row], i % 3) for i, row in enumerate(data)]


def test_near_equal_deviations(spark):
    data = draw(600, 12)
    check(spark, data, data)


def test_falling_deviations_and_awkward_rows(spark):
    data = draw(400, 10, 1, [100, 50, 20, 10, 5, 2, 1, 0.5, 0.2, 0.1])
    awkward = [(9_001, None, 1), (9_002, [], 1), (9_003, [1.0] * 9, 1), (9_004, [float("nan")] * 10, 1), (9_005, [float("inf")] + [0.0] * 9, None), (9_006, [None] + [0.0] * 9, 1)]
    zero = [(9_007, [0.0] * 10, None), (None, [1.0] * 10, 2), (9_008, [1.0] * 10, 2)]
    check(spark, data + awkward + zero, data + zero)


def test_null_directions(spark):
    """Two equal dimensions, one that never changes, fewer rows than dimensions, repeated rows."""
    data = [(i, [*v, v[0], 7.0], None) for i, v, _ in draw(200, 6, 2)]
    check(spark, data, data)
    few = draw(4, 9, 3)
    check(spark, few, few)
    check(spark, few + few, few + few)


def test_equal_eigenvalues(spark):
    data = [(k, [2.0 * s if j == k // 2 else 0.0 for j in range(6)], 0) for k in range(12) for s in [1 if k % 2 else -1]]
    rows = whitening.whiten(spark.createDataFrame([(*r, "") for r in data], VECTORS)).collect()
    y = np.zeros((12, 6))
    for r in rows:
        y[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(y.T @ y / 12 - np.eye(6)).max() < 1e-9


def test_no_spread_and_no_rows(spark):
    for data in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)]):
        assert whitening.whiten(spark.createDataFrame([(*r, "") for r in data], VECTORS)).count() == 0


def test_large_whole_numbers(spark):
    data = [(0, [1e9, -1e9]), (1, [-1e9, 1e9]), (2, [3e12, 0.0]), (3, [0.0, 1e30])]
    rows = whitening.whiten(spark.createDataFrame([(*r, 0, "") for r in data], VECTORS)).collect()
    assert {r.component for r in rows} == {1, 2} and all(r.deviation is None or r.deviation >= 0 for r in rows)


def test_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    data = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    check(spark, data, data)
