import math

import numpy as np
import pytest
from cadenza.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def brute(rows, most=32):
    """Exact deviations in Python integers; components from numpy's symmetric eigensolver."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(kept), np.array([v for _, v in kept], dtype=object)
    sums = x.sum(axis=0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    c = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in kept], deviation, c @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def check(found, rows, most=32):
    ids, deviation, white, explained = brute(rows, most)
    k = white.shape[1]
    assert len(found) == len(ids) * k
    by = {}
    for r in found:
        by.setdefault(r.component, {})[r.vec_id] = r
        assert r.n == len(ids) and r.identity_error <= 1e-4
    for j in range(k):
        col = np.array([by[j + 1][i].whitened for i in ids])
        sign = np.sign(col @ white[:, j])
        assert np.allclose(col * sign, white[:, j], rtol=1e-6, atol=1e-6)
        assert by[j + 1][ids[0]].explained == pytest.approx(explained[j], rel=1e-6)
        assert [by[j + 1][i].deviation for i in ids] == deviation


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [9, 4, 2, 1, 0.5]).tolist()) for i in range(300)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4)]
    check(whitening.whiten(table(spark, rows + bad)).collect(), rows + bad)
    odd = [(904, [1.0, 2.0]), (905, []), (906, [1e30] * 5)]
    check(whitening.whiten(table(spark, rows + odd)).collect(), rows)
    twice = whitening.whiten(table(spark, rows + [(None, rows[0][1]), (7, rows[7][1])])).collect()
    assert len(twice) == 302 * 5 and sum(r.vec_id is None for r in twice) == 5


def test_without_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0, 3.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)


def test_large_counts_leave_the_deviation_exact_or_null():
    x = np.array([[1_000_000, 1_000_064], [1_000_010, 999_900]])
    n, sums = 10**7, (10**13, 10**13 + 3)
    assert whitening.squares(x, n, sums) == [int((n * int(a) - sums[0]) ** 2 + (n * int(b) - sums[1]) ** 2) for a, b in x]
    assert whitening.squares(x, 10**10, (10**16, 10**16)) == [None, None]


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_rotations_equal_an_svd(d):
    """Small singular values keep their relative accuracy in a matrix of graded columns."""
    rng = np.random.default_rng(d)
    r = np.triu(rng.normal(size=(d, d))) * 10.0 ** -np.linspace(0, 8, d)
    v, s = whitening.rotations(r)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    a = r @ v
    assert np.allclose(a.T @ a, np.diag(s**2), atol=1e-12 * s[0] ** 2)
    assert np.allclose(s, np.linalg.svd(r, compute_uv=False), rtol=1e-6)


def test_levels_of_triangles(spark, monkeypatch):
    """Many partitions and a fan-in of two: the triangle has the products of all rows."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    check(whitening.whiten(table(spark, rows).repartition(13)).collect(), rows)


def test_stored_model_and_the_query(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    model = whitening.fit(v)
    found = whitening.whiten(v, model).collect()
    check(found, rows)
    part = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(v.where("vec_id < 9"), model).collect()}
    whole = {(r.vec_id, r.component): r.whitened for r in found if r.vec_id < 9}
    assert part.keys() == whole.keys() and all(abs(part[k] - whole[k]) < 1e-10 for k in part)
