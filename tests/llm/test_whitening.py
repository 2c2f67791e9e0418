import math

import numpy as np
import pytest

from threatframe.llm import whitening


def plain(rows):
    """(kept rows with whole numbers, distinct vectors, covariance) by numpy's own means."""
    good = [(k, e) for k, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    x = [(k, tuple(math.floor(64.0 * c) + 1_000_000 for c in e)) for k, e in good]
    fit = sorted({v for _, v in x})
    return x, fit, np.cov(np.array(fit, float).T, bias=True)


def held(got, rows, components=16):
    x, fit, v = plain(rows)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == len(x) * k
    onto = np.linalg.eigh(v)[1][:, ::-1][:, :k] / np.sqrt(values[:k])
    dots = np.zeros(k)
    for key, e in x:
        want = (np.array(e) - np.array(sums) / n) @ onto
        mine = np.array([by[key][c + 1][0].whitened for c in range(k)])
        dots += want * mine
        assert np.allclose(np.abs(want), np.abs(mine), atol=1e-7)
        r = by[key][1][0]
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(e, sums, strict=True))
    assert (np.abs(dots) > 0.99 * n * 0.5).all() or n < 3  # one sign for all rows
    assert np.allclose([by[x[0][0]][c + 1][0].explained for c in range(k)], values[:k] / np.trace(v), rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-8


def test_whitening_equals_dense_decomposition(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    held(whitening.op13_spectrum_whitening(spark, sf).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # copies are fitted once
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(k, e, "x", "y", "z") for k, e in rows + bad], "vec_id long, embedding array<double>, packed string, size string, component string")
    held(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.filter("vec_id >= 200 and vec_id < 205")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 0 or vec_id between 100 and 199")).count() == 0  # one vector, no variance
    named = df.filter("vec_id < 60").selectExpr("CASE WHEN vec_id < 2 THEN NULL ELSE vec_id END AS vec_id", "embedding")
    assert whitening.whiten(named).filter("vec_id IS NULL").count() == 10


def test_fewer_vectors_than_components_and_huge_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    held(got, rows)
    big = [(i, [1e9 * (i % 3), float(i % 5), 1e308 * (i == 7)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None for r in got if r.vec_id == 7)


@pytest.mark.parametrize("spectrum", [[9, 4, 2, 1], [5, 5, 5, 1, 0.5], [3, 3 - 1e-9, 2, 2 - 1e-7, 0, 0], list(range(1, 40)), [1e6, 1, 1, 1e-3]])
def test_slicing_finds_every_leading_eigenvalue(spectrum):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))[0]
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 16)
    want = np.sort(spectrum)[::-1]
    want = want[want > 1e-10 * want[0]][:16]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-8 * want[0]
    shifts = rng.uniform(-1, want[0] * 1.1, 50)
    assert [whitening.count_above(v, s) for s in shifts] == [int((np.linalg.eigvalsh(v) > s).sum()) for s in shifts]
