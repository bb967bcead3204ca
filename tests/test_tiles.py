"""Tiled matrices against dense numpy, and the covariance conditioner."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.operators import kalman as K
from orbloom.operators import tiles as T
from orbloom.sources import files as S


def entries(spark, a, lower=False):
    rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a) if v and (not lower or i >= j)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def dense(df, shape, size):
    out = np.zeros(shape)
    for r in T.entries(df, size).collect():
        out[r.row, r.col] = r.value
    return out


def spd(n, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n))
    return a @ a.T + n * np.eye(n)


def test_tiles_keep_entries_and_multiply(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(23, 23)), rng.normal(size=(23, 23))
    a[:8, 8:16] = 0  # a tile that is not there
    ta, tb = (T.from_entries(entries(spark, x), 23, 8) for x in (a, b))
    assert ta.count() == 8 and np.array_equal(dense(ta, a.shape, 8), a)
    assert np.array_equal(dense(T.transposed(ta), a.shape, 8), a.T)
    assert np.allclose(dense(T.multiply(ta, tb, 3, 3), a.shape, 8), a @ b)


def test_inverse_of_500_in_tiles_of_64(spark):
    a = spd(500)
    a[100:140, 300:] = a[300:, 100:140] = 0
    a += np.eye(500) * 500
    got = T.mirrored(T.inverse(T.from_entries(entries(spark, a, lower=True), 500, 64), 500, 64))
    assert np.allclose(dense(got, a.shape, 64), np.linalg.inv(a), atol=1e-12)
    assert got.agg(F.max(F.size("x"))).first()[0] == 64 * 64  # no larger piece of the matrix in any row


def test_cholesky_factor_and_refusal(spark):
    a = spd(20)
    got = dense(T.cholesky(T.from_entries(entries(spark, a), 20, 7), 20, 7), a.shape, 7)
    assert np.allclose(got, np.linalg.cholesky(a))
    a[15, 15] = -1
    with pytest.raises(Exception, match="positive definite"):
        T.cholesky(T.from_entries(entries(spark, a), 20, 7), 20, 7).count()


def test_sinex_normals_become_a_covariance_in_another_order(spark, tmp_path):
    (tmp_path / "a.snx").write_text(
        "%=SNX 2.02\n+SOLUTION/ESTIMATE\n  1 SN 2 1 X A 1  1.40e-06 1.0e-11\n  2 CN 2 0 X A 1 -4.84e-04 1.0e-11\n  3 CN 2 1 X A 1  2.03e-06 1.0e-11\n-SOLUTION/ESTIMATE\n"
        "+SOLUTION/NORMAL_EQUATION_MATRIX U\n 1 1  2.0e21  1.0e19  0.0\n 2 2  4.0e21  2.0e19\n 3 3  1.0e21\n-SOLUTION/NORMAL_EQUATION_MATRIX U\n%ENDSNX\n"
    )
    nq = np.array([[2.0e21, 1.0e19, 0.0], [1.0e19, 4.0e21, 2.0e19], [0.0, 2.0e19, 1.0e21]])
    perm = [1, 2, 0]
    order = [(2, 0, 0), (2, 1, 0), (2, 1, 1)]
    est, cov = S.sinex_covariance(spark, str(tmp_path / "a.snx"), order, size=2)
    assert [r.value for r in est.orderBy("i").collect()] == [-4.84e-04, 2.03e-06, 1.40e-06]
    got = np.zeros((3, 3))
    for r in cov.collect():
        got[r.row, r.col] = r.value
    assert np.allclose(got, np.linalg.inv(nq)[np.ix_(perm, perm)], rtol=1e-10, atol=0)
    with pytest.raises(ValueError, match="not in the file"):
        S.sinex_covariance(spark, str(tmp_path / "a.snx"), [*order, (3, 0, 0)])


KN = [-0.3] * 9


def covariance(p, samples, seed):
    a = np.random.default_rng(seed).normal(size=(p, samples))
    return a @ a.T / samples


def test_conditioner_without_taper_is_the_identity(spark):
    c = covariance(81, 162, 13)
    f = T.Conditioner(8, KN)
    assert np.allclose(f(c), c, atol=1e-10 * np.abs(c).max())


@pytest.mark.parametrize("bands", [1, 3])
def test_conditioner_in_tiles_keeps_the_covariance_positive(spark, bands):
    c = covariance(49, 98, 17)
    f = T.Conditioner(6, KN, 2000.0, lambda lat, lon: lat >= 0, bands=bands)
    every = np.arange(len(f.lat))
    w = f.weight(every, every)
    north, south = np.flatnonzero(f.region == 1)[0], np.flatnonzero(f.region == 0)[0]
    assert w[north, south] == 0 and w[north, north] == 1
    g, back = f.forward(every), f.back(every)
    want = back @ (w * (g @ c @ g.T)) @ back.T
    got = dense(T.mirrored(T.condition(T.from_entries(entries(spark, c), 49, 20), f, 20)), c.shape, 20)
    assert np.allclose(f(c), want) and np.allclose(got, want) and np.array_equal(got, got.T)
    assert np.linalg.eigvalsh(got).min() > -1e-8 * np.linalg.eigvalsh(got).max()


def test_conditioner_makes_a_singular_covariance_definite_and_enters_the_autoregression(spark):
    f = T.Conditioner(6, KN, 1500.0)
    x = np.random.default_rng(19).normal(size=(25, 49))
    sigma = x.T @ x / 25
    raw, got = np.linalg.eigvalsh(sigma), np.linalg.eigvalsh(f(sigma))
    assert raw.min() < 1e-10 * raw.max() and got.min() > 1e-10 * got.max()
    series = spark.createDataFrame([("a", t, v.tolist()) for t, v in enumerate(x)], "key string, t bigint, x array<double>")
    r = K.fit_var(series, ["key"], "x", condition=f).first()
    assert np.isfinite(r.phi).all() and np.isfinite(r.q).all() and np.allclose(r.sigma0, f(sigma).ravel())
    with pytest.raises(ValueError):
        T.Conditioner(6, KN, regions=lambda lat, lon: [1.0])
