"""Operators by epoch, resolution, correlated draws, separated modes and error maps against dense computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays
from orbloom.operators import combination as C
from orbloom.operators import covariance as V
from orbloom.operators import month_filter as M
from orbloom.operators import sequential as S
from orbloom.operators import tiles as T

NMAX = 5
N, MM, CS = index_arrays(NMAX, 0)


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(len(N), len(N))) / 4 + np.eye(len(N))
    return rng.normal(size=(60, len(N))) @ mix.T / (1 + N)


@pytest.fixture(scope="module")
def resid(spark, sets):
    x = sets - sets.mean(axis=0)
    rows = [(k, 2000 + k / 12, 1.0 + k % 4, int(n), int(m), int(c), float(v)) for k, s in enumerate(x) for n, m, c, v in zip(N, MM, CS, s)]
    return spark.createDataFrame(rows, "set_id long, epoch double, factor double, n int, m int, cs int, residual double")


@pytest.fixture(scope="module")
def operator(resid):
    return M.operator_table(V.block_covariance(resid)).cache()


def dense(operator, factor):
    """W over all coefficients, built from the definition."""
    w = np.zeros((len(N), len(N)))
    for r in operator.collect():
        at = [int(np.flatnonzero((N == n) & (MM == r.m) & (CS == r.cs))[0]) for n in r.degrees]
        k = len(at)
        w[np.ix_(at, at)] = np.reshape(r.v, (k, k)) @ np.diag(np.array(r.lam) / (np.array(r.lam) + factor)) @ np.reshape(r.u, (k, k))
    return w


def test_operators_apply_forward_and_transposed(resid, operator, sets):
    x = sets - sets.mean(axis=0)
    df = resid.withColumnRenamed("residual", "v")
    one, two = (M.apply(operator, df, ["set_id"], "factor", transpose=t).toPandas() for t in (False, True))
    for k in (0, 1, 6, 59):
        w = dense(operator, 1.0 + k % 4)
        for got, want in ((one, w @ x[k]), (two, w.T @ x[k])):
            g = {(r.n, r.m, r.cs): r.v for r in got[got.set_id == k].itertuples()}
            assert np.allclose([g[int(n), int(m), int(c)] for n, m, c in zip(N, MM, CS)], want)
    # <A x, y> = <x, A' y> for x of one set and y of another at one factor.
    w = dense(operator, 1.0)
    a, b = ({(r.n, r.m, r.cs): r.v for r in g[g.set_id == k].itertuples()} for g, k in ((one, 0), (two, 4)))
    ax, aty = (np.array([g[int(n), int(m), int(c)] for n, m, c in zip(N, MM, CS)]) for g in (a, b))
    assert ax @ x[4] == pytest.approx(x[0] @ aty)


def test_signal_and_noise_of_a_block_add_up():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4, 400))
    a[:2] *= 5
    total = np.cov(a)
    lam, v, u = M.block_operator(total, 0.0, 3)
    noise, signal = v @ v.T, v @ np.diag(lam) @ v.T
    assert np.allclose(u @ v, np.eye(4)) and np.allclose(signal, np.diag(np.diag(signal)), atol=1e-9 * np.abs(signal).max())
    assert np.allclose(noise + signal, total, atol=1e-6 * np.trace(total))


def test_filtered_sets_are_those_of_the_wiener_filter(resid, operator):
    factors = resid.select("epoch", "factor").distinct()
    a = V.wiener_blocks(resid, factors).toPandas().sort_values(["epoch", "n", "m", "cs"])
    b = M.apply(operator, resid.withColumnRenamed("residual", "v"), ["epoch"], "factor").toPandas().sort_values(["epoch", "n", "m", "cs"])
    assert np.allclose(a.filtered, b.v) and np.allclose(a.sigma, b.sigma) and (a.sigma > 0).all()


def test_sets_that_do_not_fit_the_operator_are_refused(resid, operator):
    with pytest.raises(Exception, match="degrees"):
        M.apply(operator, resid.withColumnRenamed("residual", "v").where("n <> 4"), ["set_id"]).count()


def test_resolution_equals_a_dense_kernel(spark, operator):
    points = [(k, float(lat), float(lon), 1.0 + k) for k, (lat, lon) in enumerate([(0, 0), (55, 120), (-80, 350), (90, 0)])]
    out = {r.id: r for r in M.resolution_map(operator, spark.createDataFrame(points, "id int, lat double, lon double, f double"), "f", reach=90.0, samples=400).collect()}
    psi = np.linspace(0, 90, 400)
    for k, lat, lon, f in points:
        y = special.ylm(np.radians([lat]), np.radians([lon]), N, MM, CS)[0]
        kernel = dense(operator, f).T @ y
        for j, az in enumerate(np.radians(np.arange(8) * 45)):
            la, d = np.radians(lat), np.radians(psi)
            # The place at azimuth az and distance psi, by rotating vectors.
            up = np.array([np.cos(la) * np.cos(np.radians(lon)), np.cos(la) * np.sin(np.radians(lon)), np.sin(la)])
            north = np.array([-np.sin(la) * np.cos(np.radians(lon)), -np.sin(la) * np.sin(np.radians(lon)), np.cos(la)])
            east = np.array([-np.sin(np.radians(lon)), np.cos(np.radians(lon)), 0])
            p = np.cos(d)[:, None] * up + np.sin(d)[:, None] * (np.cos(az) * north + np.sin(az) * east)
            v = special.ylm(np.arcsin(np.clip(p[:, 2], -1, 1)), np.arctan2(p[:, 1], p[:, 0]), N, MM, CS) @ kernel
            below = np.flatnonzero(v[1:] <= v[0] / 2)
            want = None if not len(below) else psi[below[0]] + (v[below[0]] - v[0] / 2) / (v[below[0]] - v[below[0] + 1]) * (psi[1] - psi[0])
            got = out[k].half_deg[j]
            assert (got is None and want is None) or got == pytest.approx(want, abs=1e-6)
        km = [np.radians(h) * 6371 for h in out[k].half_deg if h is not None]
        assert out[k].km_mean == pytest.approx(np.mean(km)) and out[k].anisotropy == pytest.approx(max(km) / min(km))


def test_error_map_is_the_diagonal(spark, sets):
    c = np.cov(sets.T)
    entries = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(c)], "row int, col int, value double")
    lat, lon = [-80.0, 0.0, 33.0], [0.0, 100.0, 250.0, 359.0]
    got = {(r.lat, r.lon): r.sigma for r in T.error_map(T.from_entries(entries, len(N), 10), NMAX, lat, lon, np.arange(NMAX + 1.0), size=10, points=5).collect()}
    for a in lat:
        for b in lon:
            y = special.ylm(np.radians([a]), np.radians([b]), N, MM, CS)[0] * N
            assert got[a, b] == pytest.approx(np.sqrt(y @ c @ y))


def test_correlated_draws_have_the_given_covariance(spark, resid):
    cov = V.block_covariance(resid).groupBy("m", "cs", "n1", "n2").agg(F.first("cov").alias("cov"))
    one = resid.where("set_id = 0").select("set_id", "n", "m", "cs", F.lit(0.0).alias("v"), F.lit(9.0).alias("s"))
    kept = []

    def look(d):
        kept.append(d)
        return d.withColumn("value", F.col("v")).select("set_id", "sample", "n", "m", "cs", "value")

    sums = C.monte_carlo(one, look, ["set_id", "n", "m", "cs"], 4000, covariance=cov).toPandas()
    want = {(r.m, r.cs, r.n1, r.n2): r.cov for r in cov.collect()}
    for r in sums.itertuples():
        assert r.sigma**2 == pytest.approx(want[r.m, r.cs, r.n, r.n], rel=0.12)
    d = kept[0].where("m = 1 AND cs = 0").select("sample", "n", "v").toPandas().pivot(index="sample", columns="n", values="v")
    got = np.cov(d.to_numpy().T)
    for i, a in enumerate(d.columns):
        for j, b in enumerate(d.columns):
            c = want.get((1, 0, min(a, b), max(a, b)), 0.0)
            assert abs(got[i, j] - c) < 5 * np.sqrt((want[1, 0, a, a] * want[1, 0, b, b] + c * c) / 4000)
    assert C.monte_carlo(one, look, ["set_id", "n", "m", "cs"], 4000, covariance=cov).toPandas().sort_values(["n", "m", "cs"]).sigma.tolist() == sums.sort_values(["n", "m", "cs"]).sigma.tolist()
    with pytest.raises(Exception, match="positive definite"):
        C.block_factors(cov.withColumn("cov", -F.col("cov"))).count()


def test_planted_modes_are_separated(spark):
    rng = np.random.default_rng(8)
    t, p = 120, 30
    pattern = rng.normal(size=(2, p))
    signal = np.outer(5 * np.sin(np.arange(t) / 3), pattern[0]) + np.outer(2 * np.cos(np.arange(t) / 7), pattern[1])
    x = signal + 0.3 * rng.normal(size=(t, p)) + 4
    w = 1.0 + np.arange(p) / p
    df = spark.createDataFrame([(k, j, float(v), float(w[j])) for (k, j), v in np.ndenumerate(x)], "t int, place int, v double, w double")
    out, modes, rms = C.separate(df, "t", ["place"], "v", "w")
    got = out.toPandas().pivot(index="t", columns="place", values=["separated", "noise"])
    sep, noise = got["separated"].to_numpy(), got["noise"].to_numpy()
    centred = x - x.mean(axis=0)
    assert modes == 2 and np.allclose(sep + noise, centred)
    u, s, v = np.linalg.svd(centred * np.sqrt(w), full_matrices=False)
    assert np.allclose(sep, (u[:, :2] * s[:2]) @ v[:2] / np.sqrt(w), atol=1e-8)
    assert rms == pytest.approx(np.sqrt((w * noise**2).sum() / (w.sum() * t))) and rms == pytest.approx(0.3, rel=0.1)
    assert C.separate(df, "t", ["place"], "v", "w", keep=1)[1] == 1


def test_loading_goes_on_the_diagonal_at_lag_zero():
    x = np.array([[1.0, 0.5, -1.0, 0.0, 1.0, 0.5, -0.5], [0.0, 1.0, 0.5, -1.0, 1.0, -0.5, 0.5]])
    c = x - x.mean(axis=1, keepdims=True)
    c0, c1 = c @ c.T / 7, c[:, 1:] @ c[:, :-1].T / 6
    loaded = c0 + 0.3 * np.trace(c0) / 2 * np.eye(2)
    phi, q, s0 = S.fit_var(x, 1, 0.3)
    assert np.allclose(phi[0], c1 @ np.linalg.inv(loaded)) and np.allclose(s0, loaded)
    with pytest.raises(ValueError):
        S.fit_var(x, 1, structure="blocks", blocks=[np.array([0])])
    with pytest.warns(UserWarning, match="stationary"):
        S.fit_var(np.tile([1.0, -1.0], 4)[None, :], 1)
