"""Signal models against dense rounds; a planted two-zone variance."""

import numpy as np
import pytest

from orbloom.functions import special
from orbloom.functions.index import index_arrays
from orbloom.operators import filters
from orbloom.operators import signal_model as M
from orbloom.operators import tiles as T

NMAX = 6
N, MM, CS = index_arrays(NMAX, 0)


def frame(spark, x):
    return spark.createDataFrame([(2000 + k / 12, int(n), int(m), int(c), float(v)) for k, s in enumerate(x) for n, m, c, v in zip(N, MM, CS, s)], "epoch double, n int, m int, cs int, residual double")


def noise_rows(spark, cov):
    rows = [(int(MM[i]), int(CS[i]), int(N[i]), int(N[j]), float(cov[i, j])) for i in range(len(N)) for j in range(len(N)) if MM[i] == MM[j] and CS[i] == CS[j] and (N[i] - N[j]) % 2 == 0 and N[i] <= N[j]]
    return spark.createDataFrame(rows, "m int, cs int, n1 int, n2 int, cov double")


def test_rounds_equal_the_dense_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, len(N))) * (1 + 3 / (1 + N))
    same = (MM[:, None] == MM) & (CS[:, None] == CS) & ((N[:, None] - N) % 2 == 0)
    a = rng.normal(size=(len(N), len(N))) * same
    cov = (a @ a.T) * same / len(N) * 3 + np.eye(len(N)) * 0.5
    got, w = M.iterate(frame(spark, x), noise_rows(spark, cov), 3)

    def variances(y):
        s = np.bincount(N, (y**2).mean(axis=0)) / (2 * np.arange(NMAX + 1) + 1)
        return np.maximum(s, 1e-8 * s.max())

    v = variances(x)
    for _ in range(3):
        dense = np.diag(v[N]) @ np.linalg.inv(np.diag(v[N]) + cov)
        y = x @ dense.T
        v = variances(y)
    assert np.allclose([got[n] for n in range(NMAX + 1)], v)
    back = filters.block_filter(frame(spark, x[:2]).withColumnsRenamed({"residual": "v"}).selectExpr("*", "1.0 AS s"), w, ["epoch"]).toPandas()
    g = {(r.epoch, r.n, r.m, r.cs): r.v for r in back.itertuples()}
    assert np.allclose([g[2000.0, int(n), int(m), int(c)] for n, m, c in zip(N, MM, CS)], y[0])


def test_a_constant_map_gives_the_isotropic_case(spark):
    lat, lon, w = special.quadrature(NMAX)
    flat = spark.createDataFrame([(float(np.degrees(a)), float(np.degrees(b)), 1.0) for a, b in zip(lat, lon)], "lat double, lon double, d double")
    v = {n: 1.0 / (1 + n) for n in range(NMAX + 1)}
    got = np.zeros((len(N), len(N)))
    for r in T.entries(T.mirrored(M.modulated(v, flat, NMAX, size=20)), 20).collect():
        got[r.row, r.col] = r.value
    assert np.allclose(got, np.diag([v[int(n)] for n in N]))


def test_two_zones_are_found(spark):
    rng = np.random.default_rng(3)
    lat, lon, w = special.quadrature(NMAX)
    y = special.ylm(lat, lon, N, MM, CS)
    strong = np.where(np.degrees(lat) > 15, 3.0, 0.5)
    fields = rng.normal(size=(400, len(lat))) * strong
    x = (fields * w) @ y
    noise = np.eye(len(N)) * 1e-4
    v, f = M.iterate(frame(spark, x), noise_rows(spark, noise), 3)
    filtered = filters.block_filter(frame(spark, x).withColumnsRenamed({"residual": "v"}).selectExpr("*", "1.0 AS s"), f, ["epoch"])
    vmap = M.variance_map(filtered, NMAX).toPandas().sort_values(["lat", "lon"])
    d = vmap.d.to_numpy()
    assert (w * d).sum() == pytest.approx(1.0)
    north, south = np.degrees(lat) > 35, np.degrees(lat) < -5
    assert d[north].mean() / d[south].mean() > 8
    s = np.zeros((len(N), len(N)))
    for r in T.entries(T.mirrored(M.modulated(v, spark.createDataFrame(vmap), NMAX, size=30)), 30).collect():
        s[r.row, r.col] = r.value
    g = y.T @ ((w * np.sqrt(d))[:, None] * y)
    assert np.allclose(s, g @ np.diag([v[int(n)] for n in N]) @ g.T)
    assert np.linalg.eigvalsh(s).min() > -1e-9 * np.linalg.eigvalsh(s).max()
    point = np.einsum("ip,pq,iq->i", y, s, y)  # variance of the model's fields
    assert point[north].mean() / point[south].mean() > 4


def test_power_law_by_month(spark):
    rows = []
    for k in range(36):
        if k % 12 == 5:
            continue
        a, b = (2.0, -1.5) if k % 12 == 0 else (1.0, -1.0)
        for n in range(1, 9):
            rows.append((2005 + k / 12 + 0.01, n, float((a * n**b * np.exp(special.log_chi2_bias(2.0 * n + 1))) ** 2)))
    got = {r.month: r for r in M.monthly_power_law(spark.createDataFrame(rows, "epoch double, n int, variance double")).collect()}
    assert got[1].a == pytest.approx(2.0) and got[1].b == pytest.approx(-1.5) and got[1].epochs == 3
    assert all(got[k].a == pytest.approx(1.0) and got[k].b == pytest.approx(-1.0) for k in range(2, 13))
    assert got[6].epochs == 0
