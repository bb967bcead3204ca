import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays, literal_table
from orbloom.operators import coefficients as C
from orbloom.operators import combination as M
from orbloom.operators import nearest as N
from orbloom.operators import regions as B
from orbloom.operators import regression as R
from orbloom.operators import sequential as K
from orbloom.operators import statistics as A
from orbloom.operators import transforms as T
from orbloom.operators import windows as O


def fields(spark, nmax=4, sets=3, seed=1):
    rng = np.random.default_rng(seed)
    n, m, cs = index_arrays(nmax, 0)
    rows = [(k, 2010 + k / 12, int(a), int(b), int(c), float(v), 0.1) for k in range(sets) for a, b, c, v in zip(n, m, cs, rng.standard_normal(len(n)))]
    return spark.createDataFrame(rows, "set_id long, epoch double, n int, m int, cs int, v double, s double")


def test_pack_and_unpack_round_trip(spark):
    x = fields(spark)
    back = C.unpack(C.pack(x, ["set_id"], 4), "x", 4)
    assert back.join(x.withColumnRenamed("v", "w"), ["set_id", "n", "m", "cs"]).where("abs(v - w) > 1e-12").count() == 0


def test_nan_becomes_null_and_incomplete_sets_go(spark):
    x = spark.createDataFrame([(1, [1.0, float("nan"), 0.0, 0.0]), (2, [1.0, 2.0, 3.0, 4.0])], "set_id long, x array<double>")
    y = C.drop_incomplete(C.unpack(x, "x", 1), ["set_id"])
    assert {r.set_id for r in y.collect()} == {2}
    with pytest.raises(ValueError):
        C.assert_clean(C.unpack(x, "x", 1), "test")


def test_nearest_agrees_with_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b, tol = rng.uniform(0, 30, 200), np.round(rng.uniform(0, 30, 150), 2), 0.2
    left = spark.createDataFrame(pd.DataFrame({"row_key": range(200), "epoch": a}))
    got = {r.row_key: r.r_epoch for r in N.nearest(left, spark.createDataFrame(pd.DataFrame({"epoch": b})), tol).collect()}
    want = {k: min(b, key=lambda u: (abs(u - t), u)) for k, t in enumerate(a) if np.abs(b - t).min() <= tol}
    assert got == pytest.approx(want)


def test_harmonic_fit_recovers_truth_in_both_forms(spark):
    t = 2010 + np.arange(96) / 12
    x = t - 2012
    y = 3 + 0.1 * x + 2 * np.cos(2 * np.pi * x) - np.sin(4 * np.pi * x)
    s = spark.createDataFrame(pd.DataFrame({"key": 1, "epoch": t, "v": y}))
    c = {r.term: r.coef for r in R.fit(s, ["key"], 2012.0).collect()}
    assert [c[k] for k in R.STANDARD] == pytest.approx([3, 0.1, 2, 0, 0, -1], abs=1e-8)
    assert R.harmonic_residuals(s, ["key"], 2012.0).agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    y[10] += 100
    robust = {r.term: r.coef for r in R.robust_fit(spark.createDataFrame(pd.DataFrame({"key": 1, "epoch": t, "v": y})), ["key"], 2012.0).collect()}
    assert robust["trend"] == pytest.approx(0.1, abs=1e-3)


def test_alias_and_breaks(spark):
    t = 2010 + np.arange(140) / 12
    x, p = t - 2014, 161 / 365.25
    tide = 0.7 * np.cos(2 * np.pi * x / p + np.where(t >= 2018, np.deg2rad(100), 0))
    s = spark.createDataFrame(pd.DataFrame({"key": 1, "epoch": t, "v": 1 + tide}))
    out = R.remove_alias(s, ["key"], 2014.0).toPandas()["v"]
    assert np.abs(out - 1).max() < 1e-8
    kink = spark.createDataFrame(pd.DataFrame({"key": 1, "epoch": t, "v": np.maximum(t - 2015, 0) + 0.01 * np.sin(37 * t)}))
    assert R.trend_breaks(kink, ["key"], 2014.0, (2015.0,)).first().p_value < 1e-6


def test_synthesis_and_analysis_are_inverse(spark):
    nmax = 4
    x, w = special.gauss_legendre(nmax + 1)
    lat, lon = [float(v) for v in np.degrees(np.arcsin(x))], [float(v) for v in np.arange(2 * nmax + 2) * 360 / (2 * nmax + 2)]
    c = fields(spark, nmax, 2)
    g = T.synthesis(c, ["set_id"], nmax, lat, lon)
    for back in (T.analysis_quadrature(g, ["set_id"], nmax, lat, lon, w / 2 / len(lon)), T.analysis(g, ["set_id"], nmax)):
        assert back.join(c.withColumnRenamed("v", "u"), ["set_id", "n", "m", "cs"]).agg(F.max(F.abs(F.col("v") - F.col("u")))).first()[0] < 1e-9


def test_gradient_trace_is_zero_and_slepian_is_orthonormal(spark):
    g = T.gradient_tensor(C.pack(fields(spark), ["set_id"], 4), 4, [-40.0, 10.0, 55.0], [0.0, 100.0]).toPandas()
    for nn, ee, uu in zip(g.nn, g.ee, g.uu):
        assert np.abs(np.array(nn) + ee + uu).max() < 1e-9 * np.abs(uu).max()
    basis, lam, shannon = B.slepian(lambda a, b: (a > 0).astype(float), 5)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1])) and shannon == pytest.approx(18, rel=0.05) and lam[0] <= 1


def test_percentile_is_hazen(spark):
    x = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, x double")
    got = [A.hazen_percentile(x, ["k"], "x", p).first().percentile for p in (10, 50, 90)]
    assert got == pytest.approx([1.0, 2.5, 4.0])


def test_drought_classes_and_deficit(spark):
    z = spark.createDataFrame([(v,) for v in (-2.5, -2.0, -0.5, 0.0, 0.5, 2.0, None)], "z double")
    assert [r[0] for r in z.select(O.category(F.col("z"))).collect()] == [-5, -4, 0, 0, 1, 5, None]
    s = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 3.0), (1, 3.0, 6.0), (1, 4.0, 1.0)], "key int, epoch double, v double")
    assert [r.deficit for r in O.storage_deficit(s, ["key"]).orderBy("epoch").collect()] == [None, 0.0, 2.0, 0.0]


def test_kalman_solution_and_normal_equations_agree_and_smoother_is_batch_least_squares():
    rng = np.random.default_rng(3)
    phi, q, s0, r = np.array([[[0.9, 0.1], [0.0, 0.7]]]), np.diag([0.3, 0.2]), np.eye(2), np.diag([0.5, 0.4])
    y = rng.standard_normal((12, 2))
    obs = [None if k == 4 else (v, r) for k, v in enumerate(y)]
    neq = [None if k == 4 else ("normal", np.linalg.inv(r), np.linalg.inv(r) @ v) for k, v in enumerate(y)]
    a, b = K.kalman(phi, q, s0, obs), K.kalman(phi, q, s0, neq)
    assert np.allclose(a.x, b.x) and np.allclose(a.p, b.p)
    xs, _ = K.smooth(a, phi)
    t = len(y)
    h = np.zeros((2 * t, 2 * t))
    rhs = np.zeros(2 * t)
    h[:2, :2] += np.linalg.inv(s0)
    for k in range(1, t):
        d = np.zeros((2, 2 * t))
        d[:, 2 * k : 2 * k + 2], d[:, 2 * k - 2 : 2 * k] = np.eye(2), -phi[0]
        h += d.T @ np.linalg.inv(q) @ d
    for k in range(t):
        if k != 4:
            h[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] += np.linalg.inv(r)
            rhs[2 * k : 2 * k + 2] += np.linalg.inv(r) @ y[k]
    assert np.allclose(np.linalg.solve(h, rhs), np.concatenate(xs))
    assert np.allclose(K.smooth(a, phi, lag=t)[0], xs)


def test_normals_combine_like_stacked_least_squares():
    rng = np.random.default_rng(4)
    a = [rng.standard_normal((200, 3)) for _ in range(2)]
    y = [m @ [1, 2, 3] + s * rng.standard_normal(200) for m, s in zip(a, (0.1, 1.0))]
    x, f = M.combine_normals([(m.T @ m, m.T @ v, v @ v, 200) for m, v in zip(a, y)])
    assert x == pytest.approx([1, 2, 3], abs=0.05) and f[1] / f[0] > 50


def test_leakage_iteration_improves(spark):
    mask = np.zeros(50, bool)
    mask[20:30] = True
    k = np.exp(-0.5 * ((np.arange(50)[:, None] - np.arange(50)) / 3) ** 2)
    k /= k.sum(axis=1, keepdims=True)
    truth = mask.astype(float)
    got, _, ended, _ = B.leakage_iterate(k @ truth, lambda x: k @ x, mask)
    assert ended == "step"
    assert np.abs(got - truth).max() < np.abs(np.where(mask, k @ truth, 0) - truth).max() / 4


def test_polygon_and_mask_table(spark):
    grid = literal_table(spark, ["lat", "lon"], [(0.0, 0.0), (10.0, 10.0), (50.0, 50.0)])
    w = B.polygon_mask(grid, [[(-5.0, -5.0), (20.0, -5.0), (20.0, 20.0), (-5.0, 20.0)]]).orderBy("lat").collect()
    assert [r.w for r in w] == [1.0, 1.0, 0.0]


def test_separated_modes_finds_the_planted_signals():
    rng = np.random.default_rng(7)
    noise = rng.standard_normal((40, 200))
    signal = sum(a * np.outer(rng.standard_normal(40), np.sin(f * np.arange(200))) for a, f in ((3.0, 0.1), (1.5, 0.37)))
    lam = np.linalg.svd(noise + signal, compute_uv=False) ** 2 / 200
    assert M.separated_modes(lam, 40, 200) == 2
    assert M.separated_modes(np.linalg.svd(noise, compute_uv=False) ** 2 / 200, 40, 200) == 0
    assert 0.7 < M.noise_median(0.2) < 1.0


def test_rings_equal_the_relational_synthesis(spark, sf_dir):
    from orbloom.operators import coefficients as CO
    from orbloom.plans.base import NMAX, coef

    lat, lon = [-50.0, 0.0, 33.0], [0.0, 45.0, 200.0, 310.0]
    factors = np.arange(NMAX + 1) + 1.0
    x = coef(spark, sf_dir).where("set_id < 5")
    want = {(r.set_id, r.lat, r.lon): r.value for r in T.synthesis(x, ["set_id"], NMAX, lat, lon, factors).collect()}
    rows = T.synthesis_rings(CO.pack(x, ["set_id"], NMAX), ["set_id"], NMAX, lat, lon, factors).collect()
    assert len(rows) == 15
    for r in rows:
        assert np.allclose(r.field, [want[r.set_id, r.lat, b] for b in lon])
