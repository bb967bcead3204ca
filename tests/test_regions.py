"""Distances over cells, leakage and sea level against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays
from orbloom.operators import regions as B


def km(a, b):
    a, b = np.radians(a), np.radians(b)
    h = np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2
    return 2 * B.EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


@pytest.mark.parametrize("within", [0.0, 60.0, 700.0, 4000.0, 25000.0])
def test_near_places_over_poles_and_date_line(spark, within):
    rng = np.random.default_rng(int(within))
    a = np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, 400))), rng.uniform(-180, 360, 400)])
    b = np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), rng.uniform(0, 360, 60)])
    a[:6] = [[90, 10], [-90, 200], [89.9, 0], [0, 359.9], [0, 180.05], [-89.99, 77]]
    b[:5] = [[89.8, 180], [-89.9, 3], [0, 0.1], [0, -179.9], [a[300, 0], a[300, 1]]]
    places, others = (spark.createDataFrame([(k % 2, float(x), float(y)) for k, (x, y) in enumerate(v.tolist())], "part int, lat double, lon double") for v in (a, b))
    got = {(r.part, r.lat, r.lon) for r in B.near(places, others, within, ["part"]).collect()}
    d = km(a, b) if within else np.where((a[:, None] == b[None]).all(axis=2), 0.0, 1.0)
    want = {(i % 2, *a[i].tolist()) for i in range(len(a)) if (d[i, i % 2 :: 2] <= within).any()}
    assert got == want


def test_shrink_keeps_what_is_far_inside(spark):
    grid = [(k, float(lat), float(lon), float((abs(lat) >= 60) == (k == 0))) for k in range(2) for lat in range(-85, 90, 10) for lon in range(0, 360, 20)]
    df = spark.createDataFrame(grid, "k int, lat double, lon double, w double")
    got = {(r.k, r.lat) for r in B.shrink(df, 1500.0, ["k"]).collect()}
    assert got == {(0, x) for x in (-85.0, -75.0, 75.0, 85.0)} | {(1, float(x)) for x in range(-45, 50, 10)}


def test_sphere_equals_the_dense_basis():
    s = B.Sphere(9, 12, 24)
    n, m, cs = index_arrays(9, 0)
    lat, lon, w = special.quadrature(9, 12, 24)
    y = special.ylm(lat, lon, n, m, cs)
    x = np.random.default_rng(0).normal(size=len(n))
    field = y @ x
    got = s.analysis(field.reshape(12, 24))
    assert np.allclose(got[cs, n, m], x) and np.allclose(s.synthesis(got).ravel(), field)


def test_leakage_of_many_fields(spark):
    s = B.Sphere(20)
    w = special.gaussian_weights(20, 700.0)
    lat, lon = (np.degrees(x) for x in (s.lat, s.lon))
    rows, truth = [], {}
    for k, (y, x) in enumerate([(10, 90), (-40, 200)]):
        inside = (km(np.stack(np.meshgrid(lat, lon, indexing="ij"), -1).reshape(-1, 2), np.array([[y, x]]))[:, 0] < 2500).reshape(s.w.shape)
        for e in range(2):
            t = inside * (1.0 + e)
            seen = s.synthesis(w[None, :, None] * s.analysis(t))
            truth[k, e] = (t, seen, inside)
            rows += [(k, e, float(a), float(b), float(seen[i, j]), float(inside[i, j]), 0.05 if e else 0.0) for i, a in enumerate(lat) for j, b in enumerate(lon)]
    df = spark.createDataFrame(rows, "region int, epoch int, lat double, lon double, value double, inside double, noise double")
    out = B.leakage_correct(df, ["region", "epoch"], 20, w, most=150).toPandas()
    for (k, e), g in out.groupby(["region", "epoch"]):
        t, seen, inside = truth[k, e]
        got = g.sort_values(["lat", "lon"]).corrected.to_numpy().reshape(t.shape)
        assert g.ended.iloc[0] in (("discrepancy",) if e else ("step", "rounds"))
        assert (got[~inside] == 0).all()
        want, rounds, _, rms = B.leakage_iterate(seen, lambda x: s.synthesis(w[None, :, None] * s.analysis(x)), inside, noise=0.05 * e, most=150)
        assert np.allclose(got, want) and rounds == g.rounds.iloc[0] and rms == pytest.approx(g.residual.iloc[0])
        mean = [(s.w * f * inside).sum() / (s.w * inside).sum() for f in (t, seen, got)]
        assert abs(mean[2] - mean[0]) < 0.5 * abs(mean[1] - mean[0])
    with pytest.raises(Exception, match="places"):
        B.leakage_correct(df.where("lat > 0"), ["region", "epoch"], 20, w).count()
    with pytest.raises(ArithmeticError):
        B.leakage_iterate(truth[0, 0][1], lambda x: 5 * x, None)


def test_sea_level_closes_mass(spark):
    nmax = 12
    n = np.arange(nmax + 1)
    kn, hn = -0.3 * n / (n + 3), -0.9 * n / (n + 2) - 0.1
    s = B.Sphere(nmax, 26, 52)
    lat, lon = (np.degrees(x) for x in (s.lat, s.lon))
    rows = [(k, float(a), float(b), float(-10.0 * k * (a > 60)), float(a < 50)) for k in range(3) for a in lat for b in lon]
    df = spark.createDataFrame(rows, "set_id int, lat double, lon double, load double, ocean double")
    out = B.sea_level_fingerprints(df, ["set_id"], nmax, kn, hn, 26, 52).toPandas()
    one = None
    for k, g in out.groupby("set_id"):
        g = g.sort_values(["lat", "lon"])
        level = g.level.to_numpy().reshape(s.w.shape)
        load = g.load.to_numpy().reshape(s.w.shape)
        assert abs((s.w * (load + level)).sum()) < 1e-12 * max(1, np.abs(load).max())
        assert (level[lat >= 50] == 0).all()
        one = level if k == 1 else one
        if k == 2:
            assert np.allclose(level, 2 * one, rtol=1e-6)  # linear in the load
            north, south = level[(lat < 50) & (lat > 40)].mean(), level[lat < -60].mean()
            assert north < g.eustatic.iloc[0] < south  # water leaves where the ice was
    with pytest.raises(ValueError, match="ocean"):
        B.sea_level(np.ones(s.w.shape), np.zeros(s.w.shape), s, kn, hn)


def test_many_fields_at_once_end_as_they_do_alone():
    s = B.Sphere(5)
    rng = np.random.default_rng(4)
    fields, w = rng.standard_normal((7, s.n_lat, s.n_lon)), np.linspace(1, 0.3, 6)[:, None]
    fields[3] = 0
    inside = rng.random(fields.shape) < 0.6
    noise = np.array([0, 0.2, 0, 0, 0.05, 0, 0.5])
    smooth = lambda x: s.synthesis(w * s.analysis(x))
    got = B.leakage_iterate_many(fields, smooth, inside, noise, most=40, tol=1e-3)
    for k in range(len(fields)):
        out, rounds, ended, rms = B.leakage_iterate(fields[k], smooth, inside[k], noise=noise[k], most=40, tol=1e-3)
        assert np.allclose(got[0][k], out) and (got[1][k], got[2][k]) == (rounds, ended) and np.isclose(got[3][k], rms)
    assert len(set(got[1])) > 2


def test_groups_stay_whole_across_batches():
    import pyarrow as pa

    from orbloom.operators import batches

    key = [0] * 3 + [None] * 5 + [1] * 9 + [2]
    rows = pa.RecordBatch.from_pydict({"k": pa.array(key, pa.int64()), "v": list(range(len(key)))})
    seen = [t.column("k").to_pylist()[a:b] for t, at in batches.whole((rows.slice(i, 2) for i in range(0, len(key), 2)), ["k"], 4) for a, b in zip(at, [*at[1:], t.num_rows])]
    assert [(g[0], len(g)) for g in seen] == [(0, 3), (None, 5), (1, 9), (2, 1)]
