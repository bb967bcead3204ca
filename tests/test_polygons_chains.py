"""Polygons with parts and holes, interval terms, and the ice chain with planted mass."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays
from orbloom.operators import nearest, pipelines
from orbloom.operators import regions as B
from orbloom.sources import files as S

RING = "region string, part int, ring array<struct<lat: double, lon: double>>"


def even_odd(lat, lon, rings):
    """Count of crossed edges, ring by ring, with longitudes around each ring's mean direction."""
    total = np.zeros(len(lat), int)
    for ring in rings:
        r = np.array(ring, float)
        c = np.degrees(np.arctan2(np.sin(np.radians(r[:, 1])).sum(), np.cos(np.radians(r[:, 1])).sum()))
        x, px = (r[:, 1] - c + 180) % 360 - 180, (lon - c + 180) % 360 - 180
        for k in range(len(r)):
            y1, y2, x1, x2 = r[k, 0], r[k - 1, 0], x[k], x[k - 1]
            if y1 != y2:
                total += ((y1 > lat) != (y2 > lat)) & (px < x1 + (lat - y1) / (y2 - y1) * (x2 - x1))
    return total % 2 == 1


@pytest.mark.parametrize("seed", range(3))
def test_random_polygons_by_even_odd(spark, seed):
    rng = np.random.default_rng(seed)
    polygons = {}
    for name in "abc":
        parts = []
        for _ in range(3):  # overlapping parts and holes alike
            a = np.sort(rng.uniform(0, 2 * np.pi, 9))
            radius = rng.uniform(5, 25, 9)
            parts.append(np.column_stack([rng.uniform(-50, 50) + radius * np.sin(a), rng.uniform(-180, 360) + radius * np.cos(a)]).tolist())
        polygons[name] = parts
    places = np.column_stack([rng.uniform(-80, 80, 3000), rng.uniform(-180, 360, 3000)])
    rings = spark.createDataFrame([(n, k, [tuple(p) for p in r]) for n, parts in polygons.items() for k, r in enumerate(parts)], RING)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in places], "lat double, lon double")
    got = {(r.lat, r.lon, r.region) for r in B.inside(df, rings, ["region"]).collect()}
    want = {(*places[i].tolist(), n) for n, parts in polygons.items() for i in np.flatnonzero(even_odd(places[:, 0], places[:, 1], parts))}
    assert got == want and len(want) > 50
    with pytest.raises(ValueError, match="lat"):
        B.inside(df, spark.createDataFrame([("x", 0, [(120.0, 10.0), (121.0, 10.0), (120.0, 11.0)])], RING), ["region"])


def test_geojson_parts_and_holes(spark, tmp_path):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = [
        {"properties": {"name": "one"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 10), square(4, 4, 2)]}},
        {"properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(20, 0, 5)], [square(40, 0, 5), square(41, 1, 1)]]}},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rings = S.read_polygons(spark, str(tmp_path / "b.json"))
    assert sorted((r.name, r.part, r.hole, len(r.ring)) for r in rings.collect()) == [("one", 0, False, 4), ("one", 0, True, 4), ("two", 0, False, 4), ("two", 1, False, 4), ("two", 1, True, 4)]
    places = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (2.0, 22.0), (1.5, 41.5), (4.0, 44.0), (8.0, 44.0)], "lat double, lon double")
    got = {(r.lat, r.lon, r.name) for r in B.inside(places, rings, ["name"]).collect()}
    assert got == {(1.0, 1.0, "one"), (2.0, 22.0, "two"), (4.0, 44.0, "two")}


def test_a_mask_grows_by_its_buffer(spark):
    grid = [(float(a), float(b), float(abs(a) < 15 and b < 15)) for a in range(-85, 90, 10) for b in range(0, 360, 10)]
    got = {(r.lat, r.lon) for r in B.grow(spark.createDataFrame(grid, "lat double, lon double, w double"), 1200.0).collect()}
    a = np.array(grid)
    x, y = np.radians(a[:, None, :2]), np.radians(a[None, a[:, 2] > 0.5, :2])
    h = np.sin((x[..., 0] - y[..., 0]) / 2) ** 2 + np.cos(x[..., 0]) * np.cos(y[..., 0]) * np.sin((x[..., 1] - y[..., 1]) / 2) ** 2
    assert got == {tuple(r[:2].tolist()) for r, d in zip(a, 2 * B.EARTH_KM * np.arcsin(np.sqrt(h))) if d.min() <= 1200}


def test_open_ended_terms(spark):
    epochs = spark.createDataFrame([(2000 + k / 7,) for k in range(140)], "epoch double")
    terms = [("a", "const", 1.0, -1e9, 2005.0, None), ("a", "const", 2.0, 2005.0, 1e9, None), ("a", "trnd", 0.5, 2010.0, 1e9, None), ("b", "acos", 3.0, 2001.0, 2001.2, 1.0), ("c", "const", 1.0, 1900.0, 1901.0, None)]
    got = {(r.key, round(r.epoch, 6)): r.value for r in nearest.evaluate_terms(epochs, spark.createDataFrame(terms, "key string, kind string, value double, t0 double, t1 double, period double")).collect()}
    for k in range(140):
        t = 2000 + k / 7
        assert got["a", round(t, 6)] == pytest.approx((1 if t < 2005 else 2) + (0.5 * (t - 2010) if t >= 2010 else 0))
        assert (("b", round(t, 6)) in got) == (2001 <= t < 2001.2)
    assert not [k for k in got if k[0] == "c"]


def test_ice_chain_finds_planted_mass(spark):
    nmax, kn = 24, [-0.3] * 25
    n, m, cs = index_arrays(nmax, 0)
    s = B.Sphere(nmax)
    lat, lon = (np.degrees(x) for x in (s.lat, s.lon))
    disc = (((lat[:, None] > 60) & (lat[:, None] < 84)) & ((lon[None] > 290) & (lon[None] < 340))).astype(float)
    far = ((np.abs(lat[:, None]) < 20) & (np.abs(lon[None] - 180) < 40)).astype(float) * 0
    k = special.kernel_factors("ewh", nmax, kn=kn)
    rate = (s.analysis(-0.2 * disc + far) / k[None, :, None])[cs, n, m]  # metres of water a year
    rng = np.random.default_rng(1)
    rows = []
    for t in range(72):
        noise = rng.normal(size=len(n)) * 1e-3 / k[n]
        rows += [(2005 + t / 12, int(a), int(b), int(c), float(v)) for a, b, c, v in zip(n, m, cs, rate * t / 12 + noise)]
    coef = spark.createDataFrame(rows, "epoch double, n int, m int, cs int, v double")
    rings = spark.createDataFrame([("ice", 0, [(60.0, 290.0), (84.0, 290.0), (84.0, 340.0), (60.0, 340.0)])], RING)
    ocean = spark.createDataFrame([(float(a), float(b), float(a < 30)) for a in lat for b in lon], "lat double, lon double, w double")
    truth = -0.2 * (s.w * disc).sum() * 4 * np.pi * pipelines.EARTH_M**2 * 1000 / 1e12
    out = {r.region: r for r in pipelines.ice_chain(coef, nmax, rings, kn, 2008.0, "gauss400", ocean).collect()}
    assert out["ice"].gt_per_year == pytest.approx(truth, rel=0.05) and out["all"].gt_per_year == pytest.approx(out["ice"].gt_per_year)
    assert out["ice"].ended == "discrepancy"
    with pytest.raises(ValueError, match="noise"):
        pipelines.ice_chain(coef, nmax, rings, kn)


def test_ocean_chain_takes_the_atmosphere_off(spark):
    lat, lon = [float(x) for x in range(-75, 80, 15)], [float(x) for x in range(0, 360, 30)]
    ocean = spark.createDataFrame([(a, b, 1.0) for a in lat for b in lon], "lat double, lon double, w double")
    kn = [-0.3] * 3
    k = special.kernel_factors("ewh", 2, kn=kn)
    coef = spark.createDataFrame([(2005 + t / 12, 0, 0, 0, float((0.01 * t / 12 + 0.1 * np.sin(t)) / k[0])) for t in range(60)], "epoch double, n int, m int, cs int, v double")
    air = spark.createDataFrame([(2005.001 + t / 12, 0, 0, 0, float(0.1 * np.sin(t) / k[0])) for t in range(60)], "epoch double, n int, m int, cs int, v double")
    means = pipelines.mean_of_sets(air, 2, lat, lon, ocean, kn)
    r = pipelines.ocean_chain(coef, 2, lat, lon, ocean, kn, 0.0, "none", 2007.0, means, 0.01).first()
    assert r.trend_mm == pytest.approx(10.0, abs=1e-6) and r.amplitude_mm == pytest.approx(0, abs=1e-6)
    assert pipelines.ocean_chain(coef, 2, lat, lon, ocean, kn, 0.0, "none", 2007.0).first().sigma_mm > 1


def test_an_empty_reference_period_is_refused(spark):
    lat, lon = [-30.0, 30.0], [0.0, 180.0]
    coef = spark.createDataFrame([(k, 2005 + k / 12, 0, 0, 0, 1.0) for k in range(3)], "set_id long, epoch double, n int, m int, cs int, v double")
    ocean = spark.createDataFrame([(a, b, 1.0) for a in lat for b in lon], "lat double, lon double, w double")
    with pytest.raises(ValueError, match="period"):
        pipelines.bottom_pressure_chain(coef, coef, 2, lat, lon, ocean, [-0.3] * 3, 1990.0, 1991.0)


def test_synthesis_and_analysis_deal_sets_once(spark, sf_dir):
    """One shuffle, by the set; no sums kept for all sets of a task."""
    from orbloom.operators import transforms as T
    from orbloom.plans.base import NMAX, coef

    g = T.synthesis(coef(spark, sf_dir), ["set_id"], NMAX, [-30.0, 30.0], [0.0, 120.0, 240.0])
    for df in (g, T.analysis(g, ["set_id"], 1), T.analysis_quadrature(g, ["set_id"], 1, [-30.0, 30.0], [0.0, 120.0, 240.0], [0.1, 0.1])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == (1 if df is g else 2)


def test_synthesis_of_nulls(spark):
    from orbloom.operators import transforms as T

    x = spark.createDataFrame([(1, 0, 0, 0, None), (2, 0, 0, 0, 2.0), (2, 1, 0, 0, None), (2, 5, 0, 0, 9.0), (None, 0, 0, 0, 3.0)], "set_id long, n int, m int, cs int, v double")
    got = {r.set_id: r.value for r in T.synthesis(x, ["set_id"], 1, [10.0], [20.0]).collect()}
    assert got[1] is None and abs(got[2] - 2) < 1e-12 and abs(got[None] - 3) < 1e-12
