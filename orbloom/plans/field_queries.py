"""Filters, synthesis and analysis, regions, covariances, sequential estimation, combination, catalogues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orbloom.functions import scalars, special
from orbloom.functions.index import index_arrays, literal_table, sql_values
from orbloom.operators import catalogue as G
from orbloom.operators import coefficients as C
from orbloom.operators import combination as M
from orbloom.operators import covariance as V
from orbloom.operators import filters as L
from orbloom.operators import regions as B
from orbloom.operators import regression as R
from orbloom.operators import sequential as K
from orbloom.operators import transforms as T
from orbloom.plans.base import COEF, NMAX, coef, query, r, rounded, table
from orbloom.plans.coefficient_queries import HN, KN, LN

LAT, LON = [-60.0, -20.0, 20.0, 60.0], [0.0, 90.0, 180.0, 270.0]


# --- filters -------------------------------------------------------------------------------------------------------

_W300 = list(enumerate(special.gaussian_weights(NMAX, 300.0).tolist()))
_W3000, _W2000 = (list(enumerate(special.gaussian_weights(NMAX, x).tolist())) for x in (3000.0, 2000.0))


@query(f"WITH {COEF}, w(wn, w) AS (VALUES {sql_values(_W300)}) SELECT set_id, n, m, cs, {r('v * w')} AS v, {r('s * w', 9)} AS s FROM coef JOIN w ON n = wn")
def gaussian_300(spark, sf):
    return rounded(L.gaussian(coef(spark, sf), 300.0, NMAX).select("set_id", "n", "m", "cs", "v", "s"), 6, s=9)


@query(f"WITH {COEF}, a(an, wa) AS (VALUES {sql_values(_W3000)}), b(bm, wb) AS (VALUES {sql_values(_W2000)}) SELECT set_id, n, m, cs, {r('v * wa * wb')} AS v FROM coef JOIN a ON n = an JOIN b ON m = bm")
def fan(spark, sf):
    return rounded(L.fan(coef(spark, sf), 3000.0, 2000.0, NMAX).select("set_id", "n", "m", "cs", "v"))


_BLOCKS = [(m, cs, a, b, (0.7 if a == b else 0.2 / (1 + abs(a - b))) * (1 if cs == 0 else 0.5)) for m in range(2, 6) for cs in (0, 1) for a in range(m, NMAX + 1) for b in range(m, NMAX + 1)]


@query(f"""WITH {COEF}, f(fm, fcs, n_row, n_col, w) AS (VALUES {sql_values(_BLOCKS)}), g AS (SELECT set_id, m, cs, n_row AS n, sum(w * v) AS v FROM coef JOIN f ON m = fm AND cs = fcs AND n = n_col GROUP BY 1, 2, 3, 4)
SELECT c.set_id, c.n, c.m, c.cs, {r('coalesce(g.v, c.v)')} AS v FROM coef c LEFT JOIN g USING (set_id, n, m, cs)""")
def block_filter_apply(spark, sf):
    blocks = literal_table(spark, ["m", "cs", "n_row", "n_col", "w"], _BLOCKS)
    return rounded(L.block_filter(coef(spark, sf), blocks, ["set_id"]).select("set_id", "n", "m", "cs", "v"))


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('(1/(s*s)) / (1/(s*s) + pow(n::DOUBLE, 4) / (0.05::DOUBLE * 0.05::DOUBLE))')} AS w FROM coef WHERE n >= 2")
def design_diagonal(spark, sf):
    return rounded(L.design_diagonal(coef(spark, sf).where("n >= 2"), kaula=0.05).select("set_id", "n", "m", "cs", "w"))


_NORMAL = np.diag(1.0 + 0.1 * index_arrays(NMAX, 0)[0]) + 0.01
_PENALTY = np.maximum(index_arrays(NMAX, 0)[0], 1.0) ** 2
_REG = [(i, j, float(x)) for (i, j), x in np.ndenumerate(np.linalg.solve(_NORMAL + np.diag(_PENALTY), _NORMAL))]


@query(f"WITH {COEF}, w(i, j, w) AS (VALUES {sql_values(_REG)}) SELECT set_id, CAST(i AS INTEGER) AS pos, {r('sum(w * v)')} AS v FROM coef JOIN idx USING (n, m, cs) JOIN w ON j = pos GROUP BY 1, 2")
def regularised_filter(spark, sf):
    x = C.pack(coef(spark, sf), ["set_id"], NMAX)
    y = L.regularised(x, _NORMAL, _PENALTY)
    return rounded(y.select("set_id", F.posexplode("x").alias("pos", "v")))


# --- transforms ----------------------------------------------------------------------------------------------------

_P = [(lat, n, m, p) for lat, n, m, p in T.legendre_rows(NMAX, LAT)]
_T = T.longitude_rows(NMAX, LON)
_SYN = f"""{COEF}, p(lat, pn, pm, p) AS (VALUES {sql_values(_P)}), t(lon, tm, tcs, f) AS (VALUES {sql_values(_T)}),
ring AS (SELECT set_id, label, epoch, lat, m, cs, sum(v * p) AS a FROM coef JOIN p ON n = pn AND m = pm GROUP BY ALL),
grid AS (SELECT set_id, label, epoch, lat, lon, sum(a * f) AS value FROM ring JOIN t ON m = tm AND cs = tcs GROUP BY ALL)"""


@query(f"WITH {_SYN} SELECT set_id, lat, lon, {r('value')} AS value FROM grid")
def synthesis_grid(spark, sf):
    return rounded(T.synthesis(coef(spark, sf), ["set_id"], NMAX, LAT, LON))


@query(f"WITH {_SYN} SELECT set_id, lat, lon, {r('value')} AS value FROM grid")
def synthesis_dense(spark, sf):
    """The same fields from packed vectors in Arrow batches."""
    x = T.synthesis_dense(C.pack(coef(spark, sf), ["set_id"], NMAX), NMAX, LAT, LON)
    at = literal_table(spark, ["k", "lat", "lon"], [(i * len(LON) + j, a, b) for i, a in enumerate(LAT) for j, b in enumerate(LON)])
    return rounded(x.select("set_id", F.posexplode("grid").alias("k", "value")).join(F.broadcast(at), "k").drop("k"))


@query(f"WITH {_SYN} SELECT set_id, lat, m, cs, {r('a')} AS a FROM ring")
def ring_partial_sums(spark, sf):
    p = literal_table(spark, ["lat", "n", "m", "p"], _P)
    return rounded(coef(spark, sf).join(F.broadcast(p), ["n", "m"]).groupBy("set_id", "lat", "m", "cs").agg(F.sum(F.col("v") * F.col("p")).alias("a")))


@query(f"""WITH {_SYN} SELECT a.set_id, a.lat, a.lon, {r('sqrt(a.value*a.value + b.value*b.value)')} AS amplitude, {r('atan2(b.value, a.value)')} AS phase
FROM grid a JOIN grid b ON b.set_id = a.set_id + 1 AND a.lat = b.lat AND a.lon = b.lon WHERE a.set_id % 2 = 0""")
def amplitude_phase(spark, sf):
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, LAT, LON)
    odd = g.where("set_id % 2 = 1").withColumn("set_id", F.col("set_id") - 1)
    return rounded(T.amplitude_phase(g.where("set_id % 2 = 0"), odd, ["set_id", "lat", "lon"]))


@query(f"WITH {_SYN} SELECT set_id, {r('sqrt(sum(cos(radians(lat)) * value * value) / sum(cos(radians(lat))))')} AS rms FROM grid WHERE lon < 180 GROUP BY set_id")
def ocean_rms(spark, sf):
    from orbloom.operators.statistics import area_rms

    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, LAT, LON)
    return rounded(area_rms(g.where("lon < 180"), ["set_id"]))


_PTS = [(1, 10.0, 20.0, 6.5e6), (2, -45.0, 200.0, 6.8e6)]
_PY = [(k, int(n), int(m), int(cs), float(y)) for k, lat, lon, radius in _PTS for n, m, cs, y in zip(*index_arrays(NMAX, 0), special.ylm(np.radians([lat]), np.radians([lon]), *index_arrays(NMAX, 0))[0] * special.GM_EARTH / special.R_EARTH * (special.R_EARTH / radius) ** (index_arrays(NMAX, 0)[0] + 1))]


@query(f"WITH {COEF}, y(point_id, yn, ym, ycs, y) AS (VALUES {sql_values(_PY)}), pt(point_id, lat, lon, radius) AS (VALUES {sql_values(_PTS)}) SELECT set_id, point_id, lat, lon, radius, {r('sum(1e-7 * v * y)')} AS value FROM coef JOIN y ON n = yn AND m = ym AND cs = ycs JOIN pt USING (point_id) WHERE n >= 2 GROUP BY ALL")
def synthesis_points(spark, sf):
    x = coef(spark, sf).withColumn("v", F.col("v") * 1e-7)
    return rounded(T.synthesis_points(x, literal_table(spark, ["point_id", "lat", "lon", "radius"], _PTS), ["set_id"], NMAX))


@query()
def load_deformation(spark, sf):
    return rounded(T.deformation(coef(spark, sf).withColumn("v", F.col("v") * 1e-6), ["set_id"], NMAX, LAT, LON, KN, HN, LN))


@query()
def gradient_tensor_trace(spark, sf):
    """Largest trace over each set's grid against its largest component: Laplace's equation."""
    g = T.gradient_tensor(C.pack(coef(spark, sf), ["set_id"], NMAX), NMAX, LAT, LON)
    z = g.select("set_id", F.explode(F.arrays_zip("nn", "ee", "uu")).alias("g"))
    return rounded(z.groupBy("set_id").agg(F.max(F.abs(F.col("g.nn") + F.col("g.ee") + F.col("g.uu")) / F.abs(F.col("g.uu"))).alias("trace")))


_GL_X, _GL_W = special.gauss_legendre(NMAX + 1)
_GL_LAT, _GL_LON = [float(x) for x in np.degrees(np.arcsin(_GL_X))], [float(x) for x in 360 * np.arange(2 * NMAX + 2) / (2 * NMAX + 2)]


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('v')} AS v FROM coef")
def analysis_roundtrip(spark, sf):
    """Coefficients of the field that the coefficients make, by quadrature: the identity."""
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, _GL_LAT, _GL_LON)
    return rounded(T.analysis_quadrature(g, ["set_id"], NMAX, _GL_LAT, _GL_LON, _GL_W / 2 / len(_GL_LON)))


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('v')} AS v FROM coef")
def analysis_least_squares(spark, sf):
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, _GL_LAT, _GL_LON)
    return rounded(T.analysis(g, ["set_id"], NMAX))


# --- regions -------------------------------------------------------------------------------------------------------


def _cap(lat0: float, lon0: float, radius: float):
    def mask(lat, lon):
        c = np.sin(np.radians(lat)) * np.sin(np.radians(lat0)) + np.cos(np.radians(lat)) * np.cos(np.radians(lat0)) * np.cos(np.radians(lon - lon0))
        return (np.degrees(np.arccos(np.clip(c, -1, 1))) <= radius).astype(float)

    return mask


_N, _M, _CS = index_arrays(NMAX, 0)
_BASINS = [(name, int(n), int(m), int(cs), float(b)) for name, mask in (("a", _cap(15, 300, 25)), ("b", _cap(-30, 80, 40))) for n, m, cs, b in zip(_N, _M, _CS, B.basin_kernel(mask, NMAX, 0))]


@query(f"WITH {COEF}, k(basin, bn, bm, bcs, b) AS (VALUES {sql_values(_BASINS)}) SELECT basin, set_id, {r('sum(b * v) / sum(b * b)')} AS average FROM coef JOIN k ON n = bn AND m = bm AND cs = bcs GROUP BY 1, 2")
def basin_average(spark, sf):
    return rounded(B.basin_average(coef(spark, sf), literal_table(spark, ["basin", "n", "m", "cs", "b"], _BASINS), ["set_id"]))


@query(f"WITH {COEF}, k(basin, bn, bm, bcs, b) AS (VALUES {sql_values(_BASINS)}) SELECT basin, label, {r('avg(x)')} AS average FROM (SELECT basin, label, set_id, sum(b * v) AS x FROM coef JOIN k ON n = bn AND m = bm AND cs = bcs GROUP BY 1, 2, 3) GROUP BY 1, 2")
def basin_kernel(spark, sf):
    x = B.basin_average(coef(spark, sf), literal_table(spark, ["basin", "n", "m", "cs", "b"], _BASINS), ["label", "set_id"], False)
    return rounded(x.groupBy("basin", "label").agg(F.avg("average").alias("average")))


_SENS = [(int(n), int(m), int(cs), float(x)) for n, m, cs, x in zip(_N, _M, _CS, B.sensitivity_kernel(np.array([x[4] for x in _BASINS if x[0] == "a"]), _N))]


@query(f"WITH {COEF}, k(kn, km, kcs, k) AS (VALUES {sql_values(_SENS)}) SELECT set_id, {r('sum(k * v)')} AS value FROM coef JOIN k ON n = kn AND m = km AND cs = kcs GROUP BY set_id")
def sensitivity_kernel(spark, sf):
    k = F.broadcast(literal_table(spark, ["n", "m", "cs", "k"], _SENS))
    return rounded(coef(spark, sf).join(k, ["n", "m", "cs"]).groupBy("set_id").agg(F.sum(F.col("k") * F.col("v")).alias("value")))


@query(f"""WITH {_SYN}, f AS (SELECT lat, lon, value AS t, value * (0.6::DOUBLE + 0.001::DOUBLE * (set_id % 7)) AS f FROM grid)
SELECT lat, lon, {r('sum(t*f) / nullif(sum(f*f), 0)')} AS gain, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY lat, lon""")
def grid_scaling(spark, sf):
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, LAT, LON).withColumn("f", F.col("value") * (0.6 + 0.001 * (F.col("set_id") % 7)))
    return rounded(B.scaling_factor(g, ["lat", "lon"], "value", "f"))


_G, _LAM, _ = B.slepian(_cap(15, 300, 40), NMAX, 0, 4)
_SLEP = [(k, int(n), int(m), int(cs), float(_G[i, k] * np.sign(_G[np.abs(_G[:, k]).argmax(), k]))) for k in range(4) for i, (n, m, cs) in enumerate(zip(_N, _M, _CS))]


@query(f"WITH {COEF}, g(mode, gn, gm, gcs, g) AS (VALUES {sql_values(_SLEP)}) SELECT set_id, mode, {r('sum(g * v)')} AS a FROM coef JOIN g ON n = gn AND m = gm AND cs = gcs GROUP BY 1, 2")
def slepian(spark, sf):
    return rounded(B.project(coef(spark, sf), literal_table(spark, ["mode", "n", "m", "cs", "g"], _SLEP), ["set_id"]))


_RING = [(-30.0, 50.0), (40.0, 50.0), (40.0, 200.0), (-30.0, 200.0)]


@query(f"WITH {_SYN} SELECT set_id, {r('avg(value)')} AS mean FROM grid WHERE lat > -30 AND lat < 40 AND lon > 50 AND lon < 200 GROUP BY set_id")
def polygon_mean(spark, sf):
    g = B.polygon_mask(T.synthesis(coef(spark, sf), ["set_id"], NMAX, LAT, LON), [_RING])
    return rounded(g.where("w > 0.5").groupBy("set_id").agg(F.avg("value").alias("mean")))


_MLAT, _MLON = [float(x) for x in range(-80, 81, 20)], [float(x) for x in range(0, 360, 30)]


@query(f"""WITH {COEF}, c AS (SELECT label, n, m, cs, avg(v) AS v FROM coef GROUP BY 1, 2, 3, 4), p(lat, pn, pm, p) AS (VALUES {sql_values(T.legendre_rows(NMAX, _MLAT))}), t(lon, tm, tcs, f) AS (VALUES {sql_values(T.longitude_rows(NMAX, _MLON))}),
ring AS (SELECT label, lat, m, cs, sum(v * p) AS a FROM c JOIN p ON n = pn AND m = pm GROUP BY ALL), g AS MATERIALIZED (SELECT label, lat, lon, CASE WHEN sum(a * f) > 0 THEN 1 ELSE 0 END AS w FROM ring JOIN t ON m = tm AND cs = tcs GROUP BY ALL)
SELECT label, lat, lon FROM g i WHERE w = 1 AND NOT EXISTS (SELECT 1 FROM g o WHERE o.label = i.label AND o.w = 0 AND 2 * 6378.1363::DOUBLE * asin(least(1, sqrt(pow(sin(radians(o.lat - i.lat)/2), 2) + cos(radians(i.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - i.lon)/2), 2)))) <= 1700)""")
def mask_erosion(spark, sf):
    """Where the mean field of each product is positive, and nowhere within 1700 km is it not."""
    mean = coef(spark, sf).groupBy("label", "n", "m", "cs").agg(F.avg("v").alias("v"))
    g = T.synthesis(mean, ["label"], NMAX, _MLAT, _MLON).withColumn("w", F.when(F.col("value") > 0, 1.0).otherwise(0.0))
    return B.shrink(g.select("label", "lat", "lon", "w"), 1700.0, ["label"]).select("label", "lat", "lon")


_SPHERE = B.Sphere(NMAX)
_SLAT, _SLON = _SPHERE.degrees()
_W800 = special.gaussian_weights(NMAX, 800.0)
_DISCS = [(name, float(lat), float(lon), float(_cap(*disc)(np.array([lat]), np.array([lon]))[0])) for name, disc in (("a", (15, 300, 40)), ("b", (-30, 80, 50))) for lat in _SLAT for lon in _SLON]


@query()
def leakage_iterate(spark, sf):
    """Every set's field in two discs, smoothed and recovered there: share of the discs' mean before and after, rounds, residual."""
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, _SLAT, _SLON)
    fields = g.join(F.broadcast(literal_table(spark, ["region", "lat", "lon", "inside"], _DISCS)), ["lat", "lon"])
    fields = fields.select("region", "set_id", "lat", "lon", (F.col("value") * F.col("inside")).alias("truth"), "inside")
    back = T.analysis_quadrature(fields.withColumnRenamed("truth", "value"), ["region", "set_id"], NMAX, _SLAT, _SLON, _SPHERE.w.sum(axis=1) / _SPHERE.n_lon)
    smooth = T.synthesis(back, ["region", "set_id"], NMAX, _SLAT, _SLON, _W800)
    out = B.leakage_correct(smooth.join(fields, ["region", "set_id", "lat", "lon"]), ["region", "set_id"], NMAX, _W800, most=60, tol=1e-3)
    w = F.col("inside") * F.cos(F.radians("lat"))
    sums = out.groupBy("region", "set_id", "rounds", "ended", "residual").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(n) for n, c in (("truth", "truth"), ("smoothed", "value"), ("recovered", "corrected"))])
    return rounded(sums, 5)


_OCEAN = _cap(-20, 160, 100)


@query()
def sea_level_fingerprint(spark, sf):
    """Sea level that follows from every set's field on land, ring by ring, with the ocean's mean and the rounds."""
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, _SLAT, _SLON).withColumnRenamed("value", "load")
    ocean = literal_table(spark, ["lat", "lon", "ocean"], [(float(a), float(b), float(_OCEAN(np.array([a]), np.array([b]))[0])) for a in _SLAT for b in _SLON])
    s = B.sea_level_fingerprints(g.join(F.broadcast(ocean), ["lat", "lon"]), ["set_id"], NMAX, KN, HN)
    return rounded(s.groupBy("set_id", "rounds", "eustatic", "lat").agg(F.avg("level").alias("level")))


# --- covariance and the Wiener filter --------------------------------------------------------------------------------


def _anomalies(spark, sf):
    x = coef(spark, sf)
    mean = x.groupBy("n", "m", "cs").agg(F.avg("v").alias("mv"))
    return x.join(mean, ["n", "m", "cs"]).withColumn("residual", F.col("v") - F.col("mv")).select("set_id", "epoch", "n", "m", "cs", "residual", "s")


_RES = f"{COEF}, res AS (SELECT set_id, epoch, n, m, cs, s, v - avg(v) OVER (PARTITION BY n, m, cs) AS residual FROM coef), noise AS (SELECT n, m, cs, 0.2::DOUBLE * var_samp(v) AS d FROM coef GROUP BY 1, 2, 3)"


def _noise(spark, sf):
    return coef(spark, sf).groupBy("n", "m", "cs").agg((0.2 * F.var_samp("v")).alias("d"))


@query(f"WITH {_RES} SELECT a.m, a.cs, a.n % 2 AS parity, a.n AS n1, b.n AS n2, {r('covar_samp(a.residual, b.residual) * (CASE WHEN a.n = b.n THEN 1 ELSE 0.9::DOUBLE END)', 9)} AS cov FROM res a JOIN res b ON a.set_id = b.set_id AND a.m = b.m AND a.cs = b.cs AND a.n % 2 = b.n % 2 AND a.n <= b.n GROUP BY a.m, a.cs, a.n, b.n")
def block_covariance(spark, sf):
    return rounded(V.block_covariance(_anomalies(spark, sf), 0.1), 9)


@query(f"WITH {_RES} SELECT set_id, {r('median(residual * residual / d) / 0.454936423119573::DOUBLE')} AS factor FROM res JOIN noise USING (n, m, cs) WHERE n >= 5 GROUP BY set_id")
def vce_factor(spark, sf):
    return rounded(V.variance_factor(_anomalies(spark, sf), _noise(spark, sf), 5, ["set_id"]))


_SIG = f"{_RES}, ms AS (SELECT n, m, cs, avg(residual * residual) AS ms FROM res GROUP BY 1, 2, 3), sig AS (SELECT n, greatest(avg(ms - d), 0) AS signal, count(*) AS terms FROM ms JOIN noise USING (n, m, cs) GROUP BY n)"


@query(f"WITH {_SIG} SELECT n, {r('signal', 9)} AS signal, CAST(terms AS BIGINT) AS terms FROM sig")
def signal_degree_variance(spark, sf):
    return rounded(V.signal_variance(_anomalies(spark, sf), _noise(spark, sf)), 9)


@query(f"WITH {_SIG} SELECT set_id, n, m, cs, {r('signal / (signal + d)')} AS gain, {r('signal / (signal + d) * residual')} AS filtered FROM res JOIN noise USING (n, m, cs) JOIN sig USING (n)")
def wiener_diagonal(spark, sf):
    a, d = _anomalies(spark, sf), _noise(spark, sf)
    return rounded(V.wiener_diagonal(a, d, V.signal_variance(a, d)).select("set_id", "n", "m", "cs", "gain", "filtered"))


@query()
def tvans_filter(spark, sf):
    """Block Wiener filter with a noise factor for every epoch."""
    a = _anomalies(spark, sf)
    f = V.variance_factor(a, _noise(spark, sf), 5, ["epoch"])
    return rounded(V.wiener_blocks(a, f))


# --- sequential ------------------------------------------------------------------------------------------------------


def _hourly(spark, sf):
    """Mean event value by type and hour, as departures from the type's mean; the epoch counts hours."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("epoch")).agg(F.avg("value").alias("v"))
    return e.withColumn("v", F.col("v") - F.avg("v").over(W.partitionBy("event_type")))


_HOUR = "h AS (SELECT event_type, floor(epoch(ts) / 3600)::DOUBLE AS epoch, avg(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT event_type, epoch, v - avg(v) OVER (PARTITION BY event_type) AS v, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS k FROM h)"


@query(f"""WITH RECURSIVE {_HOUR}, f AS (
SELECT event_type, epoch, k, v / (1.0::DOUBLE + 0.5::DOUBLE) * 1.0::DOUBLE AS x, 1.0::DOUBLE * 0.5::DOUBLE / 1.5::DOUBLE AS p FROM c WHERE k = 1
UNION ALL SELECT c.event_type, c.epoch, c.k, 0.8::DOUBLE * x + (0.64::DOUBLE * p + 0.3::DOUBLE) / (0.64::DOUBLE * p + 0.3::DOUBLE + 0.5::DOUBLE) * (c.v - 0.8::DOUBLE * x), (0.64::DOUBLE * p + 0.3::DOUBLE) * 0.5::DOUBLE / (0.64::DOUBLE * p + 0.3::DOUBLE + 0.5::DOUBLE)
FROM f JOIN c ON c.event_type = f.event_type AND c.k = f.k + 1) SELECT event_type, epoch, {r('x')} AS filtered, {r('p')} AS filtered_var FROM f""")
def kalman_scalar_batch(spark, sf):
    return rounded(K.kalman_series(_hourly(spark, sf), ["event_type"], 0.8, 0.3, 0.5, 1.0).select("event_type", "epoch", "filtered", "filtered_var"))


@query(f"""WITH RECURSIVE {_HOUR}, f AS (
SELECT event_type, epoch, k, v / (1.0::DOUBLE + 0.5::DOUBLE) * 1.0::DOUBLE AS x, 1.0::DOUBLE * 0.5::DOUBLE / 1.5::DOUBLE AS p FROM c WHERE k = 1
UNION ALL SELECT c.event_type, c.epoch, c.k, 0.8::DOUBLE * x + (0.64::DOUBLE * p + 0.3::DOUBLE) / (0.64::DOUBLE * p + 0.3::DOUBLE + 0.5::DOUBLE) * (c.v - 0.8::DOUBLE * x), (0.64::DOUBLE * p + 0.3::DOUBLE) * 0.5::DOUBLE / (0.64::DOUBLE * p + 0.3::DOUBLE + 0.5::DOUBLE)
FROM f JOIN c ON c.event_type = f.event_type AND c.k = f.k + 1), bk AS MATERIALIZED (SELECT *, max(k) OVER (PARTITION BY event_type) AS last, 0.8::DOUBLE * p / (0.64::DOUBLE * p + 0.3::DOUBLE) AS g FROM f),
s AS (SELECT event_type, epoch, k, x AS xs, p AS ps FROM bk WHERE k = last
UNION ALL SELECT bk.event_type, bk.epoch, bk.k, bk.x + bk.g * (xs - 0.8::DOUBLE * bk.x), bk.p + bk.g * bk.g * (ps - (0.64::DOUBLE * bk.p + 0.3::DOUBLE)) FROM s JOIN bk ON bk.event_type = s.event_type AND bk.k = s.k - 1)
SELECT event_type, epoch, {r('xs')} AS smoothed, {r('ps')} AS smoothed_var FROM s""")
def rts_scalar(spark, sf):
    return rounded(K.kalman_series(_hourly(spark, sf), ["event_type"], 0.8, 0.3, 0.5, 1.0).select("event_type", "epoch", "smoothed", "smoothed_var"))


@query(f"""WITH {_HOUR}, t AS (SELECT event_type, count(*) AS t FROM c GROUP BY 1)
SELECT a.event_type, CAST(h AS INTEGER) AS h, {r('sum(a.v * b.v) / max(t)', 5)} AS cov FROM range(0, 4) g(h), c a JOIN t USING (event_type), c b WHERE b.event_type = a.event_type AND a.epoch = b.epoch + h GROUP BY 1, 2""")
def lag_covariances(spark, sf):
    return rounded(K.lag_covariances(_hourly(spark, sf), ["event_type"], "v", 3, 1.0), 5)


@query()
def var_model(spark, sf):
    """First-order autoregression of the sets' low degrees over epochs: coefficients by pair."""
    x = C.pack(coef(spark, sf).where("n <= 2"), ["epoch"], 2)
    phi = K.fit_var_series(x, "epoch", "x", 0.1)
    return rounded(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(phi)], "i long, j long, phi double"))


# --- combination -------------------------------------------------------------------------------------------------------


@query(f"WITH {COEF} SELECT CAST(set_id // 10 AS BIGINT) AS month, n, m, cs, {r('sum(v/(s*s)) / sum(1/(s*s))')} AS v, {r('sqrt(1/sum(1/(s*s)))', 9)} AS s, CAST(count(*) AS BIGINT) AS n_sources FROM coef GROUP BY 1, 2, 3, 4")
def combine_weighted(spark, sf):
    x = coef(spark, sf).withColumn("month", F.floor(F.col("set_id") / 10))
    return rounded(M.weighted_mean(x, ["month", "n", "m", "cs"]), 6, s=9)


@query()
def combine_vce(spark, sf):
    x = coef(spark, sf).where("n <= 3").withColumn("month", F.floor(F.col("set_id") / 10)).withColumn("source", F.col("set_id") % 10).withColumn("s", F.lit(0.1))
    return rounded(M.combine_sources(x, "source", ["month"], 3))


@query(f"WITH {COEF} SELECT a.set_id, CAST(count(*) AS BIGINT) AS n, {r('sqrt(avg((a.v-b.v)*(a.v-b.v)))')} AS rms_diff, {r('corr(a.v, b.v)')} AS corr, {r('avg((a.v-b.v)*(a.v-b.v)/(a.s*a.s+b.s*b.s))', 2)} AS chi2_per_dof FROM coef a JOIN coef b ON b.set_id = a.set_id + 1 AND a.n = b.n AND a.m = b.m AND a.cs = b.cs WHERE a.set_id % 2 = 0 GROUP BY 1")
def compare_sets(spark, sf):
    x = coef(spark, sf)
    b = x.where("set_id % 2 = 1").withColumn("set_id", F.col("set_id") - 1)
    return rounded(M.compare_sets(x.where("set_id % 2 = 0"), b, ["set_id", "n", "m", "cs"], ["set_id"]), 6, chi2_per_dof=2)


@query("""WITH e AS (SELECT l_partkey % 8 AS i, l_suppkey % 8 AS j, l_quantity AS value, 1 + l_linenumber AS s2, l_returnflag AS k FROM lineitem)
SELECT k, i, j, round(sum(value / s2), 3) + 0.0 AS value FROM e GROUP BY 1, 2, 3""")
def neq_accumulate(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_partkey") % 8).alias("i"), (F.col("l_suppkey") % 8).alias("j"), F.col("l_quantity").alias("value"), (1 + F.col("l_linenumber")).alias("s2"), F.col("l_returnflag").alias("k"))
    return rounded(M.accumulate_normals(e, ["k"], "s2"), 3)


@query()
def neq_combine(spark, sf):
    """Two groups of observations of the same three parameters, combined with estimated variance factors."""
    x = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("g"), F.lit(1.0).alias("x0"), (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 1e4).alias("y"))
    cols = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}{j}") for i in range(3) for j in range(3)] + [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(3)]
    parts = [(np.array([[q[f"a{i}{j}"] for j in range(3)] for i in range(3)]), np.array([q[f"b{i}"] for i in range(3)]), q["yy"], q["n"]) for q in x.groupBy("g").agg(*cols, F.sum(F.col("y") ** 2).alias("yy"), F.count("*").alias("n")).orderBy("g").collect()]
    sol, s2 = M.combine_normals(parts)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate([*sol, *s2])], "k int, value double"))


@query()
def eof(spark, sf):
    """Leading modes of all sets over their epochs."""
    x = coef(spark, sf).select("epoch", "n", "m", "cs", "v")
    patterns, _, share = M.eof(x, "epoch", ["n", "m", "cs"], "v", 3)
    explained = literal_table(spark, ["mode", "explained"], [(k, float(s)) for k, s in enumerate(share)])
    return rounded(patterns.join(explained, "mode").withColumn("pattern", F.abs("pattern")))


@query()
def mc_propagate(spark, sf):
    """Sigma of a degree amplitude from the coefficients' sigmas, by simulation."""
    return rounded(M.monte_carlo(coef(spark, sf), lambda d: d.groupBy("sample", "set_id", "n").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("value")), ["set_id", "n"], 200))


_K2 = np.column_stack([[x[4] for x in _BASINS if x[0] == b] for b in "ab"])
_W500 = special.gaussian_weights(NMAX, 500.0)
_UNMIX = B.deconvolution(_K2, np.diag(_W500[_N]))


@query(f"""WITH {COEF}, k(basin, bn, bm, bcs, b) AS (VALUES {sql_values(_BASINS)}), g(gn, g) AS (VALUES {sql_values(list(enumerate(_W500.tolist())))}),
x AS (SELECT set_id, sum(CASE WHEN basin = 'a' THEN b * g * v END) AS a, sum(CASE WHEN basin = 'b' THEN b * g * v END) AS b FROM coef JOIN k ON n = bn AND m = bm AND cs = bcs JOIN g ON n = gn GROUP BY 1)
SELECT set_id, {r(f'{float(_UNMIX[0, 0])!r}::DOUBLE * a + {float(_UNMIX[0, 1])!r}::DOUBLE * b')} AS basin_a, {r(f'{float(_UNMIX[1, 0])!r}::DOUBLE * a + {float(_UNMIX[1, 1])!r}::DOUBLE * b')} AS basin_b FROM x""")
def deconvolve(spark, sf):
    """Two overlapping basins separated again after a Gaussian filter."""
    bare = B.basin_average(L.gaussian(coef(spark, sf), 500.0, NMAX), literal_table(spark, ["basin", "n", "m", "cs", "b"], _BASINS), ["set_id"], False)
    return rounded(B.deconvolve(bare, ["set_id"], ["a", "b"], _UNMIX))


# --- scalars, catalogues, text -----------------------------------------------------------------------------------------


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS link FROM pages")
def html_links(spark, sf):
    return G.links(table(spark, sf, "pages"), "html", ["page_id"])


@query("""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link FROM pages)
SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT link) AS BIGINT) AS distinct_links FROM l GROUP BY 1""")
def html_link_catalogue(spark, sf):
    x = G.links(table(spark, sf, "pages"), "html", ["page_id", "url"])
    return x.groupBy(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host")).agg(F.count("*").alias("links"), F.countDistinct("link").alias("distinct_links"))


@query(f"""WITH n AS (SELECT o_orderkey, 'GSM-2_' || strftime(o_orderdate, '%Y%j') || '-' || strftime(o_orderdate + INTERVAL 20 DAY, '%Y%j') || '_GRAC_0600.gfc' AS a FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'model_' || strftime(o_orderdate, '%Y-%m-%d') || '.gfc' FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 'month_' || strftime(o_orderdate, '%Y-%m') || '.gfc' FROM orders WHERE o_orderkey % 3 = 2),
x AS (SELECT o_orderkey, a, o_orderdate AS d, o_orderdate + INTERVAL 20 DAY AS e FROM n JOIN orders USING (o_orderkey)),
y AS (SELECT *, year(d) + (dayofyear(d) - 0.5::DOUBLE) / CASE WHEN year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) THEN 366 ELSE 365 END AS yd, year(e) + (dayofyear(e) - 0.5::DOUBLE) / CASE WHEN year(e) % 4 = 0 AND (year(e) % 100 <> 0 OR year(e) % 400 = 0) THEN 366 ELSE 365 END AS ye FROM x)
SELECT o_orderkey, a AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'GSM' ELSE 'unknown' END AS product, {r('CASE o_orderkey % 3 WHEN 0 THEN (yd + ye) / 2 WHEN 1 THEN yd ELSE year(d) + (month(d) - 0.5::DOUBLE) / 12 END')} AS epoch FROM y""")
def filename_epoch(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    day = F.date_format(d, "yyyyDDD")
    last = F.date_format(d + F.expr("interval 20 days"), "yyyyDDD")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("GSM-2_"), day, F.lit("-"), last, F.lit("_GRAC_0600.gfc"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("model_"), F.date_format(d, "yyyy-MM-dd"), F.lit(".gfc"))).otherwise(F.concat(F.lit("month_"), F.date_format(d, "yyyy-MM"), F.lit(".gfc")))
    x = o.select("o_orderkey", name.alias("name"))
    return rounded(x.withColumn("product", scalars.product_of(F.col("name"))).withColumn("epoch", scalars.file_name_epoch(F.col("name"))))


@query(f"""WITH y AS (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m%d') AS DOUBLE) + 0.1230::DOUBLE AS code, o_orderdate::DATE AS d FROM orders)
SELECT {r('code', 4)} AS code, {r('year(d) + (dayofyear(d) - 1 + (12 + 30 / 60.0::DOUBLE) / 24) / CASE WHEN year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) THEN 366 ELSE 365 END')} AS epoch FROM y""")
def date_code_epoch(spark, sf):
    c = table(spark, sf, "orders").select((F.date_format("o_orderdate", "yyyyMMdd").cast("double") + 0.1230).alias("code")).distinct()
    return rounded(c.withColumn("epoch", scalars.date_code_epoch(F.col("code"))), 6, code=4)


@query(f"""SELECT o_orderkey, {r("year(o_orderdate) + (epoch(o_orderdate) - epoch(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0))) / (epoch(make_timestamp(year(o_orderdate) + 1, 1, 1, 0, 0, 0)) - epoch(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0)))")} AS epoch FROM orders""")
def decimal_year(spark, sf):
    return rounded(table(spark, sf, "orders").select("o_orderkey", scalars.decimal_year(F.col("o_orderdate")).alias("epoch")))


@query(f"""WITH g AS (SELECT c_custkey, (c_acctbal - 4000) / 60 AS lat FROM customer), f AS (SELECT c_custkey, lat, pow(1 - 1/298.257223563::DOUBLE, 2) AS k FROM g WHERE abs(lat) < 89)
SELECT c_custkey, {r('degrees(atan(k * tan(radians(lat))))')} AS geocentric, {r('degrees(atan(tan(radians(lat)) / k))')} AS geodetic FROM f""")
def latitude_conversion(spark, sf):
    g = table(spark, sf, "customer").select("c_custkey", ((F.col("c_acctbal") - 4000) / 60).alias("lat")).where("abs(lat) < 89")
    return rounded(g.select("c_custkey", scalars.geodetic_to_geocentric(F.col("lat")).alias("geocentric"), scalars.geocentric_to_geodetic(F.col("lat")).alias("geodetic")))


@query(f"""WITH e AS (SELECT vec_id, 2002 + vec_id / 12.0::DOUBLE AS t FROM embeddings), d AS (SELECT *, t - 2000 AS x FROM e),
p AS (SELECT *, CASE WHEN t < 2010 THEN 55.974::DOUBLE + 1.8243::DOUBLE*x + 0.18413::DOUBLE*x*x + 0.007024::DOUBLE*x*x*x ELSE 23.513::DOUBLE + 7.6141::DOUBLE*x END / 1000 AS xa, CASE WHEN t < 2010 THEN 346.346::DOUBLE + 1.7896::DOUBLE*x - 0.10729::DOUBLE*x*x - 0.000908::DOUBLE*x*x*x ELSE 358.891::DOUBLE - 0.6287::DOUBLE*x END / 1000 AS ya, (55.0::DOUBLE + 1.677::DOUBLE*x) / 1000 AS xb, (320.5::DOUBLE + 3.460::DOUBLE*x) / 1000 AS yb FROM d),
m AS (SELECT vec_id, xb - xa AS m1, ya - yb AS m2 FROM p)
SELECT vec_id, {r('1e9 * (-1.333e-9 * (m1 + 0.0115::DOUBLE*m2) - 2.1778e-10 * (m1 - 0.01724::DOUBLE*m2))')} AS dc, {r('1e9 * (-1.333e-9 * (m2 - 0.0115::DOUBLE*m1) - 2.1778e-10 * (m2 + 0.03365::DOUBLE*m1))')} AS ds FROM m""")
def pole_tide_convert(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (2002 + F.col("vec_id") / 12.0).alias("t"))
    dc, ds = scalars.pole_tide_change(F.col("t"))
    return rounded(e.select("vec_id", (dc * 1e9).alias("dc"), (ds * 1e9).alias("ds")))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def json_meta(spark, sf):
    return table(spark, sf, "events").select("event_type", G.json_field("props", "k").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT DISTINCT strftime(o_orderdate, '%Y') AS t FROM orders UNION SELECT DISTINCT strftime(o_orderdate, '%Y-%m') FROM orders UNION SELECT 'x' || o_orderstatus FROM orders)
SELECT DISTINCT t || '-' || lpad(k::VARCHAR, 2, '0') AS month FROM x, range(1, 13) r(k) WHERE length(t) = 4 UNION SELECT t FROM x WHERE length(t) = 7""")
def month_list(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select(F.date_format("o_orderdate", "yyyy").alias("t")).union(o.select(F.date_format("o_orderdate", "yyyy-MM"))).union(o.select(F.concat(F.lit("x"), "o_orderstatus")))
    return G.month_list(t.distinct(), "t")


@query(f"SELECT event_id, CAST(1 + user_id % 8 AS BIGINT) AS attempt, {r('least(2 * pow(2.0::DOUBLE, user_id % 8) * (1 + 0.05::DOUBLE * (event_id % 5)), 60.0::DOUBLE)')} AS wait FROM events")
def retry_delay(spark, sf):
    """Waiting times of attempts, one to each event."""
    e = table(spark, sf, "events").select("event_id", (1 + F.col("user_id") % 8).alias("attempt"))
    return rounded(e.withColumn("wait", scalars.retry_delay(F.col("attempt"), 0.05 * (F.col("event_id") % 5))))
