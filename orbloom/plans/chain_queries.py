"""Whole regional chains over the driver tables: basins, ocean, bottom pressure, ice; polygons with parts and holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import literal_table, sql_values
from orbloom.operators import pipelines as P
from orbloom.operators import regions as B
from orbloom.operators import regression
from orbloom.operators import transforms as T
from orbloom.plans.base import COEF, NMAX, coef, monthly, monthly_sql, query, r, rounded
from orbloom.plans.coefficient_queries import KN

LAT, LON = [float(x) for x in range(-80, 81, 20)], [float(x) for x in range(10, 360, 20)]
TWO_PI, T0 = "6.283185307179586::DOUBLE", 2010.0

# Basins as (region, part, ring of (lat, lon)): one with a hole, one of two parts, one over the date line.
RINGS = [
    ("north", 0, [(15.0, 95.0), (70.0, 95.0), (70.0, 265.0), (15.0, 265.0)]),
    ("north", 1, [(35.0, 145.0), (45.0, 145.0), (45.0, 215.0), (35.0, 215.0)]),
    ("pair", 0, [(-50.0, 20.0), (-10.0, 20.0), (-10.0, 60.0), (-50.0, 60.0)]),
    ("pair", 1, [(-50.0, 280.0), (-10.0, 280.0), (-10.0, 300.0), (-50.0, 300.0)]),
    ("line", 0, [(-30.0, 315.0), (30.0, 315.0), (30.0, 405.0), (-30.0, 405.0)]),
]
_INSIDE = """SELECT lat, lon, 'north' AS region FROM places WHERE lat BETWEEN 15 AND 70 AND lon BETWEEN 95 AND 265 AND NOT (lat BETWEEN 35 AND 45 AND lon BETWEEN 145 AND 215)
UNION ALL SELECT lat, lon, 'pair' FROM places WHERE lat BETWEEN -50 AND -10 AND (lon BETWEEN 20 AND 60 OR lon BETWEEN 280 AND 300)
UNION ALL SELECT lat, lon, 'line' FROM places WHERE lat BETWEEN -30 AND 30 AND (lon > 315 OR lon < 45)"""


def _rings(spark, names=("north", "pair", "line")):
    rows = [(a, b, [tuple(map(float, p)) for p in ring]) for a, b, ring in RINGS if a in names]
    return spark.createDataFrame(rows, "region string, part int, ring array<struct<lat: double, lon: double>>")


_EWH = (special.kernel_factors("ewh", NMAX, kn=KN) * special.gaussian_weights(NMAX, 400.0)).tolist()
_GRID = f"""{COEF}, kf(kn, k) AS (VALUES {sql_values(list(enumerate(_EWH)))}), p(lat, pn, pm, p) AS (VALUES {sql_values(T.legendre_rows(NMAX, LAT))}), t(lon, tm, tcs, f) AS (VALUES {sql_values(T.longitude_rows(NMAX, LON))}),
places AS (SELECT DISTINCT lat, lon FROM p, t),
ring AS (SELECT epoch, lat, m, cs, sum(k * v * p) AS a FROM coef JOIN kf ON n = kn JOIN p ON n = pn AND m = pm GROUP BY ALL),
grid AS MATERIALIZED (SELECT epoch, lat, lon, sum(a * f) AS value FROM ring JOIN t ON m = tm AND cs = tcs GROUP BY ALL)"""

_TERMS = {"bias": "1.0::DOUBLE", "trend": f"epoch - {T0}::DOUBLE"} | {f"{f}{k}": f"{f}({TWO_PI} * {k} * (epoch - {T0}::DOUBLE))" for k in (1, 2) for f in ("cos", "sin")}


def fitted_sql(source: str, key: str, wanted: tuple[str, ...], name: str) -> str:
    """CTEs that end in ``name`` (key, the wanted terms' coefficients, their q'q, squares of residuals, epochs).

    A term's coefficient is the data's product with what is left of the term when all others are taken out of it.
    """
    out = []
    for w in wanted:
        terms = [t for t in _TERMS if t != w] + [w]
        out.append(f"{name}_{w}0 AS (SELECT {key} AS key, epoch, v AS res, {', '.join(f'{_TERMS[t]} AS q{i}' for i, t in enumerate(terms))} FROM {source})")
        for i in range(6):
            later = [f"q{j}" for j in range(i + 1, 6)] + ["res"]
            keep = ", sum(q5 * res) OVER w / nullif(sum(q5 * q5) OVER w, 0) AS coef, sum(q5 * q5) OVER w AS qq" if i == 5 else ""
            new = ", ".join(f"{c} - coalesce(sum(q{i} * {c}) OVER w / nullif(sum(q{i} * q{i}) OVER w, 0), 0) * q{i} AS {c}" for c in later)
            out.append(f"{name}_{w}{i + 1} AS (SELECT key, epoch, {new}{keep} FROM {name}_{w}{i} WINDOW w AS (PARTITION BY key))")
        out.append(f"{name}_{w} AS MATERIALIZED (SELECT key, any_value(coef) AS {w}, any_value(qq) AS {w}_qq, sum(res * res) AS rr, count(*) AS t FROM {name}_{w}6 GROUP BY key)")
    joined = " ".join(f"JOIN {name}_{w} USING (key)" for w in wanted[1:])
    first = wanted[0]
    out.append(f"{name} AS (SELECT key, {', '.join(wanted)}, {first}_qq AS qq, {name}_{first}.rr AS rr, {name}_{first}.t AS t FROM {name}_{first} {joined})")
    return ", ".join(out)


@query(f"""WITH {_GRID}, mask AS ({_INSIDE}), s AS (SELECT region AS key, epoch, sum(cos(radians(lat)) * 100 * value) / sum(cos(radians(lat))) AS v FROM grid JOIN mask USING (lat, lon) GROUP BY 1, 2),
{fitted_sql('s', 'key', ('trend', 'cos1', 'sin1'), 'm')} SELECT key AS region, {r('trend / 1e5')} AS trend, {r('sqrt(rr / (t - 6) / qq) / 1e5')} AS trend_sigma, {r('sqrt(cos1 * cos1 + sin1 * sin1) / 1e5')} AS amplitude, {r('atan2(sin1, cos1)')} AS phase FROM m""")
def chain_storage(spark, sf):
    """Water storage of three basins from all sets: polygons, filter, synthesis, means, trend and annual wave."""
    out = P.storage_chain(coef(spark, sf), NMAX, LAT, LON, _rings(spark), KN, "gauss400", T0)
    return rounded(out.select("region", *[(F.col(c) / 1e5).alias(c) for c in ("trend", "trend_sigma", "amplitude")], "phase"))


_LAND = "(lat BETWEEN 15 AND 70 AND lon BETWEEN 95 AND 265)"
_FAR = "2 * 6378.1363::DOUBLE * asin(least(1, sqrt(pow(sin(radians(o.lat - i.lat)/2), 2) + cos(radians(i.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - i.lon)/2), 2)))) <= 1500"
_SEA = f"sea AS MATERIALIZED (SELECT lat, lon FROM places i WHERE NOT {_LAND} AND NOT EXISTS (SELECT 1 FROM places o WHERE {_LAND.replace('lat', 'o.lat').replace('lon', 'o.lon')} AND {_FAR}))"
_AREA = f"(6371e3 * 6371e3 * radians(20) * radians(20) * cos(radians(lat)))"


def _ocean(spark):
    w = lambda a, b: 0.0 if 15 <= a <= 70 and 95 <= b <= 265 else 1.0
    return literal_table(spark, ["lat", "lon", "w"], [(a, b, w(a, b)) for a in LAT for b in LON])


@query(f"""WITH {_GRID}, {_SEA}, s AS (SELECT 'ocean' AS key, epoch, sum(cos(radians(lat)) * value) / sum(cos(radians(lat))) AS v FROM grid JOIN sea USING (lat, lon) GROUP BY epoch),
x AS (SELECT lat || ' ' || lon AS key, epoch, value AS v FROM grid JOIN sea USING (lat, lon)),
{fitted_sql('s', 'key', ('trend', 'cos1', 'sin1'), 'm')}, {fitted_sql('x', 'key', ('trend',), 'px')},
a AS (SELECT sum({_AREA}) AS area FROM sea)
SELECT {r('trend / 1e5', 5)} AS trend_mm, {r('sqrt(m.rr / (m.t - 6) / m.qq) / 1e5', 5)} AS sigma_mm, {r('trend * area * 1000 / 1e12 / 1e8', 4)} AS gt_per_year, {r('sqrt(cos1 * cos1 + sin1 * sin1) / 1e5', 5)} AS amplitude_mm, {r('(SELECT sqrt(median(rr / t)) FROM px) / 1e5', 5)} AS pixel_noise, {r('area / 1e12', 4)} AS area FROM m, a""")
def chain_ocean(spark, sf):
    """Ocean mean of all sets, 1500 km away from land."""
    out = P.ocean_chain(coef(spark, sf), NMAX, LAT, LON, _ocean(spark), KN, 1500.0, "gauss400", T0)
    out = out.select(*[(F.col(c) / 1e8).alias(c) for c in ("trend_mm", "sigma_mm", "amplitude_mm")], (F.col("gt_per_year") / 1e8).alias("gt_per_year"), (F.col("pixel_noise") / 1e5).alias("pixel_noise"), (F.col("area") / 1e12).alias("area"))
    return rounded(out, 5, gt_per_year=4, area=4)


@query(f"""WITH {COEF}, kf(kn, k) AS (VALUES {sql_values(list(enumerate(_EWH)))}), p(lat, pn, pm, p) AS (VALUES {sql_values(T.legendre_rows(NMAX, LAT))}), t(lon, tm, tcs, f) AS (VALUES {sql_values(T.longitude_rows(NMAX, LON))}),
a AS (SELECT * FROM coef WHERE set_id % 2 = 0), b AS (SELECT * FROM coef WHERE set_id % 2 = 1),
x AS (SELECT a.epoch, a.n, a.m, a.cs, a.v + coalesce(b.v, 0) AS v FROM a LEFT JOIN b ON b.set_id = a.set_id + 1 AND a.n = b.n AND a.m = b.m AND a.cs = b.cs),
ring AS (SELECT epoch, lat, m, cs, sum(k * v * p) AS a FROM x JOIN kf ON n = kn JOIN p ON n = pn AND m = pm GROUP BY ALL),
grid AS MATERIALIZED (SELECT epoch, lat, lon, sum(a * f) AS value FROM ring JOIN t ON m = tm AND cs = tcs WHERE NOT {_LAND} GROUP BY ALL),
ref AS (SELECT lat, lon, avg(value) AS ref FROM grid WHERE epoch >= 2005 AND epoch < 2020 GROUP BY 1, 2)
SELECT {r('epoch')} AS epoch, {r('sum(cos(radians(lat)) * 100 * (value - ref)) / sum(cos(radians(lat))) / 1e5')} AS mean, {r('min(100 * (value - ref)) / 1e5')} AS low, {r('max(100 * (value - ref)) / 1e5')} AS high FROM grid JOIN ref USING (lat, lon) GROUP BY epoch""")
def chain_bottom_pressure(spark, sf):
    """Even sets with the odd set that follows as background, over the ocean, against fifteen years."""
    x = coef(spark, sf)
    back = x.where("set_id % 2 = 1").withColumn("epoch", F.col("epoch") - 1 / 12)
    out = P.bottom_pressure_chain(x.where("set_id % 2 = 0"), back, NMAX, LAT, LON, _ocean(spark), KN, 2005.0, 2020.0, "gauss400", 0.02)
    w = F.cos(F.radians("lat"))
    return rounded(out.groupBy("epoch").agg((F.sum(w * F.col("value")) / F.sum(w) / 1e5).alias("mean"), (F.min("value") / 1e5).alias("low"), (F.max("value") / 1e5).alias("high")))


@query()
def chain_ice(spark, sf):
    """Mass trends of three basins with the leakage undone; the noise comes from the rest of the globe."""
    sphere = B.Sphere(NMAX)
    lat, lon = sphere.degrees()
    ocean = literal_table(spark, ["lat", "lon", "w"], [(a, b, float(a < -50)) for a in lat for b in lon])
    out = P.ice_chain(coef(spark, sf), NMAX, _rings(spark), KN, T0, "gauss400", ocean, boxes=[(60.0, 90.0, 0.0, 90.0)], most=100)
    return rounded(out.withColumn("gt_per_year", F.col("gt_per_year") / 1e8), 4)


@query(f"""WITH {COEF}, p(lat, pn, pm, p) AS (VALUES {sql_values(T.legendre_rows(NMAX, LAT))}), t(lon, tm, tcs, f) AS (VALUES {sql_values(T.longitude_rows(NMAX, LON))}), places AS (SELECT DISTINCT lat, lon FROM p, t), mask AS ({_INSIDE}),
ring AS (SELECT set_id, lat, m, cs, sum(v * p) AS a FROM coef JOIN p ON n = pn AND m = pm GROUP BY ALL), grid AS (SELECT set_id, lat, lon, sum(a * f) AS value FROM ring JOIN t ON m = tm AND cs = tcs GROUP BY ALL)
SELECT set_id, region, CAST(count(*) AS BIGINT) AS places, {r('avg(value)')} AS mean, {r('max(value)')} AS high FROM grid JOIN mask USING (lat, lon) GROUP BY 1, 2""")
def polygon_parts_and_holes(spark, sf):
    g = T.synthesis(coef(spark, sf), ["set_id"], NMAX, LAT, LON)
    places = literal_table(spark, ["lat", "lon"], [(a, b) for a in LAT for b in LON])
    j = g.join(B.inside(places, _rings(spark), ["region"]), ["lat", "lon"])
    return rounded(j.groupBy("set_id", "region").agg(F.count("*").alias("places"), F.avg("value").alias("mean"), F.max("value").alias("high")))


_W1000 = special.gaussian_weights(NMAX, 1000.0).tolist()


@query(f"""WITH {COEF}, w(wn, w) AS (VALUES {sql_values(list(enumerate(_W1000)))}),
s AS (SELECT n, m, cs, n || ' ' || m || ' ' || cs AS key, epoch, w * CASE WHEN n = 2 AND m = 0 THEN 0.001::DOUBLE * set_id WHEN n = 3 AND m = 0 AND set_id % 4 <> 0 THEN -0.002::DOUBLE * set_id ELSE v END AS v FROM coef JOIN w ON n = wn),
{fitted_sql('s', 'key', ('trend',), 'm')}, i AS (SELECT DISTINCT key, n, m, cs FROM s)
SELECT n, m, cs, 'trend' AS term, {r('trend', 9)} AS coef, {r('sqrt(rr / (t - 6) / qq)', 9)} AS sigma, {r('rr / (t - 6)', 9)} AS res_var, CAST(t AS BIGINT) AS n_epochs FROM m JOIN i USING (key)""")
def chain_standard(spark, sf):
    """Low degrees replaced, a rate removed, smoothed, then the trend of each coefficient: one plan."""
    x = coef(spark, sf)
    span = x.agg(F.floor((F.min("epoch") - 2002) * 12).alias("lo"), F.ceil((F.max("epoch") - 2002) * 12).alias("hi")).first()
    months = spark.range(span.lo, span.hi + 1) if span.lo is not None else spark.range(0)
    t = months.select((2002 + F.col("id") / 12.0 + 0.01).alias("epoch"), (F.col("id") * 0.001).alias("c20"), F.when(F.col("id") % 4 != 0, F.col("id") * -0.002).alias("c30"))
    x = P.standard_chain(x, NMAX, low_degrees=t, filter_name="gauss1000")
    return rounded(regression.fit(x.select("n", "m", "cs", "epoch", "v"), ["n", "m", "cs"], 2010.0).where("term = 'trend'"), 9)


_ALL_TERMS = tuple(_TERMS)
_NAMES = dict(zip(_ALL_TERMS, regression.STANDARD))


@query(f"""WITH {monthly_sql().replace('monthly AS', 'mo AS')}, s AS (SELECT key, epoch, v FROM mo), {', '.join(fitted_sql('s', 'key', (w,), f'f{k}') for k, w in enumerate(_ALL_TERMS))}
{' UNION ALL '.join(f"SELECT key, '{_NAMES[w]}' AS term, {r(w, 2)} AS coef, {r('CASE WHEN t > 6 THEN sqrt(rr / (t - 6) / qq) END', 2)} AS sigma, {r('CASE WHEN t > 6 THEN rr / (t - 6) END', 2)} AS res_var, CAST(t AS BIGINT) AS n_epochs FROM f{k}" for k, w in enumerate(_ALL_TERMS))}""")
def climatology_terms(spark, sf):
    """All terms with sigmas."""
    return rounded(regression.fit(monthly(spark, sf), ["key"], T0), 2)
