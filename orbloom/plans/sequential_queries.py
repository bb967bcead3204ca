"""Vector Kalman chain, covariance conditioning and correlated simulation over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays, sql_values
from orbloom.operators import combination as C
from orbloom.operators import covariance as V
from orbloom.operators import filters as L
from orbloom.operators import kalman as K
from orbloom.operators import month_filter as M
from orbloom.operators import signal_model as G
from orbloom.operators import tiles as T
from orbloom.operators import transforms as X
from orbloom.operators.stored import numbered, stored
from orbloom.plans.base import COEF, NMAX, coef, query, r, rounded, table
from orbloom.plans.coefficient_queries import KN

T0 = 2010.0


def _noise():
    return 0.02 + 0.5 * F.abs("v")


def _series(spark, sf):
    """Every coefficient as a series of its own: (n, m, cs, t, epoch, x); sets of label 0 count as not observed."""
    x = coef(spark, sf)
    steps = numbered(x.select("epoch"))
    x = x.join(steps, "epoch").withColumn("seen", F.col("label") != 0)
    return x.select("n", "m", "cs", "t", "epoch", F.array("v").alias("x"), F.when(F.col("seen"), F.array("v")).alias("l"), F.when(F.col("seen"), F.array(_noise()**2)).alias("r"))


_FILTER = f"""WITH RECURSIVE {COEF}, z AS MATERIALIZED (
  SELECT n, m, cs, epoch, row_number() OVER (PARTITION BY n, m, cs ORDER BY epoch) - 1 AS t, v, label <> 0 AS seen, pow(0.02::DOUBLE + 0.5::DOUBLE * abs(v), 2) AS rr FROM coef),
c AS (SELECT a.n, a.m, a.cs, sum(a.v * a.v) / count(*) AS c0, count(*) AS t, sum(a.v * b.v) / (count(*) - 1) AS c1
  FROM z a LEFT JOIN z b ON a.n = b.n AND a.m = b.m AND a.cs = b.cs AND b.t = a.t - 1 GROUP BY 1, 2, 3),
g AS MATERIALIZED (SELECT n, m, cs, t - 1 AS last, c0, c1 / c0 AS phi, c0 - c1 / c0 * c1 AS q FROM (SELECT n, m, cs, t, c1, c0 + SHRINK * avg(c0) OVER (PARTITION BY n) AS c0 FROM c)),
y AS MATERIALIZED (SELECT * FROM z JOIN g USING (n, m, cs)),
f AS (
  SELECT n, m, cs, epoch, t, last, phi, CAST(0 AS DOUBLE) AS xp, phi * phi * c0 + q AS pp,
    CASE WHEN seen THEN (phi * phi * c0 + q) / (phi * phi * c0 + q + rr) * v ELSE 0 END AS x,
    CASE WHEN seen THEN (phi * phi * c0 + q) * rr / (phi * phi * c0 + q + rr) ELSE phi * phi * c0 + q END AS p FROM y WHERE t = 0
  UNION ALL
  SELECT y.n, y.m, y.cs, y.epoch, y.t, y.last, y.phi, y.phi * f.x, y.phi * y.phi * f.p + q,
    CASE WHEN seen THEN y.phi * f.x + (y.phi * y.phi * f.p + q) / (y.phi * y.phi * f.p + q + rr) * (v - y.phi * f.x) ELSE y.phi * f.x END,
    CASE WHEN seen THEN (y.phi * y.phi * f.p + q) * rr / (y.phi * y.phi * f.p + q + rr) ELSE y.phi * y.phi * f.p + q END
  FROM f JOIN y ON y.n = f.n AND y.m = f.m AND y.cs = f.cs AND y.t = f.t + 1),
h AS MATERIALIZED (SELECT * FROM f)"""

_SMOOTHED = f""",
s AS (
  SELECT n, m, cs, epoch, t, x, p, xp, pp FROM h WHERE t = last
  UNION ALL
  SELECT h.n, h.m, h.cs, h.epoch, h.t, h.x + h.p * h.phi / s.pp * (s.x - s.xp), h.p + pow(h.p * h.phi / s.pp, 2) * (s.p - s.pp), h.xp, h.pp
  FROM s JOIN h ON h.n = s.n AND h.m = s.m AND h.cs = s.cs AND h.t = s.t - 1)
SELECT n, m, cs, {r('epoch')} AS epoch, {r('x')} AS x, {r('sqrt(p)')} AS sigma FROM s"""

# Smoothed from k later epochs: one step from what the next epoch has from k - 1.
_LAGGED = "".join(f", l{k} AS (SELECT *, coalesce(x + p * phi / lead(pp) OVER w * (lead(x{k - 1}) OVER w - lead(xp) OVER w), x) AS x{k}, coalesce(p + pow(p * phi / lead(pp) OVER w, 2) * (lead(p{k - 1}) OVER w - lead(pp) OVER w), p) AS p{k} FROM {'l' + str(k - 1) if k > 1 else '(SELECT *, x AS x0, p AS p0 FROM h)'} WINDOW w AS (PARTITION BY n, m, cs ORDER BY t))" for k in (1, 2, 3))


@query(_FILTER.replace("SHRINK", "0.0::DOUBLE") + _SMOOTHED)
def kalman_vector_scalar_limit(spark, sf):
    """The vector chain with one coefficient in each state: first-order process, filter over gaps, smoother."""
    x = stored(_series(spark, sf), "coefficient-series")
    model = stored(K.fit_var(x, ["n", "m", "cs"], "x"), "autoregressions")
    out = K.smooth_series(K.filter_series(x, model, ["n", "m", "cs"]), model, ["n", "m", "cs"])
    return rounded(out.select("n", "m", "cs", "epoch", F.col("x")[0].alias("x"), F.col("sigma")[0].alias("sigma")))


@query()
def kalman_chain(spark, sf):
    """All sets smoothed by order and C/S, second-order process from the sets themselves; label 0 is predicted."""
    x = coef(spark, sf)
    obs = x.where("label <> 0").withColumn("s", _noise())
    out, report = K.chain(obs, x, T0, order=2, shrink=0.05, grid=x.select("epoch").distinct(), qc="flag")
    gaps = report.where("block = 0").select("epoch", "gap")
    return rounded(out.join(gaps, "epoch").select("epoch", "n", "m", "cs", "v", "s", "gap"))


@query()
def kalman_chain_report(spark, sf):
    """Innovation test and mean share of the data for every block and epoch, with the failing epochs kept out."""
    x = coef(spark, sf)
    obs = x.where("label <> 0").withColumn("s", _noise())
    return rounded(K.chain(obs, x, T0, shrink=0.05, grid=x.select("epoch").distinct(), qc="reject", alpha=0.05, smoother=False)[1])


@query(_FILTER.replace("SHRINK", "0.1::DOUBLE") + _LAGGED + f" SELECT n, m, cs, {r('epoch')} AS epoch, {r('x3')} AS x, {r('sqrt(p3)')} AS sigma FROM l3")
def kalman_fixed_lag(spark, sf):
    """The coefficients of each degree-and-order pair, smoothed from at most three later epochs."""
    x = stored(_series(spark, sf), "coefficient-series")
    model = stored(K.fit_var(x, ["n", "m", "cs"], "x", shrink=0.1, within=["n"]), "autoregressions")
    out = K.smooth_series(K.filter_series(x, model, ["n", "m", "cs"]), model, ["n", "m", "cs"], lag=3)
    return rounded(out.select("n", "m", "cs", "epoch", F.col("x")[0].alias("x"), F.col("sigma")[0].alias("sigma")))


# --- conditioning, error maps, month operators, correlated draws -----------------------------------------------------



def _hemispheres(lat, lon):
    return np.asarray(lat) >= 0


_COND = T.Conditioner(NMAX, KN, 2000.0, _hemispheres)
_ALL = np.arange(len(_COND.lat))
_FORWARD, _BACK = _COND.forward(_ALL), _COND.back(_ALL)


def _covariance(spark, sf):
    """Products of all sets' coefficients over their number, as entries (row, col, value) in the order of the index."""
    x = table(spark, sf, "embeddings").select(F.lit(0).alias("series"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("x"))
    p = (NMAX + 1) ** 2
    sums = K.lag_products(x, ["series"], "x", 0).where("h = 0")
    return sums.select(F.floor(F.col("i") / p).cast("int").alias("row"), (F.col("i") % p).alias("col"), (F.col("value") / F.col("epochs")).alias("value"))


_COV = f"{COEF}, cov AS MATERIALIZED (SELECT i.pos AS i, j.pos AS j, sum(a.v * b.v) / count(*) AS c FROM coef a JOIN idx i ON a.n = i.n AND a.m = i.m AND a.cs = i.cs JOIN coef b ON a.set_id = b.set_id JOIN idx j ON b.n = j.n AND b.m = j.m AND b.cs = j.cs GROUP BY 1, 2)"
_PLACES = [(k, float(np.degrees(a)), float(np.degrees(b)), float(c)) for k, (a, b, c) in enumerate(zip(_COND.lat, _COND.lon, _COND.region))]


@query(f"""WITH {_COV}, g(a, i, g) AS (VALUES {sql_values([(k, j, float(x)) for (k, j), x in np.ndenumerate(_FORWARD)])}), f(i, a, f) AS (VALUES {sql_values([(k, j, float(x)) for (k, j), x in np.ndenumerate(_BACK)])}),
pl(a, lat, lon, region) AS (VALUES {sql_values(_PLACES)}),
h AS MATERIALIZED (SELECT a, j, sum(g * c) AS h FROM g JOIN cov USING (i) GROUP BY 1, 2),
s AS MATERIALIZED (SELECT h.a, g.a AS b, sum(h * g) AS s FROM h JOIN g ON h.j = g.i GROUP BY 1, 2),
w AS MATERIALIZED (SELECT s.a, s.b, s * CASE WHEN p.region <> q.region THEN 0 WHEN s.a = s.b THEN 1 ELSE exp(-acos(greatest(-1, least(1, sin(radians(p.lat)) * sin(radians(q.lat)) + cos(radians(p.lat)) * cos(radians(q.lat)) * cos(radians(p.lon - q.lon))))) * 6378.1363::DOUBLE / 2000) END AS s FROM s JOIN pl p ON p.a = s.a JOIN pl q ON q.a = s.b),
k AS MATERIALIZED (SELECT f.i, w.b, sum(f * s) AS k FROM f JOIN w USING (a) GROUP BY 1, 2)
SELECT k.i AS row, f.i AS col, {r('sum(k * f)', 8)} AS value FROM k JOIN f ON k.b = f.a WHERE k.i >= f.i GROUP BY 1, 2""")
def covariance_conditioning(spark, sf):
    """The sets' covariance with correlations weakened over distance and cut between hemispheres, tile by tile."""
    tiles = stored(T.from_entries(_covariance(spark, sf), (NMAX + 1) ** 2, 24), "covariance-tiles")
    out = T.entries(T.condition(tiles, _COND, 24), 24).where("row >= col")
    return rounded(out.select("row", F.col("col").cast("int").alias("col"), "value"), 8)


_ELAT, _ELON = [-75.0, -30.0, 0.0, 20.0, 60.0], [0.0, 45.0, 120.0, 300.0]
_B = special.ylm(np.repeat(np.radians(_ELAT), len(_ELON)), np.tile(np.radians(_ELON), len(_ELAT)), *index_arrays(NMAX, 0))
_POINTS = [(_ELAT[k // len(_ELON)], _ELON[k % len(_ELON)], j, float(x)) for (k, j), x in np.ndenumerate(_B)]


@query(f"WITH {_COV}, b(lat, lon, i, b) AS (VALUES {sql_values(_POINTS)}), h AS MATERIALIZED (SELECT lat, lon, j, sum(b * c) AS h FROM b JOIN cov USING (i) GROUP BY 1, 2, 3) SELECT h.lat, h.lon, {r('sqrt(sum(h * b))')} AS sigma FROM h JOIN b ON h.j = b.i AND h.lat = b.lat AND h.lon = b.lon GROUP BY 1, 2")
def error_map(spark, sf):
    """Deviation of the field from the full covariance of its coefficients."""
    tiles = stored(T.from_entries(_covariance(spark, sf), (NMAX + 1) ** 2, 24), "covariance-tiles")
    return rounded(T.error_map(tiles, NMAX, _ELAT, _ELON, size=24, points=8))


@query()
def normal_inverse(spark, sf):
    """The inverse of the sets' loaded product matrix, from a tiled Cholesky factor."""
    e = _covariance(spark, sf).withColumn("value", F.col("value") + F.when(F.col("row") == F.col("col"), 0.02).otherwise(0.0))
    order = (NMAX + 1) ** 2
    out = T.entries(T.inverse(T.from_entries(e, order, 24), order, 24), 24).where("row >= col")
    return rounded(out.select("row", F.col("col").cast("int").alias("col"), "value"))


def _month_operator(spark, sf):
    x = coef(spark, sf)
    mean = x.groupBy("n", "m", "cs").agg(F.avg("v").alias("mv"))
    resid = x.join(mean, ["n", "m", "cs"]).select("set_id", "epoch", "label", "n", "m", "cs", (F.col("v") - F.col("mv")).alias("residual"))
    return resid, stored(M.operator_table(V.block_covariance(resid)), "month-operator")


@query()
def month_operator_transposed(spark, sf):
    """The filter of each set's epoch (its factor grows with the label) applied forward and transposed."""
    resid, op = _month_operator(spark, sf)
    x = resid.withColumnRenamed("residual", "v").withColumn("factor", 0.5 + F.col("label") / 4.0)
    on = ["set_id", "n", "m", "cs"]
    back = M.apply(op, x, ["set_id"], "factor", transpose=True).select(*on, F.col("v").alias("transposed"))
    return rounded(M.apply(op, x, ["set_id"], "factor").join(back, on).select(*on, "v", "sigma", "transposed"))


@query()
def resolution_map(spark, sf):
    """How far each set's filter smears a place of its own."""
    _, op = _month_operator(spark, sf)
    e = table(spark, sf, "embeddings").select("vec_id", ((F.col("vec_id") * 37 % 161) - 80.0).alias("lat"), (F.col("vec_id") * 73 % 360 * 1.0).alias("lon"), (0.5 + F.col("label") / 4.0).alias("factor"))
    out = M.resolution_map(op, e, "factor", reach=60.0)
    return rounded(out.select("vec_id", "km_mean", "km_min", "km_max", "anisotropy"), 3)


@query()
def mc_correlated(spark, sf):
    """Sigma of every product's degree amplitude when coefficients of an order vary together."""
    x = coef(spark, sf)
    mean = x.groupBy("label", "n", "m", "cs").agg(F.avg("v").alias("v"), F.lit(0.0).alias("s"))
    both = x.alias("a").join(x.alias("b"), ["set_id", "m", "cs"]).where("a.n <= b.n").groupBy("m", "cs", F.col("a.n").alias("n1"), F.col("b.n").alias("n2")).agg(F.covar_samp("a.v", "b.v").alias("cov"))
    both = stored(both.withColumn("cov", F.col("cov") + F.when(F.col("n1") == F.col("n2"), 1e-6).otherwise(0.0)), "order-covariance")
    return rounded(C.monte_carlo(mean, lambda d: d.groupBy("sample", "label", "n").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("value")), ["label", "n"], 300, covariance=both))


@query()
def eof_separated(spark, sf):
    """The modes of the coefficients that stand clear of noise, and what is left of each set without them."""
    x = coef(spark, sf).select("epoch", "n", "m", "cs", "v", (1.0 + F.col("n")).alias("w"))
    out, modes, rms = C.separate(x, "epoch", ["n", "m", "cs"], "v", "w")
    sums = out.groupBy("epoch").agg(F.sum(F.col("separated") ** 2).alias("separated"), F.sum(F.col("noise") ** 2).alias("noise"))
    return rounded(sums.select("epoch", "separated", "noise", F.lit(modes).alias("modes"), F.lit(rms).alias("rms")))


_VM = [(float(a), float(w)) for a, w in zip(np.degrees(special.quadrature(NMAX)[0][:: 2 * NMAX + 2]), special.quadrature(NMAX)[2][:: 2 * NMAX + 2])]
_VLON = np.degrees(special.quadrature(NMAX)[1][: 2 * NMAX + 2]).tolist()


def _round(k: int) -> str:
    return f"""w{k} AS (SELECT n, m, cs, c, v, d, v / (v + d) AS w FROM mom JOIN nd USING (n, m, cs) JOIN v{k} USING (n)),
u{k} AS (SELECT n, sum(w * w * c) / (2 * n + 1) AS v FROM w{k} GROUP BY n), v{k + 1} AS (SELECT n, greatest(v, 1e-8 * max(v) OVER ()) AS v FROM u{k})"""


_SIGNAL = f"""{COEF}, res AS MATERIALIZED (SELECT set_id, epoch, n, m, cs, v - avg(v) OVER (PARTITION BY n, m, cs) AS x FROM coef), nd AS (SELECT n, m, cs, 0.2::DOUBLE * var_samp(v) AS d FROM coef GROUP BY 1, 2, 3),
mom AS (SELECT n, m, cs, avg(x * x) AS c FROM res GROUP BY 1, 2, 3), u AS (SELECT n, sum(c) / (2 * n + 1) AS v FROM mom GROUP BY n), v0 AS (SELECT n, greatest(v, 1e-8 * max(v) OVER ()) AS v FROM u), {_round(0)}, {_round(1)}, {_round(2)}"""


def _signal(spark, sf):
    x = coef(spark, sf)
    mean = x.groupBy("n", "m", "cs").agg(F.avg("v").alias("mv"), (0.2 * F.var_samp("v")).alias("cov"))
    resid = x.join(mean, ["n", "m", "cs"]).select("epoch", "n", "m", "cs", (F.col("v") - F.col("mv")).alias("residual"))
    noise = mean.select("m", "cs", F.col("n").alias("n1"), F.col("n").alias("n2"), "cov")
    return resid, *G.iterate(resid, noise, 3)


@query(f"""WITH {_SIGNAL}, p(lat, pn, pm, p) AS (VALUES {sql_values(X.legendre_rows(NMAX, [a for a, _ in _VM]))}), t(lon, tm, tcs, f) AS (VALUES {sql_values(X.longitude_rows(NMAX, _VLON))}), wt(wlat, q) AS (VALUES {sql_values(_VM)}),
ring AS (SELECT epoch, lat, m, cs, sum(w * x * p) AS a FROM res JOIN w2 USING (n, m, cs) JOIN p ON n = pn AND m = pm GROUP BY ALL), g AS (SELECT epoch, lat, lon, sum(a * f) AS value FROM ring JOIN t ON m = tm AND cs = tcs GROUP BY ALL),
d0 AS MATERIALIZED (SELECT lat, lon, avg(value * value) AS d, any_value(q) AS q FROM g JOIN wt ON lat = wlat GROUP BY 1, 2), d1 AS (SELECT lat, lon, q, least(greatest(d / (SELECT sum(q * d) FROM d0), 0.1::DOUBLE), 10.0::DOUBLE) AS d FROM d0)
SELECT {r('lat')} AS lat, {r('lon')} AS lon, {r('d / (SELECT sum(q * d) FROM d1)')} AS d FROM d1""")
def signal_variance_map(spark, sf):
    """Where the filtered sets are strong, after three rounds of filter and degree variances."""
    resid, _, f = _signal(spark, sf)
    filtered = L.block_filter(resid.select("epoch", "n", "m", "cs", F.col("residual").alias("v"), F.lit(0.0).alias("s")), f, ["epoch"])
    return rounded(G.variance_map(filtered, NMAX))


@query(f"WITH {_SIGNAL} SELECT CAST(n AS INTEGER) AS n, {r('v', 9)} AS variance FROM v3")
def signal_rounds(spark, sf):
    from orbloom.functions.index import literal_table

    _, v, _ = _signal(spark, sf)
    return rounded(literal_table(spark, ["n", "variance"], list(v.items())), 9)


@query(f"""WITH {COEF}, b(bn, bias) AS (VALUES {sql_values([(n, float(special.log_chi2_bias(2 * n + 1))) for n in range(1, NMAX + 1)])}), g AS (SELECT epoch, n, sum(v * v) AS a FROM coef WHERE n >= 1 GROUP BY 1, 2),
y AS (SELECT epoch, ln(n::DOUBLE) AS x, 0.5::DOUBLE * ln(a) - bias AS y FROM g JOIN b ON n = bn), f AS (SELECT epoch, exp(regr_intercept(y, x)) AS a, regr_slope(y, x) AS b FROM y GROUP BY 1),
mo AS (SELECT greatest(1, least(12, 1 + CAST(floor((epoch - floor(epoch)) * 12) AS INTEGER))) AS month, median(a) AS a, median(b) AS b, count(*) AS epochs FROM f GROUP BY 1)
SELECT CAST(k AS INTEGER) AS month, {r('coalesce(a, (SELECT median(a) FROM f))')} AS a, {r('coalesce(b, (SELECT median(b) FROM f))')} AS b, CAST(coalesce(epochs, 0) AS BIGINT) AS epochs FROM range(1, 13) t(k) LEFT JOIN mo ON month = k""")
def power_law_by_month(spark, sf):
    spectrum = coef(spark, sf).groupBy("epoch", "n").agg(F.sum(F.col("v") ** 2).alias("variance"))
    return rounded(G.monthly_power_law(spectrum))
