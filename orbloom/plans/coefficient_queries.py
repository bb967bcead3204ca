"""Packing, selection, arithmetic, kernels and spectra over the coefficient sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbloom.functions import scalars, special
from orbloom.functions.index import index_table, literal_table, sql_values
from orbloom.operators import coefficients as C
from orbloom.operators import spectra as S
from orbloom.plans.base import COEF, NMAX, coef, query, r, rounded, table

# Load Love numbers k' and h', l' of degrees 0 to 7 for the kernel queries (rounded model values).
KN = [0.0, 0.027, -0.3054, -0.1960, -0.1340, -0.1047, -0.0903, -0.0821]
HN = [0.0, -0.29, -1.001, -1.052, -1.053, -1.088, -1.147, -1.224]
LN = [0.0, 0.113, 0.0295, 0.0741, 0.0620, 0.0493, 0.0414, 0.0364]
NOUT = "n, m, cs"


@query(f"WITH {COEF} SELECT set_id, {r('epoch')} AS epoch, n, m, cs, {r('v')} AS v FROM coef")
def coef_explode(spark, sf):
    return rounded(coef(spark, sf).select("set_id", "epoch", "n", "m", "cs", "v"))


@query(f"""WITH {COEF} SELECT set_id, {r('sum(v * (pos + 1))')} AS checksum, CAST(count(*) AS BIGINT) AS size
FROM coef JOIN idx USING (n, m, cs) WHERE n <= 6 GROUP BY set_id""")
def coef_pack_roundtrip(spark, sf):
    """Packs the sets without their highest degree into vectors and unpacks them again."""
    x = C.pack(C.truncate(coef(spark, sf), 6), ["set_id"], NMAX)
    back = C.unpack(x, "x", NMAX).join(F.broadcast(index_table(spark, NMAX, 0)), C.KEY)
    return rounded(back.where("n <= 6").groupBy("set_id").agg(F.sum(F.col("v") * (F.col("pos") + 1)).alias("checksum"), F.count("*").alias("size")))


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('v')} AS v FROM coef WHERE n <= 3")
def truncate(spark, sf):
    return rounded(C.truncate(coef(spark, sf), 3).select("set_id", "n", "m", "cs", "v"))


@query(f"WITH {COEF} SELECT set_id, {r('epoch')} AS epoch, CAST(count(*) AS BIGINT) AS size FROM coef WHERE epoch BETWEEN 2010 AND 2014 GROUP BY 1, coef.epoch")
def select_range(spark, sf):
    return rounded(C.select_epochs(coef(spark, sf), 2010, 2014).groupBy("set_id", "epoch").agg(F.count("*").alias("size")))


@query(f"""WITH {COEF}, holes AS (SELECT set_id, n, m, cs, CASE WHEN v > 0.35 THEN NULL ELSE v END AS v FROM coef)
SELECT set_id, CAST(count(*) AS BIGINT) AS size, {r('sum(v)')} AS total FROM holes
WHERE set_id NOT IN (SELECT set_id FROM holes WHERE v IS NULL) GROUP BY set_id""")
def drop_nonfinite(spark, sf):
    """Values above 0.35 count as missing; sets with one go."""
    x = coef(spark, sf).withColumn("v", F.when(F.col("v") > 0.35, F.lit(float("nan"))).otherwise(F.col("v")))
    return rounded(C.drop_incomplete(x, ["set_id"]).groupBy("set_id").agg(F.count("*").alias("size"), F.sum("v").alias("total")))


@query(f"WITH {COEF} SELECT set_id, m, cs, {r('v')} AS v FROM coef WHERE n = 5")
def degree_filter(spark, sf):
    return rounded(coef(spark, sf).where("n = 5").select("set_id", "m", "cs", "v"))


@query(f"""WITH {COEF} SELECT set_id, n, m, cs, {r("CASE WHEN n = 2 AND m = 1 THEN CASE WHEN cs = 0 THEN 0.25::DOUBLE ELSE -0.5::DOUBLE END ELSE v END")} AS v,
{r("CASE WHEN n = 2 AND m = 1 THEN 0.125::DOUBLE ELSE s END")} AS s FROM coef WHERE n = 2""")
def set_coefficient(spark, sf):
    return rounded(C.set_coefficient(coef(spark, sf), 2, 1, 0.25, -0.5, 0.125).where("n = 2").select("set_id", "n", "m", "cs", "v", "s"))


def _pair(sign: str, op: str) -> str:
    return f"""WITH {COEF} SELECT a.set_id, a.n, a.m, a.cs, {r(f'a.v {op} b.v')} AS v, {r('sqrt(a.s * a.s + b.s * b.s)')} AS s
FROM coef a JOIN coef b ON b.set_id = a.set_id + 1 AND a.n = b.n AND a.m = b.m AND a.cs = b.cs WHERE a.set_id % 2 = 0"""


def _pairs(spark, sf):
    x = coef(spark, sf)
    return x.where("set_id % 2 = 0"), x.where("set_id % 2 = 1").withColumn("set_id", F.col("set_id") - 1)


@query(_pair("+", "+"))
def coef_add_rss(spark, sf):
    a, b = _pairs(spark, sf)
    return rounded(C.combine(a, b, ["set_id", *C.KEY]).select("set_id", "n", "m", "cs", "v", "s"))


@query(_pair("-", "-"))
def coef_diff(spark, sf):
    a, b = _pairs(spark, sf)
    return rounded(C.combine(a, b, ["set_id", *C.KEY], -1).select("set_id", "n", "m", "cs", "v", "s"))


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('v * -2.5::DOUBLE')} AS v, {r('s * 2.5::DOUBLE')} AS s FROM coef")
def coef_scale(spark, sf):
    return rounded(C.scale(coef(spark, sf), -2.5).select("set_id", "n", "m", "cs", "v", "s"))


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('v / (1 + n + m)')} AS v FROM coef")
def elementwise_weight(spark, sf):
    w = literal_table(spark, ["n", "m", "w"], [(n, m, 1 / (1 + n + m)) for n in range(NMAX + 1) for m in range(n + 1)])
    return rounded(C.weight(coef(spark, sf), w, ["n", "m"]).select("set_id", "n", "m", "cs", "v"))


@query(f"WITH {COEF} SELECT set_id, n, m, cs, {r('v * (3.986004415e14::DOUBLE / 3.986004418e14::DOUBLE) * pow(6378136.3::DOUBLE / 6378137.0::DOUBLE, n)', 9)} AS v FROM coef")
def rescale_gmr(spark, sf):
    d = special.ELLIPSOIDS["WGS84"]
    return rounded(C.rescale(coef(spark, sf), special.GM_EARTH, special.R_EARTH, d["gm"], d["a"]).select("set_id", "n", "m", "cs", "v"), 9)


def _zonals() -> list[tuple[int, float]]:
    d = special.ELLIPSOIDS["WGS84"]
    z = special.normal_field(NMAX) * (d["gm"] / special.GM_EARTH) * (d["a"] / special.R_EARTH) ** np.arange(NMAX + 1)
    return list(enumerate(z))


@query(f"""WITH {COEF}, z(zn, z) AS (VALUES {sql_values(_zonals())})
SELECT set_id, n, {r('v - z')} AS v FROM coef JOIN z ON n = zn WHERE m = 0""")
def normal_field_subtract(spark, sf):
    return rounded(C.subtract_normal_field(coef(spark, sf), NMAX).where("m = 0").select("set_id", "n", "v"))


def _kernel_query(name: str, factors, digits: int):
    rows = [(n, float(x)) for n, x in enumerate(factors)]
    sql = f"WITH {COEF}, k(kn, w) AS (VALUES {sql_values(rows)}) SELECT set_id, n, m, cs, {r('v * w', digits)} AS v FROM coef JOIN k ON n = kn"

    def run(spark, sf):
        return rounded(C.apply_kernel(coef(spark, sf), factors).select("set_id", "n", "m", "cs", "v"), digits)

    run.__name__ = name
    return query(sql)(run)


# Factors scaled to order one, so that rounding is alike in both engines.
for _name, _quantity, _unit, _height in (
    ("kernel_ewh", "ewh", 1e-7, 0.0), ("kernel_geoid", "geoid", 1e-6, 0.0), ("kernel_potential", "potential", 1e-7, 450e3), ("kernel_gravity_anomaly", "gravity_anomaly", 1.0, 0.0),
    ("kernel_gravity_disturbance", "gravity_disturbance", 1.0, 450e3), ("kernel_gravity_gradient", "gravity_gradient_rr", 1e6, 0.0), ("kernel_surface_density", "surface_density", 1e-10, 0.0),
    ("kernel_bottom_pressure", "bottom_pressure", 1e-11, 0.0), ("kernel_deformation_up", "deformation_up", 1e-6, 0.0), ("kernel_none", "none", 1.0, 0.0),
):
    _kernel_query(_name, special.kernel_factors(_quantity, NMAX, kn=KN, hn=HN, height=_height) * _unit, 6)


@query("""WITH p AS (SELECT n_nationkey AS a_id, CASE n_nationkey % 4 WHEN 0 THEN 'GSM' WHEN 1 THEN 'GAD' WHEN 2 THEN 'GAA' ELSE 'EWH' END AS a,
CASE n_nationkey % 5 WHEN 0 THEN 'GSM' WHEN 1 THEN 'GAD' WHEN 2 THEN 'GAB' WHEN 3 THEN 'EWH' ELSE 'GAC' END AS b FROM nation)
SELECT a_id, a, b, CASE WHEN a = b THEN a WHEN a = 'GSM' AND b IN ('GAA','GAB','GAC','GAD') THEN a || '+' || b ELSE 'combined' END AS product FROM p""")
def product_algebra(spark, sf):
    k = F.col("n_nationkey")
    a = F.element_at(F.array(*map(F.lit, ("GSM", "GAD", "GAA", "EWH"))), (k % 4 + 1).cast("int"))
    b = F.element_at(F.array(*map(F.lit, ("GSM", "GAD", "GAB", "EWH", "GAC"))), (k % 5 + 1).cast("int"))
    return table(spark, sf, "nation").select(k.alias("a_id"), a.alias("a"), b.alias("b")).withColumn("product", scalars.combined_product(F.col("a"), F.col("b"), "+"))


def _spectrum_sql(by: str) -> str:
    return f"""WITH {COEF}, g AS (SELECT set_id, {by}, sum(v * v) AS a, sum(s * s) AS e FROM coef GROUP BY 1, 2)
SELECT set_id, {by}, {r('a')} AS variance, {r('sqrt(a)')} AS rms, {r('6378136.3::DOUBLE * sqrt(a)', 2)} AS amplitude,
{r(f'6378136.3::DOUBLE * sqrt(sum(a) OVER (PARTITION BY set_id ORDER BY {by}))', 2)} AS cumulative,
{r('6378136.3::DOUBLE * sqrt(e)', 2)} AS error_amplitude,
{r(f'6378136.3::DOUBLE * sqrt(sum(e) OVER (PARTITION BY set_id ORDER BY {by}))', 2)} AS error_cumulative FROM g"""


@query(_spectrum_sql("n"))
def degree_rms(spark, sf):
    return rounded(S.degree_spectrum(coef(spark, sf), ["set_id"]), 2, variance=6, rms=6)


@query(_spectrum_sql("m"))
def order_rms(spark, sf):
    return rounded(S.order_spectrum(coef(spark, sf), ["set_id"]), 2, variance=6, rms=6)


@query(f"""WITH {COEF}, g AS (SELECT label, n, avg(v * v) AS a FROM coef GROUP BY 1, 2)
SELECT label, n, {r('sum(a) OVER (PARTITION BY label ORDER BY n)')} AS cumulative FROM g""")
def degree_cumulative(spark, sf):
    from pyspark.sql import Window as W

    g = coef(spark, sf).groupBy("label", "n").agg(F.avg(F.col("v") * F.col("v")).alias("a"))
    return rounded(g.select("label", "n", F.sum("a").over(W.partitionBy("label").orderBy("n")).alias("cumulative")))


_DIFF = f"""WITH {COEF}, d AS (SELECT a.set_id, a.n, sqrt(sum(a.v * a.v)) AS amp1, sqrt(sum(b.v * b.v)) AS amp2, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS diff,
sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 0) AS corr
FROM coef a JOIN coef b ON b.set_id = a.set_id + 1 AND a.n = b.n AND a.m = b.m AND a.cs = b.cs WHERE a.set_id % 2 = 0 GROUP BY 1, 2)"""


@query(f"{_DIFF} SELECT set_id, n, {r('amp1')} AS amp1, {r('amp2')} AS amp2, {r('diff')} AS diff, {r('corr')} AS corr FROM d")
def diff_spectrum(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("set_id"), F.col("embedding").alias("x"))
    odd = x.where("set_id % 2 = 1").select((F.col("set_id") - 1).alias("set_id"), "x")
    return rounded(S.difference_spectrum_packed(x.where("set_id % 2 = 0"), odd, ["set_id"], NMAX))


@query(f"{_DIFF} SELECT set_id, CAST(min(CASE WHEN n >= 2 AND diff > amp1 THEN n END) AS INTEGER) AS first_degree FROM d GROUP BY set_id")
def degree_first_difference(spark, sf):
    a, b = _pairs(spark, sf)
    d = S.difference_spectrum(a, b, ["set_id", *C.KEY], ["set_id"])
    return S.first_above(d, ["set_id"], (F.col("n") >= 2) & (F.col("diff") > F.col("amp1")))


@query(f"{_DIFF} SELECT n, {r('avg(corr)')} AS mean_corr, {r('max(corr)')} AS max_corr FROM d WHERE n > 0 GROUP BY n")
def degree_correlation(spark, sf):
    a, b = _pairs(spark, sf)
    d = S.difference_spectrum(a, b, ["set_id", *C.KEY], ["set_id"]).where("n > 0")
    return rounded(d.groupBy("n").agg(F.avg("corr").alias("mean_corr"), F.max("corr").alias("max_corr")))


@query(f"""WITH {COEF}, g AS (SELECT set_id, n, sqrt(sum(v * v)) AS a, 0.05::DOUBLE * (n + 1) AS e FROM coef WHERE n >= 1 GROUP BY 1, 2),
d AS (SELECT set_id, n, ln(e) - ln(a) AS d FROM g),
l AS (SELECT *, lag(d) OVER w AS d0, lag(n) OVER w AS n0 FROM d WINDOW w AS (PARTITION BY set_id ORDER BY n)),
f AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n) AS k FROM l WHERE d > 0)
SELECT s.set_id, f.n AS crossover, {r('CASE WHEN d0 <= 0 THEN n0 + (n - n0) * (-d0) / (d - d0) END')} AS crossover_exact
FROM (SELECT DISTINCT set_id FROM g) s LEFT JOIN f ON f.set_id = s.set_id AND k = 1""")
def crossover(spark, sf):
    """Where an error of 0.05 (n + 1) overtakes the signal."""
    x = coef(spark, sf).where("n >= 1").groupBy("set_id", "n").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("amplitude"))
    return rounded(S.crossover(x.withColumn("error_amplitude", 0.05 * (F.col("n") + 1)), ["set_id"]))


_BIAS = [(n, float(special.log_chi2_bias(2 * n + 1))) for n in range(2, NMAX + 1)]


@query(f"""WITH {COEF}, b(bn, bias) AS (VALUES {sql_values(_BIAS)}), g AS (SELECT set_id, n, sum(v * v) AS a FROM coef GROUP BY 1, 2),
y AS (SELECT set_id, ln(n::DOUBLE) AS x, 0.5::DOUBLE * ln(a) - bias AS y FROM g JOIN b ON n = bn)
SELECT set_id, {r('exp(regr_intercept(y, x))')} AS a, {r('regr_slope(y, x)')} AS b FROM y GROUP BY set_id""")
def kaula_loglog_fit(spark, sf):
    bias = literal_table(spark, ["n", "bias"], _BIAS)
    return rounded(S.kaula_fit(S.degree_spectrum(coef(spark, sf), ["set_id"]), bias, ["set_id"]))


@query(f"WITH {COEF} SELECT label, CAST(count(DISTINCT epoch) AS BIGINT) AS n_epochs, CAST(max(n) AS INTEGER) AS nmax, {r('min(epoch)')} AS first, {r('max(epoch)')} AS last FROM coef GROUP BY label")
def series_summary(spark, sf):
    x = coef(spark, sf)
    return rounded(x.groupBy("label").agg(F.countDistinct("epoch").alias("n_epochs"), F.max("n").alias("nmax"), F.min("epoch").alias("first"), F.max("epoch").alias("last")))
