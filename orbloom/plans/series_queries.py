"""Aggregates, time joins, regression and ordered operators over series made from the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.functions.index import literal_table, sql_values
from orbloom.functions.scalars import month_epoch
from orbloom.operators import nearest as N
from orbloom.operators import regression as R
from orbloom.operators import statistics as A
from orbloom.operators import windows as O
from orbloom.plans.base import COEF, coef, monthly, monthly_sql, query, r, rounded, table

MONTHLY = monthly_sql()
TWO_PI = "6.283185307179586::DOUBLE"
T0 = 1998.0


# --- aggregates ----------------------------------------------------------------------------------------------------


@query(f"WITH {COEF} SELECT label, n, m, cs, {r('avg(v)')} AS v, {r('CASE WHEN count(v) >= 2 THEN stddev_samp(v) / sqrt(count(v)) END')} AS s, CAST(count(v) AS BIGINT) AS n_valid FROM coef GROUP BY 1, 2, 3, 4")
def mean_field_se(spark, sf):
    return rounded(A.mean_field(coef(spark, sf), ["label", "n", "m", "cs"]))


@query(f"""WITH e AS (SELECT label, 2002 + vec_id / 12.0::DOUBLE AS epoch FROM embeddings), g AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY label ORDER BY epoch) AS gap FROM e WHERE epoch BETWEEN 2005 AND 2025)
SELECT label, CAST(count(*) AS BIGINT) AS n, {r('median(gap)')} AS spacing, {r('least(1.0::DOUBLE, count(*) * median(gap) / 20)')} AS coverage, {r('max(gap)')} AS widest_gap, {r('avg(epoch) - 2015')} AS centroid_offset FROM g GROUP BY label""")
def window_mean(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (2002 + F.col("vec_id") / 12.0).alias("epoch"))
    return rounded(A.window_info(e, 2005, 2025, ["label"]))


@query(f"""WITH x AS (SELECT c_mktsegment AS seg, c_acctbal AS x FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY x) AS k, count(*) OVER (PARTITION BY seg) AS n, lead(x) OVER (PARTITION BY seg ORDER BY x) AS nx FROM x),
a AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, n * 98 / 100.0::DOUBLE + 0.5::DOUBLE)) AS place FROM o)
SELECT seg, {r('x + (place - k) * (coalesce(nx, x) - x)', 4)} AS percentile FROM a WHERE k = floor(place)""")
def hazen_percentile(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return rounded(A.hazen_percentile(c, ["seg"], "c_acctbal", 98), 4)


@query(f"""WITH x AS (SELECT l_returnflag AS flag, l_quantity / 50 AS a, l_discount * 10 AS b, 1 + l_tax AS w FROM lineitem),
s AS (SELECT flag, sum(w) AS w, sum(w*a)/sum(w) AS a, sum(w*b)/sum(w) AS b, sum(w*a*a)/sum(w) AS aa, sum(w*b*b)/sum(w) AS bb, sum(w*a*b)/sum(w) AS ab FROM x GROUP BY 1)
SELECT flag, {r('a - b')} AS bias, {r('sqrt(aa + bb - 2*ab)')} AS rmsd, {r('sqrt(aa + bb - 2*ab - (a-b)*(a-b))')} AS crmsd, {r('(ab - a*b) / sqrt((aa - a*a) * (bb - b*b))')} AS corr, {r('sqrt((aa - a*a) / (bb - b*b))')} AS std_ratio FROM s""")
def weighted_bias_rmsd_corr(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (1 + F.col("l_tax")).alias("w"))
    return rounded(A.weighted_agreement(x, ["flag"], "a", "b", F.col("w")))


@query(f"""SELECT l_linestatus AS status, {r('1 - sum((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)) / (sum(l_extendedprice * l_extendedprice) - sum(l_extendedprice) * sum(l_extendedprice) / count(*))')} AS nse FROM lineitem GROUP BY 1""")
def nash_sutcliffe(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), "l_extendedprice", (1500 * F.col("l_quantity")).alias("model"))
    return rounded(A.nash_sutcliffe(x, ["status"], "l_extendedprice", "model"))


@query(f"""WITH {COEF}, w AS (SELECT set_id, max(CASE WHEN n = 1 AND m = 0 THEN v END) AS a, max(CASE WHEN n = 1 AND m = 1 AND cs = 0 THEN v END) AS b, max(CASE WHEN n = 1 AND m = 1 AND cs = 1 THEN v END) AS c FROM coef GROUP BY 1),
d AS (SELECT var_samp(a - b) AS ab, var_samp(a - c) AS ac, var_samp(b - c) AS bc FROM w), v AS (SELECT (ab + ac - bc)/2 AS var1, (ab + bc - ac)/2 AS var2, (ac + bc - ab)/2 AS var3 FROM d)
SELECT {r('var1')} AS var1, {r('var2')} AS var2, {r('var3')} AS var3, {r('sqrt(greatest(var1, 0))')} AS sigma1, {r('sqrt(greatest(var2, 0))')} AS sigma2, {r('sqrt(greatest(var3, 0))')} AS sigma3 FROM v""")
def three_cornered_hat(spark, sf):
    def pick(m, cs):
        return F.max(F.when((F.col("n") == 1) & (F.col("m") == m) & (F.col("cs") == cs), F.col("v")))

    w = coef(spark, sf).where("n = 1").groupBy("set_id").agg(pick(0, 0).alias("a"), pick(1, 0).alias("b"), pick(1, 1).alias("c"))
    return rounded(A.three_cornered_hat(w, "a", "b", "c"))


_EFF = f"""WITH {COEF}, p AS (SELECT label, epoch, max(CASE WHEN m = 0 THEN v END) AS a, max(CASE WHEN m = 1 AND cs = 0 THEN v END) AS b FROM coef WHERE n = 1 GROUP BY label, set_id, epoch),
c AS (SELECT label, epoch, a - avg(a) OVER (PARTITION BY label) AS a, b - avg(b) OVER (PARTITION BY label) AS b FROM p),
l AS (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY epoch) AS pa, lag(b) OVER (PARTITION BY label ORDER BY epoch) AS pb FROM c),
t AS (SELECT label, count(*) AS n, sum(a*b) / sqrt(sum(a*a) * sum(b*b)) AS r, sum(a*pa)/sum(a*a) * (sum(b*pb)/sum(b*b)) AS q FROM l GROUP BY 1),
e AS (SELECT *, greatest(4.0::DOUBLE, least(n::DOUBLE, n * (1 - q) / (1 + q))) AS n_eff FROM t WHERE n >= 8)"""


def _two_series(spark, sf):
    x = coef(spark, sf).where("n = 1").groupBy("label", "set_id", "epoch")
    return x.agg(F.max(F.when(F.col("m") == 0, F.col("v"))).alias("a"), F.max(F.when((F.col("m") == 1) & (F.col("cs") == 0), F.col("v"))).alias("b"))


@query(f"{_EFF} SELECT label, CAST(n AS BIGINT) AS n, {r('r')} AS r, {r('n_eff', 5)} AS n_eff, {r('r * sqrt((n_eff - 2) / greatest(1 - r*r, 2.220446049250313e-16))')} AS t FROM e")
def effective_n(spark, sf):
    return rounded(A.effective_correlation(_two_series(spark, sf), ["label"], "epoch", "a", "b"), n_eff=5)


@query()
def effective_correlation_p(spark, sf):
    """The same with the two-sided p value, which needs the incomplete beta function."""
    return rounded(A.with_p_value(A.effective_correlation(_two_series(spark, sf), ["label"], "epoch", "a", "b")), n_eff=5)


@query(f"""WITH {COEF}, p AS (SELECT label, epoch, v FROM coef WHERE n = 2 AND m = 0), c AS (SELECT label, epoch, v - avg(v) OVER (PARTITION BY label) AS x FROM p), l AS (SELECT *, lag(x) OVER (PARTITION BY label ORDER BY epoch) AS y FROM c)
SELECT label, {r('sum(x*y)/sum(x*x)')} AS r1 FROM l GROUP BY label""")
def lag1_autocorrelation(spark, sf):
    return rounded(A.lag1_correlation(coef(spark, sf).where("n = 2 AND m = 0"), ["label"], "epoch", "v"))


@query(f"""WITH m AS (SELECT p_brand AS brand, median(p_retailprice) AS med FROM part GROUP BY 1)
SELECT brand, {r('1.4826::DOUBLE * median(abs(p_retailprice - med))', 4)} AS sigma FROM part JOIN m ON brand = p_brand GROUP BY 1""")
def mad_sigma(spark, sf):
    return rounded(A.mad_sigma(table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_retailprice"), ["brand"], "p_retailprice"), 4)


# --- joins on time -------------------------------------------------------------------------------------------------


def _background(spark, sf):
    """Every third set, 0.01 years late, serves as the background."""
    x = coef(spark, sf)
    return x.where("set_id % 3 = 0").withColumn("epoch", F.col("epoch") + 0.01)


_NEAR = f"""WITH {COEF}, b AS (SELECT DISTINCT set_id, epoch + 0.01::DOUBLE AS epoch FROM coef WHERE set_id % 3 = 0), e AS (SELECT DISTINCT set_id, epoch FROM coef),
c AS (SELECT e.set_id, b.set_id AS b_id, row_number() OVER (PARTITION BY e.set_id ORDER BY abs(e.epoch - b.epoch), b.epoch) AS k FROM e JOIN b ON abs(e.epoch - b.epoch) <= 0.08::DOUBLE),
m AS (SELECT set_id, b_id FROM c WHERE k = 1)"""


def _sets(spark, sf):
    """The sets of both sides, from the packed table."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("set_id"), (2002 + F.col("vec_id") / 12.0).alias("epoch"))
    return {"sets": e, "back": e.where("set_id % 3 = 0").withColumn("epoch", F.col("epoch") + 0.01)}


@query(f"{_NEAR} SELECT x.set_id, x.n, x.m, x.cs, {r('x.v + y.v')} AS v FROM coef x JOIN m USING (set_id) JOIN coef y ON y.set_id = b_id AND x.n = y.n AND x.m = y.m AND x.cs = y.cs")
def nearest_epoch_restore(spark, sf):
    return rounded(N.add_background(coef(spark, sf), _background(spark, sf), 0.08, **_sets(spark, sf)).select("set_id", "n", "m", "cs", "v"))


@query(f"{_NEAR.replace('0.08', '0.05')} SELECT x.set_id, x.n, x.m, x.cs, {r('x.v + coalesce(y.v, 0)')} AS v FROM coef x LEFT JOIN m USING (set_id) LEFT JOIN coef y ON y.set_id = b_id AND x.n = y.n AND x.m = y.m AND x.cs = y.cs")
def nearest_allow_missing(spark, sf):
    return rounded(N.add_background(coef(spark, sf), _background(spark, sf), 0.05, True, **_sets(spark, sf)).select("set_id", "n", "m", "cs", "v"))


def _records(spark, sf):
    """Numbers of correction records that span the epochs of the input: one every two months."""
    last = table(spark, sf, "embeddings").agg(F.coalesce(F.max("vec_id"), F.lit(-2))).first()[0]
    return spark.range(last // 2 + 1)


_TN = """t AS (SELECT 2002 + (k * 2) / 12.0::DOUBLE + 0.02::DOUBLE AS epoch, k * 0.001::DOUBLE AS c20, CASE WHEN k % 4 = 0 THEN NULL ELSE k * -0.002::DOUBLE END AS c30 FROM (SELECT unnest(range(0, (SELECT max(vec_id) // 2 + 1 FROM embeddings))) AS k))"""


@query(f"""WITH {COEF}, {_TN}, e AS (SELECT DISTINCT set_id, epoch FROM coef), c AS (SELECT e.set_id, c20, c30, row_number() OVER (PARTITION BY e.set_id ORDER BY abs(e.epoch - t.epoch), t.epoch) AS k FROM e JOIN t ON abs(e.epoch - t.epoch) <= 0.05::DOUBLE)
SELECT set_id, n, m, cs, {r('CASE WHEN n = 2 AND m = 0 THEN coalesce(c20, v) WHEN n = 3 AND m = 0 THEN coalesce(c30, v) ELSE v END')} AS v FROM coef JOIN c USING (set_id) WHERE k = 1 AND n IN (2, 3)""")
def tn_replace(spark, sf):
    """C20 and C30 from the nearest record of a table; a missing C30 keeps the old one."""
    t = _records(spark, sf).select((2002 + (F.col("id") * 2) / 12.0 + 0.02).alias("epoch"), (F.col("id") * 0.001).alias("c20"), F.when(F.col("id") % 4 != 0, F.col("id") * -0.002).alias("c30"))
    x = N.replace_low_degrees(coef(spark, sf), t, 0.05, {(2, 0, 0): "c20", (3, 0, 0): "c30"})
    return rounded(x.where("n IN (2, 3)").select("set_id", "n", "m", "cs", "v"))


@query(f"""WITH {COEF}, {_TN}, e AS (SELECT DISTINCT set_id, epoch FROM coef), c AS (SELECT e.set_id, c20, c30, row_number() OVER (PARTITION BY e.set_id ORDER BY abs(e.epoch - t.epoch), t.epoch) AS k FROM e JOIN t ON abs(e.epoch - t.epoch) <= 0.05::DOUBLE)
SELECT set_id, m, cs, {r('CASE WHEN m = 0 THEN c20 WHEN cs = 0 THEN c20 * 2 ELSE coalesce(c30, v) END')} AS v FROM coef JOIN c USING (set_id) WHERE k = 1 AND n = 1""")
def degree1_replace(spark, sf):
    """Degree 1 from the nearest record of a geocentre table."""
    t = _records(spark, sf).select((2002 + (F.col("id") * 2) / 12.0 + 0.02).alias("epoch"), (F.col("id") * 0.001).alias("c10"), (F.col("id") * 0.001 * 2).alias("c11"), F.when(F.col("id") % 4 != 0, F.col("id") * -0.002).alias("s11"))
    x = N.replace_low_degrees(coef(spark, sf), t, 0.05, {(1, 0, 0): "c10", (1, 1, 0): "c11", (1, 1, 1): "s11"})
    return rounded(x.where("n = 1").select("set_id", "m", "cs", "v"))


@query(f"""WITH s AS (SELECT min(year(l_shipdate) + (month(l_shipdate) - 0.5::DOUBLE)/12) + 0.2::DOUBLE AS lo, max(year(l_shipdate) + (month(l_shipdate) - 0.5::DOUBLE)/12) - 0.7::DOUBLE AS hi FROM lineitem), {MONTHLY}
SELECT key, {r('epoch')} AS epoch, {r('v', 2)} AS v FROM monthly, s WHERE epoch BETWEEN lo AND hi""")
def coverage_drop(spark, sf):
    """Months within the span of the other table, narrowed at both ends."""
    span = table(spark, sf, "lineitem").select(month_epoch(F.col("l_shipdate")).alias("epoch")).agg((F.min("epoch") + 0.25).alias("lo"), (F.max("epoch") - 0.75).alias("hi"))
    ends = span.select(F.explode(F.array("lo", "hi")).alias("epoch"))
    return rounded(N.covered(monthly(spark, sf), ends, 0.05), 2, epoch=6)


_TERMS = [("a", "const", 1.5, 1990.0, 1998.0, None), ("a", "const", 2.5, 1998.0, 2010.0, None), ("a", "trnd", 0.25, 1990.0, 1998.0, None), ("a", "acos", 0.75, 1990.0, 2010.0, 1.0), ("b", "asin", 0.5, 1996.0, 2000.0, 0.5), ("b", "trnd", -0.125, 1996.0, 2010.0, None)]


@query(f"""WITH t(key, kind, value, t0, t1, period) AS (VALUES {sql_values(_TERMS)}), e AS (SELECT DISTINCT year(o_orderdate) + (month(o_orderdate) - 0.5::DOUBLE)/12 AS epoch FROM orders)
SELECT {r('epoch')} AS epoch, key, {r(f"sum(value * CASE kind WHEN 'trnd' THEN epoch - t0 WHEN 'acos' THEN cos({TWO_PI} * (epoch - t0) / period) WHEN 'asin' THEN sin({TWO_PI} * (epoch - t0) / period) ELSE 1 END)")} AS value
FROM e JOIN t ON epoch >= t0 AND epoch < t1 GROUP BY e.epoch, key""")
def interval_terms(spark, sf):
    e = table(spark, sf, "orders").select(month_epoch(F.col("o_orderdate")).alias("epoch")).distinct()
    return rounded(N.evaluate_terms(e, literal_table(spark, ["key", "kind", "value", "t0", "t1", "period"], _TERMS)))


@query(f"""WITH e AS (SELECT label, 2002 + vec_id / 12.0::DOUBLE AS epoch FROM embeddings), a AS (SELECT epoch FROM e WHERE label = 0),
x AS (SELECT a.epoch, b.epoch AS s1, row_number() OVER (PARTITION BY a.epoch ORDER BY abs(a.epoch - b.epoch), b.epoch) AS k FROM a JOIN e b ON b.label = 1 AND abs(a.epoch - b.epoch) <= 0.4::DOUBLE),
y AS (SELECT a.epoch, b.epoch AS s2, row_number() OVER (PARTITION BY a.epoch ORDER BY abs(a.epoch - b.epoch), b.epoch) AS k FROM a JOIN e b ON b.label = 2 AND abs(a.epoch - b.epoch) <= 0.4::DOUBLE)
SELECT {r('x.epoch')} AS epoch, {r('s1')} AS s1_epoch, {r('s2')} AS s2_epoch FROM x JOIN y ON x.epoch = y.epoch AND x.k = 1 AND y.k = 1""")
def common_epochs(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (2002 + F.col("vec_id") / 12.0).alias("epoch"))
    return rounded(N.common_epochs([e.where(F.col("label") == k).select("epoch") for k in range(3)], 0.4))


@query("""WITH m AS (SELECT strftime(d, '%Y-%m') AS month FROM range(DATE '1995-01-01', DATE '2003-01-01', INTERVAL 1 MONTH) r(d))
SELECT month FROM m WHERE month NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders)""")
def anti_missing_months(spark, sf):
    from orbloom.operators.catalogue import months

    wanted = spark.range(1).select(F.explode(months("1995-01", "2002-12")).alias("month"))
    return N.missing_from(wanted, table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")), ["month"])


# --- regression ----------------------------------------------------------------------------------------------------

_BASIS = ["1.0::DOUBLE", f"epoch - {T0}::DOUBLE", *[f"{f}({TWO_PI} * {k} * (epoch - {T0}::DOUBLE))" for k in (1, 2) for f in ("cos", "sin")]]


def _chain(last: str = "residual") -> str:
    """Modified Gram-Schmidt over windows: each step takes one basis function out of the later ones and the data."""
    n = len(_BASIS)
    ctes = [f"g0 AS (SELECT key, epoch, v, v AS res, {', '.join(f'{b} AS q{i}' for i, b in enumerate(_BASIS))} FROM monthly)"]
    for i in range(n):
        later = [*[f"q{j}" for j in range(i + 1, n)], "res"]
        new = ", ".join(f"{c} - coalesce(sum(q{i} * {c}) OVER w / nullif(sum(q{i} * q{i}) OVER w, 0), 0) * q{i} AS {c}" for c in later)
        ctes.append(f"g{i + 1} AS (SELECT key, epoch, v, {new} FROM g{i} WINDOW w AS (PARTITION BY key))")
    return f"WITH {MONTHLY}, {', '.join(ctes)}"


@query(f"{_chain()} SELECT key, {r('epoch')} AS epoch, {r('res', 2)} AS residual FROM g6")
def harmonic_residuals(spark, sf):
    return rounded(R.harmonic_residuals(monthly(spark, sf), ["key"], T0).select("key", "epoch", "residual"), 2, epoch=6)


@query(f"{_chain()} SELECT key, {r('sqrt(sum(res * res) / (count(*) - 6))', 2)} AS res_std, CAST(count(*) AS BIGINT) AS n_epochs FROM g6 GROUP BY key HAVING count(*) > 6")
def climatology_fit(spark, sf):
    """Residual deviation of the six-term fit from normal equations, against orthogonalisation in the oracle."""
    m = R.fit(monthly(spark, sf), ["key"], T0).where("term = 'bias' AND n_epochs > 6")
    return rounded(m.select("key", F.sqrt("res_var").alias("res_std"), "n_epochs"), 2)


@query(f"{_chain()} SELECT key, {r('epoch')} AS epoch, {r('v - res', 2)} AS model FROM g6")
def climatology_eval(spark, sf):
    x = monthly(spark, sf)
    return rounded(R.evaluate(R.fit(x, ["key"], T0), x, ["key"], T0).select("key", "epoch", "model"), 2, epoch=6)


_TREND = f"""WITH {MONTHLY}, c AS (SELECT key, epoch, v, epoch - avg(epoch) OVER w AS t, v - avg(v) OVER w AS d FROM monthly WINDOW w AS (PARTITION BY key)),
s AS (SELECT *, sum(t*d) OVER w / nullif(sum(t*t) OVER w, 0) AS slope FROM c WINDOW w AS (PARTITION BY key))"""


@query(f"{_TREND} SELECT DISTINCT key, {r('slope', 3)} AS trend FROM s")
def harmonic_trend(spark, sf):
    return rounded(R.detrend(monthly(spark, sf), ["key"]).select("key", "trend").distinct(), 3)


@query(f"{_TREND} SELECT key, {r('epoch')} AS epoch, {r('d - coalesce(slope, 0) * t', 2)} AS residual FROM s")
def detrend(spark, sf):
    return rounded(R.detrend(monthly(spark, sf), ["key"]).select("key", "epoch", "residual"), 2, epoch=6)


@query(f"WITH {COEF}, g AS (SELECT n, m, cs, 0.001::DOUBLE * (n - m) AS rate FROM idx WHERE n <= 4) SELECT set_id, n, m, cs, {r('v - coalesce(rate, 0) * (epoch - 2011)')} AS v FROM coef LEFT JOIN g USING (n, m, cs)")
def gia_removal(spark, sf):
    x = coef(spark, sf)
    rate = literal_table(spark, ["n", "m", "cs", "rate"], [(n, m, cs, 0.001 * (n - m)) for n in range(5) for m in range(n + 1) for cs in ((0, 1) if m else (0,))])
    return rounded(R.remove_rate(x, rate, 2011.0, ["n", "m", "cs"]).select("set_id", "n", "m", "cs", "v"))


def _hinge() -> str:
    """One more orthogonalised column, a hinge at 1999, on top of the six terms."""
    sql = _chain().replace("q5 FROM monthly)", "q5, greatest(epoch - 1999.0::DOUBLE, 0) AS q6 FROM monthly)")
    for i in range(6):
        sql = sql.replace(f"* q{i} AS res FROM g{i} ", f"* q{i} AS res, q6 - coalesce(sum(q{i} * q6) OVER w / nullif(sum(q{i} * q{i}) OVER w, 0), 0) * q{i} AS q6 FROM g{i} ")
    return sql + ", h AS (SELECT key, res, res - coalesce(sum(q6 * res) OVER w / nullif(sum(q6 * q6) OVER w, 0), 0) * q6 AS res1 FROM g6 WINDOW w AS (PARTITION BY key))"


@query(f"{_hinge()} SELECT key, {r('(sum(res*res) - sum(res1*res1)) / nullif(sum(res1*res1) / (count(*) - 7), 0)', 4)} AS f_stat FROM h GROUP BY key HAVING count(*) > 20")
def trend_break_fstat(spark, sf):
    x = R.trend_breaks(monthly(spark, sf), ["key"], T0, (1999.0,)).where("n_epochs > 20")
    return rounded(x.select("key", "f_stat"), 4)


@query()
def trend_break_test(spark, sf):
    """With p values."""
    return rounded(R.trend_breaks(monthly(spark, sf), ["key"], T0, (1999.0,)).where("n_epochs > 20"), 4)


@query()
def alias_removal(spark, sf):
    return rounded(R.remove_alias(monthly(spark, sf), ["key"], T0, split=1999.0), 2, epoch=6)


@query()
def huber_fit(spark, sf):
    return rounded(R.robust_fit(monthly(spark, sf), ["key"], T0), 2)


@query(f"""{_chain()}, l AS (SELECT key, res, lag(res) OVER (PARTITION BY key ORDER BY epoch) AS p FROM g6), t AS (SELECT key, least(greatest(coalesce(sum(res*p)/nullif(sum(res*res),0), 0), 0), 0.99::DOUBLE) AS r, count(*) AS n FROM l GROUP BY 1),
a AS (SELECT key, CASE WHEN n > 8 THEN least(greatest(r + (1 + 3*r)/n, 0), 0.99::DOUBLE) ELSE 0.0::DOUBLE END AS ar1 FROM t)
SELECT key, {r('ar1', 5)} AS ar1, {r('sqrt((1 + ar1)/(1 - ar1))', 5)} AS inflation FROM a""")
def ar1_correction(spark, sf):
    return rounded(R.ar1_inflation(R.harmonic_residuals(monthly(spark, sf), ["key"], T0), ["key"], 6), 5)


@query()
def model_mean(spark, sf):
    return rounded(R.model_mean(monthly(spark, sf), ["key"], 1996.0, 2000.25), 2)


# --- ordered operators ---------------------------------------------------------------------------------------------

_DSI = f"""{_TREND}, d AS (SELECT key, epoch, v, d - coalesce(slope, 0) * t + avg(v) OVER (PARTITION BY key) AS x, greatest(1, least(12, 1 + CAST(floor((epoch - floor(epoch)) * 12) AS INTEGER))) AS month FROM s),
q AS (SELECT *, avg(x) OVER w AS clim, count(x) OVER w AS nm, stddev_samp(x) OVER w AS sg FROM d WINDOW w AS (PARTITION BY key, month)),
z AS (SELECT *, CASE WHEN nm >= 5 THEN (x - clim) / nullif(sg, 0) END AS z, CASE WHEN nm >= 5 THEN x - clim END AS dev FROM q)"""
_CAT = "+".join(f"(z >= {e}::DOUBLE)::INTEGER" for e in O.EDGES)


@query(f"{_DSI} SELECT key, {r('epoch')} AS epoch, {r('z')} AS z FROM z")
def dsi_monthly(spark, sf):
    return rounded(O.standardised_index(monthly(spark, sf), ["key"]).select("key", "epoch", "z"))


@query(f"{_DSI} SELECT key, CAST({_CAT} - 5 AS INTEGER) AS category, CAST(count(*) AS BIGINT) AS months FROM z WHERE z IS NOT NULL GROUP BY 1, 2")
def dsi_category(spark, sf):
    return O.standardised_index(monthly(spark, sf), ["key"]).where("z IS NOT NULL").groupBy("key", "category").agg(F.count("*").alias("months"))


@query(f"""{_TREND}, d AS (SELECT key, epoch, d - coalesce(slope, 0) * t + avg(v) OVER (PARTITION BY key) AS x, greatest(1, least(12, 1 + CAST(floor((epoch - floor(epoch)) * 12) AS INTEGER))) AS month FROM s),
q AS (SELECT *, avg(x) OVER w AS clim, count(x) OVER w AS nm, median(x) OVER w AS med FROM d WINDOW w AS (PARTITION BY key, month)), k AS (SELECT *, 1.4826::DOUBLE * median(abs(x - med)) OVER (PARTITION BY key, month) AS sg FROM q)
SELECT key, {r('epoch')} AS epoch, {r('CASE WHEN nm >= 5 THEN (x - clim) / nullif(sg, 0) END', 5)} AS z FROM k""")
def dsi_robust(spark, sf):
    return rounded(O.standardised_index(monthly(spark, sf), ["key"], robust=True).select("key", "epoch", "z"), 5, epoch=6)


@query(f"{_DSI} SELECT key, {r('epoch')} AS epoch, {r('(dev - avg(dev) OVER w) / nullif(stddev_samp(dev) OVER w, 0)')} AS z FROM z WINDOW w AS (PARTITION BY key)")
def wsdi(spark, sf):
    return rounded(O.storage_index(monthly(spark, sf), ["key"]).select("key", "epoch", "z"))


_DEF = f"WITH {MONTHLY}, d AS (SELECT key, epoch, v, max(v) OVER (PARTITION BY key ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - lag(v) OVER (PARTITION BY key ORDER BY epoch) AS deficit FROM monthly)"


@query(f"{_DEF} SELECT key, {r('epoch')} AS epoch, {r('deficit', 2)} AS deficit FROM d")
def storage_deficit(spark, sf):
    return rounded(O.storage_deficit(monthly(spark, sf), ["key"]).select("key", "epoch", "deficit"), 2, epoch=6)


@query(f"{_DEF}, a AS (SELECT key, epoch, v * 0.5::DOUBLE - deficit AS amount FROM d) SELECT key, {r('epoch')} AS epoch, {r('amount / nullif(max(amount) OVER (PARTITION BY key), 0)')} AS flood_potential FROM a")
def flood_potential(spark, sf):
    x = monthly(spark, sf).withColumn("rain", F.col("v") * 0.5)
    return rounded(O.flood_potential(x, ["key"], "rain").select("key", "epoch", "flood_potential"))


@query(f"""WITH e AS (SELECT DISTINCT event_type, floor(epoch(ts) / 3600) AS h FROM events), g AS (SELECT event_type, h, lag(h) OVER (PARTITION BY event_type ORDER BY h) AS p FROM e)
SELECT event_type, p::DOUBLE AS gap_start, h::DOUBLE AS gap_end, (h - p)::DOUBLE AS gap FROM g WHERE h - p > 1""")
def epoch_gaps(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("epoch"))
    return O.epoch_gaps(e, ["event_type"], 1)


_DOY = """x AS (SELECT o_orderpriority AS key, least(365, dayofyear(o_orderdate)) AS doy, o_totalprice AS v FROM orders),
c AS (SELECT *, avg(v) OVER (PARTITION BY key, doy) AS clim, count(v) OVER (PARTITION BY key, doy) AS n_day FROM x),
p AS (SELECT key, ((doy - 1 + k + 365) % 365) + 1 AS doy, v - clim AS r FROM c, range(-15, 16) g(k)),
s AS (SELECT key, doy, stddev_samp(r) AS sd, count(*) AS n_pool FROM p GROUP BY 1, 2), d AS (SELECT DISTINCT key, doy, clim, n_day FROM c)"""


@query(f"WITH {_DOY} SELECT key, CAST(doy AS INTEGER) AS doy, {r('clim', 4)} AS clim, CAST(n_day AS BIGINT) AS n_day, CAST(n_pool AS BIGINT) AS n_pool, {r('sd * sqrt(greatest(2, n_day) / (greatest(2, n_day) - 1.0::DOUBLE))', 4)} AS sigma FROM d JOIN s USING (key, doy) WHERE n_day >= 1")
def doy_circular_sigma(spark, sf):
    d = F.least(F.lit(365), F.dayofyear("o_orderdate"))
    x = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), (2000 + (d - 0.5) / 365.25).alias("epoch"), F.col("o_totalprice").alias("v"))
    return rounded(O.daily_sigma(x, ["key"]), 4)


def _stripe_sql() -> str:
    ctes = ["g0 AS (SELECT set_id, n, m, cs, v, v AS r, count(*) OVER w AS c, 1.0::DOUBLE AS b0, n - avg(n) OVER w AS b1 FROM coef WINDOW w AS (PARTITION BY set_id, m, cs, n % 2))"]
    for i, later in ((0, ["b1", "r"]), (1, ["r"])):
        new = ", ".join(f"{c} - coalesce(sum(b{i} * {c}) OVER w / nullif(sum(b{i} * b{i}) OVER w, 0), 0) * b{i} AS {c}" for c in later)
        ctes.append(f"g{i + 1} AS (SELECT set_id, n, m, cs, v, c, {new} FROM g{i} WINDOW w AS (PARTITION BY set_id, m, cs, n % 2))")
    return f"WITH {COEF}, {', '.join(ctes)} SELECT set_id, n, m, cs, {r('CASE WHEN m >= 2 AND c > 2 THEN r ELSE v END')} AS v FROM g2"


@query(_stripe_sql())
def destripe_global(spark, sf):
    return rounded(O.destripe(coef(spark, sf), ["set_id"], 2, 1).select("set_id", "n", "m", "cs", "v"))


@query()
def destripe_moving(spark, sf):
    return rounded(O.destripe_moving(coef(spark, sf), ["set_id"], 1, 1, 3).select("set_id", "n", "m", "cs", "v"))


@query("""WITH e AS (SELECT user_id, epoch(ts) AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 AS new FROM e),
c AS (SELECT user_id, t, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1, 2""")
def epoch_clusters(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return O.clusters(e, ["user_id"], 43200.0).groupBy("user_id", "cluster").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts FROM events), g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR AS new FROM e),
c AS (SELECT user_id, ts, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM c GROUP BY user_id, k""")
def session_gaps(spark, sf):
    """The same clusters as session windows, which also run on streams."""
    e = table(spark, sf, "events")
    s = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return s.select("user_id", "n", "seconds")
