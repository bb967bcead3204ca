"""Means with standard errors, percentiles, weighted and robust statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.functions.special import student_p


def mean_field(coef: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Mean over epochs of what is there, with its standard error (null below two values)."""
    n = F.count("v")
    return coef.groupBy(*keys).agg(
        F.when(n >= least, F.avg("v")).alias("v"),
        F.when(n >= 2, F.stddev_samp("v") / F.sqrt(n)).alias("s"),
        n.alias("n_valid"),
    )


def window_info(epochs: DataFrame, first: float, last: float, keys: list[str]) -> DataFrame:
    """Coverage of a time window: median spacing, share covered, widest gap, offset of the centroid."""
    w = W.partitionBy(*keys).orderBy("epoch")
    e = epochs.where(F.col("epoch").between(first, last)).withColumn("gap", F.col("epoch") - F.lag("epoch").over(w))
    return e.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.median("gap").alias("spacing"),
        F.least(F.lit(1.0), F.count("*") * F.median("gap") / (last - first)).alias("coverage"),
        F.max("gap").alias("widest_gap"),
        (F.avg("epoch") - (first + last) / 2).alias("centroid_offset"),
    )


def hazen_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Percentile at positions 100 (k - 1/2) / n, linear between them and clamped; only finite values count."""
    w = W.partitionBy(*keys).orderBy(value)
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    x = x.select(*keys, F.col(value).alias("_x"), F.row_number().over(w).alias("_k"), F.count("*").over(W.partitionBy(*keys)).alias("_n"), F.lead(value).over(w).alias("_nx"))
    at = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.col("_n") * p / 100 + 0.5))
    hit = x.withColumn("_at", at).where(F.col("_k") == F.floor("_at"))
    return hit.select(*keys, (F.col("_x") + (F.col("_at") - F.col("_k")) * (F.coalesce("_nx", "_x") - F.col("_x"))).alias("percentile"))


def weighted_agreement(df: DataFrame, keys: list[str], a: str, b: str, w: Column) -> DataFrame:
    """Weighted bias, RMSD, centred RMSD, correlation and ratio of deviations, from one pass of sums."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"))
    s = {"w": F.col("w"), "a": F.col("w") * F.col("a"), "b": F.col("w") * F.col("b"), "aa": F.col("w") * F.col("a") ** 2, "bb": F.col("w") * F.col("b") ** 2, "ab": F.col("w") * F.col("a") * F.col("b")}
    t = x.groupBy(*keys).agg(*[F.sum(c).alias(f"s_{k}") for k, c in s.items()])
    m = {k: F.col(f"s_{k}") / F.nullif(F.col("s_w"), F.lit(0.0)) for k in ("a", "b", "aa", "bb", "ab")}
    va, vb, cov = m["aa"] - m["a"] ** 2, m["bb"] - m["b"] ** 2, m["ab"] - m["a"] * m["b"]
    bias, msd = m["a"] - m["b"], m["aa"] + m["bb"] - 2 * m["ab"]
    return t.select(
        *keys,
        bias.alias("bias"),
        F.sqrt(F.greatest(msd, F.lit(0.0))).alias("rmsd"),
        F.sqrt(F.greatest(msd - bias**2, F.lit(0.0))).alias("crmsd"),
        (cov / F.nullif(F.sqrt(va * vb), F.lit(0.0))).alias("corr"),
        F.sqrt(va / F.nullif(vb, F.lit(0.0))).alias("std_ratio"),
    )


def nash_sutcliffe(df: DataFrame, keys: list[str], reference: str, model: str) -> DataFrame:
    """1 - SSE / SST; null below three pairs."""
    x = df.where(F.col(reference).isNotNull() & F.col(model).isNotNull())
    sst = F.sum(F.col(reference) ** 2) - F.sum(reference) ** 2 / F.count("*")
    return x.groupBy(*keys).agg(F.when(F.count("*") >= 3, 1 - F.sum((F.col(reference) - F.col(model)) ** 2) / F.nullif(sst, F.lit(0.0))).alias("nse"))


def three_cornered_hat(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Error variances of three series from the variances of their differences; negative ones are clipped."""
    v = {p: F.var_samp(F.col(x) - F.col(y)) for p, x, y in (("ab", a, b), ("ac", a, c), ("bc", b, c))}
    t = df.agg(*[e.alias(p) for p, e in v.items()])
    out = {"var1": "(ab + ac - bc) / 2", "var2": "(ab + bc - ac) / 2", "var3": "(ac + bc - ab) / 2"}
    return t.select(*[F.expr(e).alias(k) for k, e in out.items()], *[F.sqrt(F.greatest(F.expr(e), F.lit(0.0))).alias(k.replace("var", "sigma")) for k, e in out.items()])


def lag1_correlation(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Sum of neighbouring products of the centred series over its sum of squares."""
    g = W.partitionBy(*keys)
    x = df.select(*keys, order, (F.col(value) - F.avg(value).over(g)).alias("x"))
    x = x.withColumn("p", F.lag("x").over(g.orderBy(order)))
    return x.groupBy(*keys).agg((F.sum(F.col("x") * F.col("p")) / F.nullif(F.sum(F.col("x") ** 2), F.lit(0.0))).alias("r1"))


def effective_correlation(df: DataFrame, keys: list[str], order: str, a: str, b: str) -> DataFrame:
    """Correlation with the number of independent pairs that first-order autocorrelation leaves, and its t."""
    g = W.partitionBy(*keys)
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = x.select(*keys, order, (F.col(a) - F.avg(a).over(g)).alias("a"), (F.col(b) - F.avg(b).over(g)).alias("b"))
    o = g.orderBy(order)
    x = x.withColumn("pa", F.lag("a").over(o)).withColumn("pb", F.lag("b").over(o))
    t = x.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.sum(F.col("a") * F.col("b")) / F.nullif(F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2)), F.lit(0.0))).alias("r"),
        (F.sum(F.col("a") * F.col("pa")) / F.nullif(F.sum(F.col("a") ** 2), F.lit(0.0)) * F.sum(F.col("b") * F.col("pb")) / F.nullif(F.sum(F.col("b") ** 2), F.lit(0.0))).alias("q"),
    )
    neff = F.greatest(F.lit(4.0), F.least(F.col("n").cast("double"), F.col("n") * (1 - F.col("q")) / (1 + F.col("q"))))
    return t.where("n >= 8").withColumn("n_eff", neff).select(*keys, "n", "r", "n_eff", (F.col("r") * F.sqrt((F.col("n_eff") - 2) / F.greatest(1 - F.col("r") ** 2, F.lit(2.220446049250313e-16)))).alias("t"))


def with_p_value(correlations: DataFrame) -> DataFrame:
    """Two-sided p of each t, by the incomplete beta function."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b - 2) for a, b in zip(t, n)])

    return correlations.withColumn("p", p("t", "n_eff"))


def mad_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    return df.join(med, keys).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("med")))).alias("sigma"))


def area_rms(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Root of the cos-latitude weighted mean square."""
    w = F.cos(F.radians("lat"))
    return grid.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.sqrt(F.sum(w * F.col("value") ** 2) / F.nullif(F.sum(w), F.lit(0.0))).alias("rms"))
