"""Ordered operators: standardised indices, storage deficits, gaps, destriping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.functions.scalars import month_number
from orbloom.operators.regression import detrend

# Edges of the drought and wetness classes -5 .. +5.
EDGES = [-2.0, -1.6, -1.3, -0.8, -0.5, 0.5, 0.8, 1.3, 1.6, 2.0]


def category(z: Column) -> Column:
    """Class -5 to 5; a value on an edge belongs above it."""
    out = sum(((z >= e).cast("int") for e in EDGES), F.lit(0)) - 5
    return F.when(z.isNotNull(), out)


def standardised_index(series: DataFrame, keys: list[str], min_years: int = 5, linear: bool = True, robust: bool = False) -> DataFrame:
    """Detrended deviation from the calendar month's mean over its deviation; null for months with too few years."""
    x = detrend(series, keys) if linear else series.withColumn("residual", F.col("v"))
    if linear:
        x = x.withColumn("residual", F.col("residual") + F.avg("v").over(W.partitionBy(*keys)))
    x = x.withColumn("month", month_number(F.col("epoch")))
    g = W.partitionBy(*keys, "month")
    x = x.withColumn("clim", F.avg("residual").over(g)).withColumn("n_month", F.count("residual").over(g))
    if robust:
        med = x.groupBy(*keys, "month").agg(F.median("residual").alias("_med"))
        x = x.join(med, [*keys, "month"])
        mad = x.groupBy(*keys, "month").agg((1.4826 * F.median(F.abs(F.col("residual") - F.col("_med")))).alias("sigma"))
        x = x.join(mad, [*keys, "month"]).drop("_med")
    else:
        x = x.withColumn("sigma", F.stddev_samp("residual").over(g))
    z = F.when(F.col("n_month") >= min_years, (F.col("residual") - F.col("clim")) / F.nullif(F.col("sigma"), F.lit(0.0)))
    return x.withColumn("z", z).withColumn("category", category(z))


def storage_index(series: DataFrame, keys: list[str], min_years: int = 5) -> DataFrame:
    """Deviation from the month's mean, standardised over all time."""
    x = standardised_index(series, keys, min_years).withColumn("d", F.when(F.col("n_month") >= min_years, F.col("residual") - F.col("clim")))
    g = W.partitionBy(*keys)
    return x.withColumn("z", (F.col("d") - F.avg("d").over(g)) / F.nullif(F.stddev_samp("d").over(g), F.lit(0.0))).drop("d", "category")


def storage_deficit(series: DataFrame, keys: list[str]) -> DataFrame:
    """Highest value of the past less the previous value; null at the start."""
    o = W.partitionBy(*keys).orderBy("epoch")
    return series.withColumn("deficit", F.max("v").over(o.rowsBetween(W.unboundedPreceding, -1)) - F.lag("v").over(o))


def flood_potential(series: DataFrame, keys: list[str], rain: str) -> DataFrame:
    """(rain - deficit), over its largest value."""
    x = storage_deficit(series, keys).withColumn("amount", F.col(rain) - F.col("deficit"))
    return x.withColumn("flood_potential", F.col("amount") / F.nullif(F.max("amount").over(W.partitionBy(*keys)), F.lit(0.0)))


def daily_sigma(series: DataFrame, keys: list[str], window_days: int = 31, min_years: int = 1) -> DataFrame:
    """By day of year: mean, and deviation of residuals pooled over a circular window.

    Sums by day are made first (combined before the shuffle); only those at most 365 rows a key go to the days of
    their window, so raw rows are never multiplied.
    """
    x = series.withColumn("doy", F.least(F.lit(365), 1 + F.floor((F.col("epoch") - F.floor("epoch")) * 365.25)).cast("int"))
    days = x.groupBy(*keys, "doy").agg(F.avg("v").alias("clim"), F.count("v").alias("n_day"), F.var_pop("v").alias("_var"))
    half = window_days // 2
    spread = days.select(*keys, F.col("n_day").alias("_n"), (F.col("_var") * F.col("n_day")).alias("_ss"), F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(365)) + 1)).alias("doy"))
    # Residuals of a day sum to zero, so squares about the pooled mean are the sum of the days' own.
    pooled = spread.groupBy(*keys, "doy").agg(F.sqrt(F.sum("_ss") / F.nullif(F.sum("_n") - 1, F.lit(0))).alias("sd"), F.sum("_n").alias("n_pool"))
    n = F.greatest(F.lit(2), F.col("n_day"))
    return days.join(pooled, [*keys, "doy"]).where(F.col("n_day") >= min_years).select(*keys, "doy", "clim", "n_day", "n_pool", (F.col("sd") * F.sqrt(n / (n - 1))).alias("sigma"))


def epoch_gaps(epochs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Stretches without data: each gap over the threshold with its ends."""
    o = W.partitionBy(*keys).orderBy("epoch")
    return epochs.select(*keys, "epoch").distinct().withColumn("after", F.lag("epoch").over(o)).where(F.col("epoch") - F.col("after") > threshold).select(*keys, F.col("after").alias("gap_start"), F.col("epoch").alias("gap_end"), (F.col("epoch") - F.col("after")).alias("gap"))


def clusters(epochs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Numbers groups of epochs that follow each other within the tolerance; rows without an epoch come last."""
    o = W.partitionBy(*keys).orderBy(F.col("epoch").asc_nulls_last())
    new = (F.col("epoch") - F.lag("epoch").over(o) > tolerance).cast("int")
    return epochs.withColumn("cluster", F.sum(F.coalesce(new, F.lit(0))).over(o.rowsBetween(W.unboundedPreceding, 0)))


def destripe(coef: DataFrame, keys: list[str], min_order: int = 6, poly_order: int = 3) -> DataFrame:
    """For orders from ``min_order``: takes a polynomial in degree off each order, C/S and degree parity, by window sums.

    Orthogonal polynomials are built by Gram-Schmidt in windows, so the whole filter is one shuffle on the keys.
    """
    g = W.partitionBy(*keys, "m", "cs", F.col("n") % 2)
    x = coef.withColumn("_c", F.count("*").over(g)).withColumn("_t", F.col("n") - F.avg("n").over(g)).withColumn("_r", F.col("v"))
    basis = [f"_b{k}" for k in range(poly_order + 1)]
    x = x.withColumns({b: F.pow(F.col("_t"), F.lit(k)) for k, b in enumerate(basis)})
    for k, b in enumerate(basis):
        later = [*basis[k + 1 :], "_r"]
        norm = F.nullif(F.sum(F.col(b) * F.col(b)).over(g), F.lit(0.0))
        x = x.withColumns({f"_p{i}": F.coalesce(F.sum(F.col(b) * F.col(c)).over(g) / norm, F.lit(0.0)) for i, c in enumerate(later)})
        x = x.withColumns({c: F.col(c) - F.col(f"_p{i}") * F.col(b) for i, c in enumerate(later)}).drop(*[f"_p{i}" for i in range(len(later))])
    change = (F.col("m") >= min_order) & (F.col("_c") > poly_order + 1)
    return x.withColumn("v", F.when(change, F.col("_r")).otherwise(F.col("v"))).select(*coef.columns)


def destripe_moving(coef: DataFrame, keys: list[str], min_order: int, poly_order: int, window: int) -> DataFrame:
    """The same with a moving window of degrees, narrower at the edges but never below poly_order + 1 points.

    What a window fits at its degree is linear in the values, with weights that only the degrees decide.
    """
    weights: dict[bytes, np.ndarray] = {}

    def smoother(x: np.ndarray) -> np.ndarray:
        if (key := x.tobytes()) not in weights:
            fit, half = np.zeros((len(x), len(x))), window // 2
            for i in range(len(x)):
                lo, hi = max(0, i - half), min(len(x), i + half + 1)
                while hi - lo < poly_order + 1:
                    lo, hi = max(0, lo - 1), min(len(x), hi + 1)
                fit[i, lo:hi] = np.linalg.pinv(np.vander(x[lo:hi] - x[i], poly_order + 1))[-1]
            weights[key] = fit
        return weights[key]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, cs = (pdf[c].to_numpy() for c in ("n", "m", "cs"))
        o = np.lexsort((n, n % 2, cs, m))
        y = pdf["v"].to_numpy(float)[o]
        n, m, cs = n[o], m[o], cs[o]
        edges = np.flatnonzero((np.diff(m) != 0) | (np.diff(cs) != 0) | (np.diff(n % 2) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(n)]):
            if m[lo] >= min_order and hi - lo > poly_order + 1:
                y[lo:hi] = y[lo:hi] - smoother(n[lo:hi].astype(float)) @ y[lo:hi]
        return pdf.iloc[o].assign(v=y)

    return coef.groupBy(*keys).applyInPandas(kernel, coef.schema)
