"""Spectra by degree and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.functions.index import index_table
from orbloom.functions.special import R_EARTH


def _spectrum(coef: DataFrame, by: str, keys: list[str], r: float, least: int) -> DataFrame:
    on = F.col(by) >= least
    a = coef.groupBy(*keys, by).agg(
        F.sum(F.when(on, F.col("v") * F.col("v")).otherwise(0.0)).alias("variance"),
        F.sum(F.when(on, F.coalesce(F.col("s") * F.col("s"), F.lit(0.0))).otherwise(0.0)).alias("error_variance"),
    )
    w = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    return a.select(
        *keys, by, "variance",
        F.sqrt("variance").alias("rms"),
        (r * F.sqrt("variance")).alias("amplitude"),
        (r * F.sqrt(F.sum("variance").over(w))).alias("cumulative"),
        (r * F.sqrt("error_variance")).alias("error_amplitude"),
        (r * F.sqrt(F.sum("error_variance").over(w))).alias("error_cumulative"),
    )


def degree_spectrum(coef: DataFrame, keys: list[str], r: float = R_EARTH, least: int = 0) -> DataFrame:
    """Variance, RMS and amplitude by degree, cumulative and from the sigmas; partial sums before the shuffle."""
    return _spectrum(coef, "n", keys, r, least)


def order_spectrum(coef: DataFrame, keys: list[str], r: float = R_EARTH, least: int = 0) -> DataFrame:
    return _spectrum(coef, "m", keys, r, least)


def difference_spectrum_packed(a: DataFrame, b: DataFrame, keys: list[str], nmax: int, min_degree: int = 0) -> DataFrame:
    """The difference spectrum of two sets of vectors (keys, x): they join packed, one row per set, and unpack in their partition.

    The sums by degree need no shuffle of their own, as rows of a key are together already.
    """
    index = F.broadcast(index_table(a.sparkSession, nmax, min_degree))
    j = a.select(*keys, "x").join(b.select(*keys, F.col("x").alias("y")), keys)
    rows = j.select(*keys, F.posexplode(F.arrays_zip("x", "y")).alias("pos", "z")).select(*keys, "pos", F.col("z.x").cast("double").alias("v"), F.col("z.y").cast("double").alias("w"))
    return _difference(rows.join(index, "pos"), keys)


def difference_spectrum(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """By degree: amplitudes of both sets and of their difference, and the degree correlation."""
    return _difference(a.join(b.select(*on, F.col("v").alias("w")), on), keys)


def _difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "n").agg(
        F.sqrt(F.sum(F.col("v") ** 2)).alias("amp1"),
        F.sqrt(F.sum(F.col("w") ** 2)).alias("amp2"),
        F.sqrt(F.sum((F.col("v") - F.col("w")) ** 2)).alias("diff"),
        (F.sum(F.col("v") * F.col("w")) / F.nullif(F.sqrt(F.sum(F.col("v") ** 2) * F.sum(F.col("w") ** 2)), F.lit(0.0))).alias("corr"),
    )


def first_above(spectrum: DataFrame, keys: list[str], condition: Column, degree: str = "n") -> DataFrame:
    return spectrum.groupBy(*keys).agg(F.min(F.when(condition, F.col(degree))).alias("first_degree"))


def crossover(spectrum: DataFrame, keys: list[str], signal: str = "amplitude", error: str = "error_amplitude") -> DataFrame:
    """First degree with more error than signal, and its log-linear interpolation; null without one."""
    w = W.partitionBy(*keys).orderBy("n")
    d = F.log(F.nullif(F.col(error), F.lit(0.0))) - F.log(F.nullif(F.col(signal), F.lit(0.0)))
    x = spectrum.withColumn("d", d).withColumn("d0", F.lag("d").over(w)).withColumn("n0", F.lag("n").over(w))
    at = x.where("d > 0").groupBy(*keys).agg(F.min_by(F.struct("n", "d", "n0", "d0"), "n").alias("x"))
    exact = F.when(F.col("x.d0") <= 0, F.col("x.n0") + (F.col("x.n") - F.col("x.n0")) * (-F.col("x.d0")) / F.nullif(F.col("x.d") - F.col("x.d0"), F.lit(0.0)))
    return spectrum.select(*keys).distinct().join(at, keys, "left").select(*keys, F.col("x.n").alias("crossover"), exact.alias("crossover_exact"))


def kaula_fit(spectrum: DataFrame, bias: DataFrame, keys: list[str]) -> DataFrame:
    """log amplitude = log(a) + b log(n), corrected for the mean of the log chi-square."""
    x = spectrum.where("variance > 0").join(F.broadcast(bias), "n")
    y = 0.5 * F.log("variance") - F.col("bias")
    return x.groupBy(*keys).agg(F.exp(F.regr_intercept(y, F.log("n"))).alias("a"), F.regr_slope(y, F.log("n")).alias("b"))
