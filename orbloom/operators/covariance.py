"""Block covariances of residuals, variance factors, signal models and the Wiener filter over a series.

Blocks are (order, C/S, degree parity): independent of each other, so they are the shuffle key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions.special import CHI2_1_MEDIAN
from orbloom.operators import month_filter

BLOCK = ["m", "cs", "parity"]


def with_block(coef: DataFrame) -> DataFrame:
    return coef.withColumn("parity", F.col("n") % 2)


def block_covariance(resid: DataFrame, shrinkage: float = 0.0) -> DataFrame:
    """Sample covariance over epochs of every pair of degrees of a block; off-diagonals shrink.

    A self-join on (block, epoch): each row meets the at most nmax / 2 degrees of its block and epoch only.
    """
    x = with_block(resid).select(*BLOCK, "epoch", F.col("n").alias("n1"), F.col("residual").alias("a"))
    y = x.select(*BLOCK, "epoch", F.col("n1").alias("n2"), F.col("a").alias("b"))
    c = x.join(y, [*BLOCK, "epoch"]).where("n1 <= n2").groupBy(*BLOCK, "n1", "n2").agg(F.covar_samp("a", "b").alias("cov"))
    return c.withColumn("cov", F.when(F.col("n1") == F.col("n2"), F.col("cov")).otherwise(F.col("cov") * (1 - shrinkage)))


def variance_factor(resid: DataFrame, noise: DataFrame, min_degree: int, keys: list[str]) -> DataFrame:
    """Factor on the noise by epoch: median of x^2 / d over high degrees, over the chi-square median."""
    x = resid.where(F.col("n") >= min_degree).join(noise.select("n", "m", "cs", "d"), ["n", "m", "cs"])
    return x.groupBy(*keys).agg((F.median(F.col("residual") ** 2 / F.nullif(F.col("d"), F.lit(0.0))) / CHI2_1_MEDIAN).alias("factor"))


def signal_variance(resid: DataFrame, noise: DataFrame) -> DataFrame:
    """Degree variances of the signal: mean square less noise, averaged over the degree, never below zero."""
    ms = resid.groupBy("n", "m", "cs").agg(F.avg(F.col("residual") ** 2).alias("ms"))
    return ms.join(noise.select("n", "m", "cs", "d"), ["n", "m", "cs"]).groupBy("n").agg(F.greatest(F.avg(F.col("ms") - F.col("d")), F.lit(0.0)).alias("signal"), F.count("*").alias("terms"))


def wiener_diagonal(resid: DataFrame, noise: DataFrame, signal: DataFrame) -> DataFrame:
    """Residuals times signal / (signal + noise), coefficient by coefficient."""
    x = resid.join(noise.select("n", "m", "cs", "d"), ["n", "m", "cs"]).join(F.broadcast(signal.select("n", "signal")), "n")
    gain = F.col("signal") / F.nullif(F.col("signal") + F.col("d"), F.lit(0.0))
    return x.withColumn("gain", F.coalesce(gain, F.lit(0.0))).withColumn("filtered", F.col("gain") * F.col("residual"))


def wiener_blocks(resid: DataFrame, factors: DataFrame | None = None, shrinkage: float = 0.1, iterations: int = 3) -> DataFrame:
    """Wiener filter with full block covariances and a noise factor by epoch: filtered residuals with posterior sigmas.

    Covariances are sums in Spark, a block's operator comes from its covariance alone, and sets meet operators by block.
    """
    x = resid.select("epoch", "n", "m", "cs", "residual")
    operator = month_filter.operator_table(block_covariance(x), shrinkage, iterations)
    x = x.withColumnRenamed("residual", "v")
    if factors is not None:
        x = x.join(factors.select("epoch", "factor"), "epoch", "left")
    out = month_filter.apply(operator, x, ["epoch"], "factor" if factors is not None else None)
    return out.select("epoch", "n", "m", "cs", F.col("v").alias("filtered"), "sigma")
