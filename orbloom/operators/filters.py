"""Spectral filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions.index import literal_table
from orbloom.functions.special import gaussian_weights
from orbloom.operators.coefficients import weight


def weight_table(spark, weights, column: str = "n") -> DataFrame:
    return literal_table(spark, [column, "w"], [(k, float(x)) for k, x in enumerate(weights)])


def gaussian(coef: DataFrame, radius_km: float, nmax: int) -> DataFrame:
    return weight(coef, weight_table(coef.sparkSession, gaussian_weights(nmax, radius_km)), ["n"])


def fan(coef: DataFrame, degree_km: float, order_km: float, nmax: int) -> DataFrame:
    """Gaussian weights in degree times Gaussian weights in order."""
    spark = coef.sparkSession
    x = weight(coef, weight_table(spark, gaussian_weights(nmax, degree_km)), ["n"])
    return weight(x, weight_table(spark, gaussian_weights(nmax, order_km), "m"), ["m"])


def block_filter(coef: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """v'(n) = sum over n2 of w(n, n2) v(n2) in each (m, cs) block; rows outside all blocks stay as they are.

    A join with the block table (its size is set by nmax) and one grouped sum; C and S are both filtered.
    """
    b = blocks.select("m", "cs", "n_row", F.col("n_col").alias("n"), "w")
    new = coef.join(b, ["m", "cs", "n"]).groupBy(*keys, "m", "cs", F.col("n_row").alias("n")).agg(F.sum(F.col("w") * F.col("v")).alias("_v"))
    on = [*keys, "n", "m", "cs"]
    return coef.join(new, on, "left").withColumn("v", F.coalesce("_v", "v")).withColumn("s", F.when(F.col("_v").isNull(), F.col("s"))).drop("_v")


def design_diagonal(coef: DataFrame, kaula: float = 1e-5, alpha: float = 1.0) -> DataFrame:
    """Wiener-type factor N / (N + alpha / S) per coefficient from its sigma (N = 1/s^2) and a power-law signal."""
    signal = F.pow(F.lit(kaula) / F.pow(F.greatest(F.col("n"), F.lit(1)).cast("double"), F.lit(2.0)), F.lit(2.0))
    normal = 1 / F.nullif(F.col("s") * F.col("s"), F.lit(0.0))
    return coef.withColumn("w", F.when(F.col("n") >= 2, normal / (normal + alpha / signal)))


def design_blocks(noise: dict[tuple[int, int], np.ndarray], degrees: dict[tuple[int, int], np.ndarray], kaula: float = 1e-5, alpha: float = 1.0) -> list[tuple]:
    """Rows (m, cs, n_row, n_col, w) of W = (N + alpha / S)^-1 N from full noise covariances by block."""
    rows = []
    for (m, cs), cov in noise.items():
        n = degrees[m, cs].astype(float)
        normal = np.linalg.inv(cov)
        w = np.linalg.solve(normal + alpha * np.diag(n**4 / kaula**2), normal)
        rows += [(m, cs, int(a), int(b), float(w[i, j])) for i, a in enumerate(n) for j, b in enumerate(n)]
    return rows


def regularised(vectors: DataFrame, normal: np.ndarray, signal_inverse: np.ndarray, alpha: float = 1.0) -> DataFrame:
    """x' = (N + alpha M)^-1 N x for one vector per row; the factor is made once and broadcast."""
    np.linalg.cholesky(normal + alpha * np.diag(signal_inverse))  # raises unless positive definite
    w = np.linalg.solve(normal + alpha * np.diag(signal_inverse), normal)
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ shared.value.T)) if len(x) else x

    return vectors.withColumn("x", apply("x"))


# The published files of the decorrelation filters, from strong (1) to weak (8).
DDK_FILES = ["Wbd_2-120.a_1d14p_4", "Wbd_2-120.a_1d13p_4", "Wbd_2-120.a_1d12p_4", "Wbd_2-120.a_5d11p_4", "Wbd_2-120.a_1d11p_4", "Wbd_2-120.a_5d10p_4", "Wbd_2-120.a_1d10p_4", "Wbd_2-120.a_5d9p_4"]


def parse_filter(name: str, nmax: int) -> np.ndarray:
    """Degree weights of 'none' or 'gauss<km>'."""
    if name == "none":
        return np.ones(nmax + 1)
    try:
        radius = float(name.removeprefix("gauss"))
    except ValueError:
        radius = 0.0
    if not name.startswith("gauss") or not radius > 0:
        raise ValueError(f"unknown filter: {name}; it is 'none', 'gauss<km>' or 'DDK1' to 'DDK8'")
    return gaussian_weights(nmax, radius)


def filtered(coef: DataFrame, name: str, nmax: int, keys: list[str], folder: str | None = None) -> DataFrame:
    """The sets behind the filter of that name; DDK filters are read from the folder with the published files."""
    if not name.startswith("DDK"):
        return weight(coef, weight_table(coef.sparkSession, parse_filter(name, nmax)), ["n"])
    from orbloom.sources.block_matrix import read_block_matrix

    if name[3:] not in "12345678" or len(name) != 4:
        raise ValueError(f"unknown filter: {name}; DDK filters are numbered from 1 to 8")
    if folder is None:
        raise ValueError(f"{name} needs the folder that holds {DDK_FILES[int(name[3]) - 1]}")
    return block_filter(coef, read_block_matrix(coef.sparkSession, f"{folder}/{DDK_FILES[int(name[3]) - 1]}", nmax), keys)
