"""Signal covariances from the residuals themselves: degree variances that iterate with their filter, and a variance map.

The filter and the variances of what it lets through depend on the residuals' second moments alone, which Spark sums
once by block; the rounds run on those.  The map form weighs the signal by where the filtered fields are strong.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays, literal_table
from orbloom.operators import tiles as T
from orbloom.operators import transforms


def moments(resid: DataFrame) -> DataFrame:
    """Mean products over epochs (m, cs, parity, n1 <= n2, moment) of the coefficients of a block."""
    x = resid.select("epoch", "m", "cs", (F.col("n") % 2).alias("parity"), "n", "residual")
    y = x.select("epoch", "m", "cs", "parity", F.col("n").alias("n2"), F.col("residual").alias("b"))
    j = x.withColumnsRenamed({"n": "n1", "residual": "a"}).join(y, ["epoch", "m", "cs", "parity"]).where("n1 <= n2")
    return j.groupBy("m", "cs", "parity", "n1", "n2").agg(F.avg(F.col("a") * F.col("b")).alias("moment"))


def _square(rows: list, value: str) -> tuple[np.ndarray, np.ndarray]:
    degrees = np.unique([[r["n1"], r["n2"]] for r in rows])
    at, out = {int(n): k for k, n in enumerate(degrees)}, np.zeros((len(degrees), len(degrees)))
    for r in rows:
        i, j = at[r["n1"]], at[r["n2"]]
        out[i, j] = out[j, i] = r[value]
    return degrees, out


def iterate(resid: DataFrame, noise: DataFrame, rounds: int = 3, floor: float = 1e-8) -> tuple[dict[int, float], DataFrame]:
    """Variance of a coefficient by degree, and the filter's rows (m, cs, n_row, n_col, w).

    ``noise`` has (m, cs, n1 <= n2, cov); a pair without a row does not covary.  Each round filters with S (S + N)^-1 in
    every block and takes the degree variances, over 2 n + 1, of the result.  Moments and noise come to the driver by
    block: their number is set by the largest degree.
    """
    n_of = {(r.m, r.cs, r.n1, r.n2): r.cov for r in noise.collect()}
    by: dict[tuple, list] = {}
    for r in moments(resid).collect():
        by.setdefault((r.m, r.cs, r.parity), []).append(r)
    blocks = []
    for (m, cs, _), rows in by.items():
        degrees, c = _square(rows, "moment")
        n = np.array([[n_of.get((m, cs, int(min(a, b)), int(max(a, b))), 0.0) for b in degrees] for a in degrees])
        blocks.append((m, cs, degrees, c, n))
    top = max(int(d.max()) for _, _, d, _, _ in blocks)

    def variances(squares: list[np.ndarray]) -> np.ndarray:
        v = np.zeros(top + 1)
        for (_, _, d, _, _), s in zip(blocks, squares):
            np.add.at(v, d, s)
        v /= 2 * np.arange(top + 1) + 1
        return np.maximum(v, floor * v.max())

    v = variances([np.diag(c) for _, _, _, c, _ in blocks])
    for _ in range(rounds):
        w = [np.linalg.solve((np.diag(v[d]) + n).T, np.diag(v[d])).T for _, _, d, _, n in blocks]
        v = variances([np.diag(a @ c @ a.T) for a, (_, _, _, c, _) in zip(w, blocks)])
    rows = [(int(m), int(cs), int(a), int(b), float(x[i, j])) for x, (m, cs, d, _, _) in zip(w, blocks) for i, a in enumerate(d) for j, b in enumerate(d)]
    return {n: float(x) for n, x in enumerate(v)}, literal_table(resid.sparkSession, ["m", "cs", "n_row", "n_col", "w"], rows)


def variance_map(filtered: DataFrame, nmax: int, cap: float | None = 10.0) -> DataFrame:
    """(lat, lon, d): mean square over epochs of the fields of (epoch, n, m, cs, v) on the quadrature grid, over its global mean.

    ``cap`` keeps it between 1 / cap and cap, and its mean at one.
    """
    lat, lon, w = special.quadrature(nmax)
    k = 2 * nmax + 2
    lat_deg, lon_deg, ring = np.degrees(lat[::k]), np.degrees(lon[:k]), w[::k]
    grid = transforms.synthesis(filtered, ["epoch"], nmax, lat_deg, lon_deg)
    weights = literal_table(filtered.sparkSession, ["lat", "w"], [(float(a), float(b)) for a, b in zip(lat_deg, ring)])
    d = grid.groupBy("lat", "lon").agg(F.avg(F.col("value") ** 2).alias("d")).join(weights, "lat")

    def scaled(x: DataFrame) -> DataFrame:
        mean = x.agg(F.sum(F.col("w") * F.col("d")).alias("mean"))  # one row
        return x.join(F.broadcast(mean)).withColumn("d", F.col("d") / F.col("mean")).drop("mean")

    d = scaled(d)
    if cap:
        d = scaled(d.withColumn("d", F.least(F.greatest("d", F.lit(1 / cap)), F.lit(cap))))
    return d.select("lat", "lon", "d")


def modulated(variances: dict[int, float], vmap: DataFrame, nmax: int, min_degree: int = 0, size: int = T.SIZE) -> DataFrame:
    """Lower tiles of S = G diag(v) G', G the analysis of the root of the map times the synthesis; a constant map gives diag(v).

    A tile of G is one group, which meets the map (a number for each grid point) and makes its own basis.
    """
    n, m, cs = index_arrays(nmax, min_degree)
    v = np.array([variances[int(k)] for k in n])
    count = -(-len(n) // size)
    shared = vmap.sparkSession.sparkContext.broadcast((n, m, cs, v))  # index vectors, set by nmax

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, cs, v = shared.value
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        _, _, w = special.quadrature(nmax)
        pdf = pdf.sort_values(["lat", "lon"])
        lat, lon = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
        one, two = (special.ylm(lat, lon, n[c], m[c], cs[c]) for c in (slice(k * size, (k + 1) * size) for k in (i, j)))
        return T._frame([(i, j, (one * (w * np.sqrt(pdf["d"].to_numpy()))[:, None]).T @ two * np.sqrt(v[j * size : (j + 1) * size]))])

    both = vmap.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    g = both.groupBy("i", "j").applyInPandas(run, T.TILE)
    return T.multiply(g, T.transposed(g), count, count, lower=True)


def monthly_power_law(spectrum: DataFrame) -> DataFrame:
    """Median amplitude and exponent of degree amplitudes by calendar month, from (epoch, n, variance of the degree).

    Every epoch's log amplitude, less the mean of its logarithm, is fitted against log n; a month without epochs takes the
    median of all. Returns month, a, b and its number of epochs.
    """
    from orbloom.functions.special import log_chi2_bias

    top = spectrum.agg(F.max("n")).first()[0] or 0
    bias = literal_table(spectrum.sparkSession, ["n", "bias"], [(n, log_chi2_bias(2.0 * n + 1)) for n in range(1, top + 1)])
    x = spectrum.where("n >= 1 AND variance > 0").join(bias, "n").withColumn("y", F.log(F.sqrt("variance")) - F.col("bias")).withColumn("x", F.log(F.col("n").cast("double")))
    fits = x.groupBy("epoch").agg(F.exp(F.regr_intercept("y", "x")).alias("a"), F.regr_slope("y", "x").alias("b"))
    month = F.greatest(F.lit(1), F.least(F.lit(12), 1 + F.floor(F.pmod(F.col("epoch"), F.lit(1.0)) * 12))).cast("int")
    each = fits.groupBy(month.alias("month")).agg(F.median("a").alias("ma"), F.median("b").alias("mb"), F.count("*").alias("epochs"))
    whole = fits.agg(F.median("a").alias("wa"), F.median("b").alias("wb"))  # one row
    months = spectrum.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(each, "month", "left").join(F.broadcast(whole)).select("month", F.coalesce("ma", "wa").alias("a"), F.coalesce("mb", "wb").alias("b"), F.coalesce("epochs", F.lit(0)).alias("epochs"))
