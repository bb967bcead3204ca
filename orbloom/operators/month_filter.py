"""Filter operators that change from epoch to epoch: a table of blocks, applied forward and transposed, and what it resolves.

In a block (order, C/S, parity of the degree) signal S and noise N share the eigenvectors of the pair, so the filter of
an epoch with noise factor s is W = V diag(lam / (lam + s)) U.  The table has a row (m, cs, parity, degrees, lam, v, u)
for each block, with V and U row by row; its size is set by the largest degree.  It comes from block covariances,
which Spark sums; no task holds more epochs than its share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions import special

BLOCK = ["m", "cs", "parity"]
OPERATOR = "m int, cs int, parity int, degrees array<int>, lam array<double>, v array<double>, u array<double>"


def block_operator(total: np.ndarray, shrinkage: float = 0.1, iterations: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lam, V and U from the covariance of the residuals of a block; the signal's variances are iterated."""
    diag = np.diag(np.diag(total))
    total = (1 - shrinkage) * total + shrinkage * diag + np.eye(len(total)) * 1e-10 * max(np.diag(total).min(), 1e-300)
    signal = 0.5 * diag
    for _ in range(iterations):
        noise = total - signal
        noise = noise + np.eye(len(total)) * max(0.0, 1e-8 * np.trace(total) - np.linalg.eigvalsh(noise).min())
        g = signal @ np.linalg.inv(signal + noise)
        signal = np.diag(np.maximum((g @ total @ g.T + (np.eye(len(total)) - g) @ signal).diagonal(), 1e-12 * np.trace(total)))
    root = np.linalg.cholesky(noise)
    inv = np.linalg.inv(root)
    lam, v = np.linalg.eigh(inv @ signal @ inv.T)
    return np.maximum(lam, 0), root @ v, v.T @ inv


def operator_table(covariance: DataFrame, shrinkage: float = 0.1, iterations: int = 3) -> DataFrame:
    """The operator of every block from covariance rows (m, cs, parity, n1 <= n2, cov)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        degrees = np.unique(np.concatenate([pdf["n1"], pdf["n2"]]))
        at = {int(n): k for k, n in enumerate(degrees)}
        c = np.zeros((len(at), len(at)))
        for a, b, x in zip(pdf["n1"], pdf["n2"], pdf["cov"]):
            c[at[int(a)], at[int(b)]] = c[at[int(b)], at[int(a)]] = x
        lam, v, u = block_operator(c, shrinkage, iterations)
        return pd.DataFrame({**{k: [int(pdf[k].iloc[0])] for k in BLOCK}, "degrees": [degrees.astype("int32")], "lam": [lam], "v": [v.ravel()], "u": [u.ravel()]})

    return covariance.where("cov IS NOT NULL").groupBy(*BLOCK).applyInPandas(run, OPERATOR)


def apply(operator: DataFrame, coef: DataFrame, keys: list[str], factor: str | None = None, transpose: bool = False) -> DataFrame:
    """W x, or W' x, of every set: (keys, n, m, cs, v, sigma); ``factor`` is the column with the set's noise factor (1 without).

    sigma is the square root of the posterior variance that the forward filter leaves.  Sets and operators meet by an
    equi-join on the block, one packed row for each set and block.
    """
    f = F.col(factor) if factor else F.lit(1.0)
    rows = coef.withColumn("parity", (F.col("n") % 2).cast("int")).groupBy(*keys, *BLOCK).agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("x"), F.first(F.coalesce(f, F.lit(1.0))).alias("factor"))
    met = rows.select(*keys, *BLOCK, F.col("x.n").alias("n"), F.col("x.v").alias("x"), "factor").join(operator, BLOCK)
    schema = "".join(f"`{k}` {coef.schema[k].dataType.simpleString()}, " for k in keys) + "m int, cs int, n array<int>, v array<double>, sigma array<double>"

    def run(batches):
        for pdf in batches:
            out, sig = [], []
            for n, d, x, s, lam, v, u in zip(pdf["n"], pdf["degrees"], pdf["x"], pdf["factor"], pdf["lam"], pdf["v"], pdf["u"]):
                if len(n) != len(d) or (np.asarray(n) != np.asarray(d)).any():
                    raise ValueError(f"a set has degrees {list(n)}, its operator {list(d)}")
                k = len(d)
                v, u, keep = np.reshape(v, (k, k)), np.reshape(u, (k, k)), lam / (lam + s)
                out.append(u.T @ (keep * (v.T @ x)) if transpose else v @ (keep * (u @ x)))
                sig.append(np.sqrt(np.maximum((v * v) @ (keep * s), 0)))
            yield pdf[[*keys, "m", "cs", "n"]].assign(v=out, sigma=sig)

    flat = met.mapInPandas(run, schema).select(*keys, "m", "cs", F.explode(F.arrays_zip("n", "v", "sigma")).alias("y"))
    return flat.select(*keys, F.col("y.n").alias("n"), "m", "cs", F.col("y.v").alias("v"), F.col("y.sigma").alias("sigma"))


RESOLUTION = "half_deg array<double>, km_mean double, km_min double, km_max double, anisotropy double"


def half_widths(kernel, lat: float, lon: float, azimuths: int = 8, reach: float = 20.0, samples: int = 120) -> np.ndarray:
    """Distance in degrees at which ``kernel`` (of latitudes and longitudes in radians) is down to half its peak, by azimuth; NaN beyond the reach."""
    az = np.radians(np.arange(azimuths) * 360 / azimuths)[:, None]
    psi = np.linspace(0, reach, samples)
    d = np.radians(psi)[None, :]
    la, lo = np.radians(lat), np.radians(lon)
    lat2 = np.arcsin(np.clip(np.sin(la) * np.cos(d) + np.cos(la) * np.sin(d) * np.cos(az), -1, 1))
    lon2 = lo + np.arctan2(np.sin(az) * np.sin(d) * np.cos(la), np.cos(d) - np.sin(la) * np.sin(lat2))
    v = kernel(lat2.ravel(), lon2.ravel()).reshape(azimuths, samples)
    half = kernel(np.array([la]), np.array([lo]))[0] / 2
    out = np.full(azimuths, np.nan)
    for k, row in enumerate(v):
        below = np.flatnonzero(row[1:] <= half)
        if len(below):
            q = below[0] + 1
            out[k] = psi[q - 1] + (row[q - 1] - half) / max(row[q - 1] - row[q], np.finfo(float).eps) * (psi[q] - psi[q - 1])
    return out


def resolution_map(operator: DataFrame, points: DataFrame, factor: str | None = None, azimuths: int = 8, reach: float = 20.0, samples: int = 120, radius_km: float = 6371.0) -> DataFrame:
    """How far the filter of a point's epoch smears it: adds half widths by azimuth, their mean and extremes in km, and the ratio of the extremes.

    The field at a point is y' W x, so W' y holds the kernel's coefficients.  Points are rows (lat, lon, and the factor of
    their epoch) and go through in batches; the operator, whose size is set by the largest degree, is sent to the tasks.
    """
    blocks = [(r.m, r.cs, np.array(r.degrees), np.array(r.lam), np.array(r.v).reshape(len(r.lam), -1), np.array(r.u).reshape(len(r.lam), -1)) for r in operator.collect()]
    shared = points.sparkSession.sparkContext.broadcast(blocks)
    f = F.coalesce(F.col(factor), F.lit(1.0)) if factor else F.lit(1.0)
    names = points.columns
    schema = ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in points.schema] + [RESOLUTION])

    def run(batches):
        own = shared.value
        n = np.concatenate([b[2] for b in own])
        m, cs = (np.concatenate([np.full(len(b[2]), b[k]) for b in own]) for k in (0, 1))
        cut = np.cumsum([0, *(len(b[2]) for b in own)])
        for pdf in batches:
            half = []
            for lat, lon, s in zip(pdf["lat"], pdf["lon"], pdf["_factor"]):
                y = special.ylm(np.radians([lat]), np.radians([lon]), n, m, cs)[0]
                k = np.concatenate([u.T @ (lam / (lam + s) * (v.T @ y[a:b])) for (_, _, _, lam, v, u), a, b in zip(own, cut, cut[1:])])
                half.append(half_widths(lambda la, lo: special.ylm(la, lo, n, m, cs) @ k, lat, lon, azimuths, reach, samples))
            km = [np.radians(h) * radius_km for h in half]
            some = [k[np.isfinite(k)] for k in km]
            lo, hi, mean = ([(f(x) if len(x) else None) for x in some] for f in (np.min, np.max, np.mean))
            yield pdf[names].assign(half_deg=[[None if np.isnan(x) else float(x) for x in h] for h in half], km_mean=mean, km_min=lo, km_max=hi, anisotropy=[b / a if a else None for a, b in zip(lo, hi)])

    return points.withColumn("_factor", f).mapInPandas(run, schema)
