"""Geocentre from ocean places only: three degree-1 patterns and a mass term, by least squares at every epoch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions.special import R_EARTH, RHO_EARTH, RHO_WATER


def degree1_patterns(k1: float):
    """Water height of unit C10, C11 and S11 as expressions over lat and lon in degrees."""
    scale = R_EARTH * RHO_EARTH / RHO_WATER / (1 + k1) * 3**0.5
    phi, lam = F.radians("lat"), F.radians("lon")
    return [scale * F.sin(phi), scale * F.cos(phi) * F.cos(lam), scale * F.cos(phi) * F.sin(lam)]


def estimate_degree1(ocean: DataFrame, k1: float) -> DataFrame:
    """(epoch, lat, lon, value) of ocean places to (epoch, c10, c11, s11, mass) with sigmas.

    The normal equations are one aggregate per epoch (combined before the shuffle); only 4 x 4 systems are solved in
    Python. Columns are scaled to unit length first.
    """
    p = [*degree1_patterns(k1), F.lit(1.0)]
    w = F.cos(F.radians("lat"))
    x = ocean.where(F.col("value").isNotNull()).select("epoch", "value", w.alias("_w"), *[c.alias(f"x{k}") for k, c in enumerate(p)])
    sums = [F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)]
    g = x.groupBy("epoch").agg(*sums, *[F.sum(F.col("_w") * F.col(f"x{i}") * F.col("value")).alias(f"b{i}") for i in range(4)], F.sum(F.col("_w") * F.col("value") ** 2).alias("yy"), F.count("*").alias("n"))
    names = ["c10", "c11", "s11", "mass"]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
                b = np.array([r[f"b{i}"] for i in range(4)])
                d = 1 / np.sqrt(np.diag(a))
                s = a * d[:, None] * d
                c = d * np.linalg.solve(s, d * b)
                var = max(r["yy"] - c @ b, 0.0) / max(r["n"] - 4, 1)
                sig = np.sqrt(np.diag(np.linalg.inv(s)) * d * d * var)
                out.append({"epoch": r["epoch"], **dict(zip(names, c)), **{f"sigma_{k}": v for k, v in zip(names, sig)}, "condition": float(np.linalg.cond(s))})
            yield pd.DataFrame(out, columns=["epoch", *names, *[f"sigma_{k}" for k in names], "condition"])

    return g.mapInPandas(solve, ", ".join(f"{c} double" for c in ["epoch", *names, *[f"sigma_{k}" for k in names], "condition"]))
