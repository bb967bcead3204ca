"""Deterministic models of time series: offset, trend, annual and semiannual terms, extra periods, hinges.

Sums of products over epochs are one aggregate (combined before the shuffle); only the small normal equations of
each series go through a numpy solver. ``series`` frames hold key columns, ``epoch`` and ``v``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.functions.special import f_test_p

TWO_PI = 6.283185307179586
STANDARD = ["bias", "trend", "cos_annual", "sin_annual", "cos_semiannual", "sin_semiannual"]


def design(t: Column, t0: float, periods: tuple[float, ...] = (), breaks: tuple[float, ...] = ()) -> dict[str, Column]:
    """Term name to basis expression."""
    x = t - t0
    out = {"bias": F.lit(1.0), "trend": x}
    for name, p in [("annual", 1.0), ("semiannual", 0.5), *[(f"period_{k}", p) for k, p in enumerate(periods, 1)]]:
        out |= {f"cos_{name}": F.cos(TWO_PI * x / p), f"sin_{name}": F.sin(TWO_PI * x / p)}
    return out | {f"hinge_{k}": F.greatest(t - b, F.lit(0.0)) for k, b in enumerate(breaks, 1)}


def _products(series: DataFrame, keys: list[str], t0: float, periods: tuple[float, ...], breaks: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """Sums of products of all terms (a0_0, a0_1, ...) and of terms and data (b0, ...) by key, sum of squares yy, n_epochs."""
    d = design(F.col("epoch"), t0, periods, breaks)
    w = F.col(weight) if weight else F.lit(1.0)
    x = series.where(F.col("v").isNotNull()).select(*keys, "v", w.alias("_w"), *[c.alias(f"x{i}") for i, c in enumerate(d.values())])
    k = len(d)
    sums = [F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col("_w") * F.col(f"x{i}") * F.col("v")).alias(f"b{i}") for i in range(k)]
    return x.groupBy(*keys).agg(*sums, F.sum(F.col("_w") * F.col("v") ** 2).alias("yy"), F.count("*").alias("n_epochs"))


def _normals(r: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrix and right side of the first k terms from a row of ``_products``."""
    return np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([r[f"b{i}"] for i in range(k)])


def fit(series: DataFrame, keys: list[str], t0: float, periods: tuple[float, ...] = (), breaks: tuple[float, ...] = (), weight: str | None = None) -> DataFrame:
    """term, coef and sigma by key, with residual variance and the number of epochs; sigma is null without freedom."""
    names = list(design(F.col("epoch"), t0, periods, breaks))
    k = len(names)
    g = _products(series, keys, t0, periods, breaks, weight)
    schema = ", ".join([f"`{c}` {g.schema[c].dataType.simpleString()}" for c in keys] + ["term string, coef double, sigma double, res_var double, n_epochs bigint"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a, b = _normals(r, k)
                c = np.linalg.lstsq(a, b, rcond=1e-13)[0]
                free = r["n_epochs"] - k
                var = max(r["yy"] - 2 * c @ b + c @ a @ c, 0.0) / free if free > 0 else None
                inv = np.diag(np.linalg.pinv(a, rcond=1e-13))
                out += [{**{q: r[q] for q in keys}, "term": t, "coef": float(c[i]), "sigma": float(np.sqrt(max(inv[i], 0) * var)) if var is not None else None, "res_var": var, "n_epochs": r["n_epochs"]} for i, t in enumerate(names)]
            yield pd.DataFrame(out, columns=[*keys, "term", "coef", "sigma", "res_var", "n_epochs"])

    return g.mapInPandas(solve, schema)


def evaluate(model: DataFrame, epochs: DataFrame, keys: list[str], t0: float, periods: tuple[float, ...] = (), breaks: tuple[float, ...] = ()) -> DataFrame:
    """Value of all terms at epochs; the model's terms become one row per key, so no rows multiply."""
    d = design(F.col("epoch"), t0, periods, breaks)
    wide = model.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == t, F.col("coef"))).alias(f"_c{i}") for i, t in enumerate(d)])
    value = sum((F.col(f"_c{i}") * c for i, c in enumerate(d.values())), F.lit(0.0))
    j = epochs.join(wide, keys) if set(keys) <= set(epochs.columns) else epochs.join(F.broadcast(wide))
    return j.withColumn("model", value).drop(*[f"_c{i}" for i in range(len(d))])


def residuals(series: DataFrame, keys: list[str], t0: float, **kw) -> DataFrame:
    model = fit(series, keys, t0, **kw)
    kw.pop("weight", None)
    return evaluate(model, series, keys, t0, **kw).withColumn("residual", F.col("v") - F.col("model"))


def detrend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Straight line off each series, in SQL sums only."""
    g = W.partitionBy(*keys)
    t, v = F.col("epoch") - F.avg("epoch").over(g), F.col("v") - F.avg("v").over(g)
    x = series.withColumn("_t", t).withColumn("_v", v)
    slope = F.sum(F.col("_t") * F.col("_v")).over(g) / F.nullif(F.sum(F.col("_t") * F.col("_t")).over(g), F.lit(0.0))
    return x.withColumn("trend", slope).withColumn("residual", F.col("_v") - F.coalesce(slope, F.lit(0.0)) * F.col("_t")).drop("_t", "_v")


def harmonic_residuals(series: DataFrame, keys: list[str], t0: float, terms: int = 6) -> DataFrame:
    """Residuals of the six-term model by modified Gram-Schmidt in windows: no Python, one shuffle on the keys."""
    g = W.partitionBy(*keys)
    x = series
    names = list(design(F.col("epoch"), t0))[:terms]
    for i, (_, c) in enumerate(list(design(F.col("epoch"), t0).items())[:terms]):
        x = x.withColumn(f"_q{i}", c)
    x = x.withColumn("residual", F.col("v"))
    for i in range(len(names)):
        norm = F.nullif(F.sum(F.col(f"_q{i}") * F.col(f"_q{i}")).over(g), F.lit(0.0))
        later = [*[f"_q{j}" for j in range(i + 1, len(names))], "residual"]
        x = x.withColumns({f"_p_{c}": F.sum(F.col(f"_q{i}") * F.col(c)).over(g) / norm for c in later})
        x = x.withColumns({c: F.col(c) - F.coalesce(F.col(f"_p_{c}"), F.lit(0.0)) * F.col(f"_q{i}") for c in later}).drop(*[f"_p_{c}" for c in later])
    return x.drop(*[f"_q{i}" for i in range(len(names))])


def remove_rate(coef: DataFrame, rate: DataFrame, t0: float, on: list[str]) -> DataFrame:
    """v - rate * (epoch - t0); a coefficient without a rate stays."""
    return coef.join(rate.select(*on, "rate"), on, "left").withColumn("v", F.col("v") - F.coalesce("rate", F.lit(0.0)) * (F.col("epoch") - t0)).drop("rate")


def ar1_inflation(resid: DataFrame, keys: list[str], n_terms: int) -> DataFrame:
    """Factor on sigmas for first-order autocorrelation of residuals, with its bias correction, clamped to [0, 0.99]."""
    o = W.partitionBy(*keys).orderBy("epoch")
    x = resid.withColumn("_p", F.lag("residual").over(o))
    r = F.sum(F.col("residual") * F.col("_p")) / F.nullif(F.sum(F.col("residual") ** 2), F.lit(0.0))
    t = x.groupBy(*keys).agg(F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(0.0)), F.lit(0.99)).alias("r"), F.count("*").alias("n"))
    t = t.withColumn("ar1", F.when(F.col("n") > n_terms + 2, F.least(F.greatest(F.col("r") + (1 + 3 * F.col("r")) / F.col("n"), F.lit(0.0)), F.lit(0.99))).otherwise(F.lit(0.0)))
    return t.select(*keys, "ar1", F.sqrt((1 + F.col("ar1")) / (1 - F.col("ar1"))).alias("inflation"))


def trend_breaks(series: DataFrame, keys: list[str], t0: float, breaks: tuple[float, ...], periods: tuple[float, ...] = ()) -> DataFrame:
    """F statistic and p value of hinges at the breaks against the model without them.

    One aggregate of products serves both models: that without hinges is the leading part of the normal equations.
    """
    k0 = 6 + 2 * len(periods)
    k1 = k0 + len(breaks)
    sums = _products(series, keys, t0, periods, breaks)
    schema = "".join(f"`{c}` {sums.schema[c].dataType.simpleString()}, " for c in keys) + "sse0 double, n_epochs bigint, sse1 double, f_stat double, p_value double"

    def test(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n, sse = r["n_epochs"], []
                for k in (k0, k1):
                    a, b = _normals(r, k)
                    c = np.linalg.lstsq(a, b, rcond=1e-13)[0]
                    sse.append(max(r["yy"] - 2 * c @ b + c @ a @ c, 0.0) if n > k else None)
                f = (sse[0] - sse[1]) / len(breaks) / (sse[1] / (n - k1)) if sse[1] else None
                out.append((*[r[c] for c in keys], sse[0], n, sse[1], f, f_test_p(f, len(breaks), n - k1) if f is not None else None))
            yield pd.DataFrame(out, columns=[*keys, "sse0", "n_epochs", "sse1", "f_stat", "p_value"])

    return sums.mapInPandas(test, schema)


def remove_alias(series: DataFrame, keys: list[str], t0: float, period: float = 161 / 365.25, phase_deg: float = 100.0, split: float = 2018.0) -> DataFrame:
    """Fits the six terms and one aliased tide, whose phase jumps at ``split``, and takes only the tide off."""
    def arg(t):
        return 2 * np.pi * (t - t0) / period + np.where(t >= split, np.deg2rad(phase_deg), 0.0)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x = pdf["epoch"].to_numpy(), pdf["epoch"].to_numpy() - t0
        a = np.column_stack([np.ones_like(x), x, *[f(2 * np.pi * k * x) for k in (1, 2) for f in (np.cos, np.sin)], np.cos(arg(t)), np.sin(arg(t))])
        if len(t) <= a.shape[1]:
            raise ValueError("too few epochs to separate the aliased tide")
        c = np.linalg.lstsq(a, pdf["v"].to_numpy(), rcond=None)[0]
        return pdf.assign(v=pdf["v"] - a[:, -2:] @ c[-2:])

    return series.groupBy(*keys).applyInPandas(kernel, series.schema)


def robust_fit(series: DataFrame, keys: list[str], t0: float, k: float = 1.5, most: int = 10) -> DataFrame:
    """Huber regression of the six terms by reweighting; one series is one group."""
    schema = ", ".join([f"`{c}` {series.schema[c].dataType.simpleString()}" for c in keys] + ["term string, coef double, sigma double"])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["epoch"].to_numpy() - t0, pdf["v"].to_numpy()
        a = np.column_stack([np.ones_like(x), x, *[f(2 * np.pi * q * x) for q in (1, 2) for f in (np.cos, np.sin)]])
        c, w = np.linalg.lstsq(a, y, rcond=None)[0], np.ones_like(y)
        for _ in range(most):
            r = y - a @ c
            scale = 1.4826 * np.median(np.abs(r - np.median(r)))
            if scale <= 0:
                break
            w = np.minimum(1, k / np.maximum(np.abs(r) / scale, 1e-16))
            sw = np.sqrt(w)
            new = np.linalg.lstsq(a * sw[:, None], y * sw, rcond=None)[0]
            done = np.linalg.norm(new - c) <= 1e-12 * max(np.linalg.norm(c), 1)
            c = new
            if done:
                break
        var = (w * (y - a @ c) ** 2).sum() / max(len(y) - 6, 1)
        sigma = np.sqrt(np.maximum(np.diag(np.linalg.pinv((a * w[:, None]).T @ a)) * var, 0)) if len(y) > 6 else np.full(6, np.nan)
        return pd.DataFrame({**{q: [pdf[q].iloc[0]] * 6 for q in keys}, "term": STANDARD, "coef": c, "sigma": sigma})

    return series.where(F.col("v").isNotNull()).groupBy(*keys).applyInPandas(kernel, schema)


def model_mean(series: DataFrame, keys: list[str], first: float, last: float) -> DataFrame:
    """Mean over a window from a harmonic fit about its centre: offset plus each cosine's mean over the window."""
    mid, width = (first + last) / 2, last - first
    m = fit(series.where(F.col("epoch").between(first, last)), keys, mid)
    f = F.when(F.col("term") == "bias", 1.0).when(F.col("term") == "cos_annual", float(np.sinc(width))).when(F.col("term") == "cos_semiannual", float(np.sinc(2 * width))).otherwise(0.0)
    return m.groupBy(*keys).agg(F.sum(F.col("coef") * f).alias("v"), F.sqrt(F.sum((F.col("sigma") * f) ** 2)).alias("s"))
