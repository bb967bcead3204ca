"""Sequential estimation: vector autoregression, Kalman filter, smoothing.

The matrix recursions are numpy functions over one ordered series; Spark runs one series per group, and the
streaming form (``orbloom.streaming.kalman``) keeps the same state between micro-batches.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions.special import chi2_quantile
from orbloom.operators.kalman import companion, yule_walker


def lag_covariances(series: DataFrame, keys: list[str], value: str, lags: int, step: float) -> DataFrame:
    """Products of centred values ``h`` steps apart over the number of epochs, for h = 0 .. lags (an equi-join)."""
    from pyspark.sql import Window as W

    g = W.partitionBy(*keys)
    x = series.select(*keys, F.round(F.col("epoch") / step).cast("long").alias("k"), (F.col(value) - F.avg(value).over(g)).alias("a"), F.count("*").over(g).alias("t"))
    y = x.select(*keys, "k", F.col("a").alias("b")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("k", F.col("k") + F.col("h"))
    return x.join(y, [*keys, "k"]).groupBy(*keys, "h").agg((F.sum(F.col("a") * F.col("b")) / F.max("t")).alias("cov"))


def fit_var(x: np.ndarray, order: int = 1, shrink: float = 0.0, structure: str = "full", blocks: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Yule-Walker coefficients [order, P, P], innovation covariance and stationary covariance of x [P, T]."""
    p, t = x.shape
    x = x - x.mean(axis=1, keepdims=True)
    mask = np.ones((p, p), bool)
    if structure == "diagonal":
        mask = np.eye(p, dtype=bool)
    elif structure == "blocks":
        mask = np.zeros((p, p), bool)
        if sorted(np.concatenate([np.asarray(b) for b in blocks or [[]]]).tolist()) != list(range(p)):
            raise ValueError(f"blocks must part 0 .. {p - 1}")
        for b in blocks:
            mask[np.ix_(b, b)] = True
    elif structure != "full":
        raise ValueError(f"unknown structure: {structure}")
    return _yule_walker([x[:, h:] @ x[:, : t - h].T / (t - h) * mask for h in range(order + 1)], shrink)


def _yule_walker(products: list[np.ndarray], shrink: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the covariances at lags 0 .. order; ``shrink`` times the mean variance is added to the diagonal at lag 0."""
    p = len(products[0])
    cov = [products[0] + shrink * np.trace(products[0]) / p * np.eye(p), *products[1:]]
    parts, q, stationary, radius = yule_walker(cov)
    if radius >= 1:
        warnings.warn(f"the process is not stationary: spectral radius {radius:.4f}", stacklevel=3)
    w, v = np.linalg.eigh(q)
    return parts, (v * np.maximum(w, 1e-12 * max(w.max(), 1e-300))) @ v.T, stationary


def fit_var_series(series: DataFrame, time: str, vector: str, shrink: float = 0.0) -> np.ndarray:
    """First-order coefficients [P, P] of one series of any length, with a vector in each row.

    Ranges of time are summed apart; the driver adds what spans two ranges from their first and last vectors.
    """
    means = series.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
    mean = np.array([r.v for r in means])
    p = len(mean)
    if not p:
        return np.zeros((0, 0))
    kind = series.schema[time].dataType.simpleString()

    def run(batches):
        first = last = None
        start, count, zero, one = None, 0, np.zeros((p, p)), np.zeros((p, p))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()) - mean
            if first is None:
                start, first = pdf["t"].iloc[0], x[0]
            else:
                one += np.outer(x[0], last)
            zero += x.T @ x
            one += x[1:].T @ x[:-1]
            last, count = x[-1], count + len(x)
        if count:
            yield pd.DataFrame({"t": [start], "count": [count], "first": [first], "last": [last], "zero": [zero.ravel()], "one": [one.ravel()]})

    ordered = series.select(F.col(time).alias("t"), F.col(vector).alias("x")).repartitionByRange("t").sortWithinPartitions("t")
    parts = sorted(ordered.mapInPandas(run, f"t {kind}, count long, first array<double>, last array<double>, zero array<double>, one array<double>").collect(), key=lambda r: r.t)
    t = sum(r["count"] for r in parts)
    zero, one = (sum(np.array(r[k]).reshape(p, p) for r in parts) for k in ("zero", "one"))
    one = one + sum((np.outer(b.first, a.last) for a, b in zip(parts, parts[1:])), np.zeros((p, p)))
    return _yule_walker([zero / t, one / max(t - 1, 1)], shrink)[0][0]


@dataclass
class Filtered:
    x: list[np.ndarray] = field(default_factory=list)
    p: list[np.ndarray] = field(default_factory=list)
    x_pred: list[np.ndarray] = field(default_factory=list)
    p_pred: list[np.ndarray] = field(default_factory=list)
    gap: list[bool] = field(default_factory=list)
    flagged: list[bool] = field(default_factory=list)


def kalman_step(x: np.ndarray, p: np.ndarray, f: np.ndarray, q: np.ndarray, obs, first: bool = False, reject: float | None = None, observe: np.ndarray | None = None):
    """One epoch: prediction and, unless obs is None, the update in Joseph form.

    ``obs`` is (values, covariance) or, as ("normal", N, b), normal equations of the state. With ``reject``, an
    innovation beyond that chi-square probability is not used. Returns x, P, predicted x, predicted P, flagged.
    """
    if not first:
        x, p = f @ x, f @ p @ f.T + q
    xp, pp = x, p
    if obs is None:
        return x, p, xp, pp, False
    if isinstance(obs[0], str):
        _, n, b = obs
        k = len(b)
        h = np.eye(k, len(x))
        root = np.linalg.inv(p)
        info = root + h.T @ n @ h
        new_p = np.linalg.inv(info)
        return new_p @ (root @ x + h.T @ b), (new_p + new_p.T) / 2, xp, pp, False
    z, r = obs
    h = np.eye(len(z), len(x)) if observe is None else observe
    v = z - h @ x
    s = h @ p @ h.T + r
    flagged = reject is not None and float(v @ np.linalg.solve(s, v)) > chi2_quantile(1 - reject, len(z))
    if flagged:
        return x, p, xp, pp, True
    gain = np.linalg.solve(s, h @ p).T
    a = np.eye(len(x)) - gain @ h
    p = a @ p @ a.T + gain @ r @ gain.T
    return x + gain @ v, (p + p.T) / 2, xp, pp, False


def kalman(phi: np.ndarray, q: np.ndarray, sigma0: np.ndarray, observations: list, reject: float | None = None) -> Filtered:
    """Forward filter over one series; None is a gap, which only predicts."""
    order, p, _ = phi.shape
    f = companion(phi)
    big_q = np.zeros_like(f)
    big_q[:p, :p] = q
    x, cov = np.zeros(order * p), np.kron(np.eye(order), sigma0)
    out = Filtered()
    for k, obs in enumerate(observations):
        x, cov, xp, pp, bad = kalman_step(x, cov, f, big_q, obs, k == 0, reject)
        for name, val in (("x", x), ("p", cov), ("x_pred", xp), ("p_pred", pp), ("gap", obs is None), ("flagged", bad)):
            getattr(out, name).append(val)
    return out


def smooth(filtered: Filtered, phi: np.ndarray, lag: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rauch-Tung-Striebel smoother, over the whole series or with the next ``lag`` epochs only."""
    f = companion(phi)
    t = len(filtered.x)

    def sweep(last: int, first: int) -> tuple[list, list]:
        xs, ps = [filtered.x[last]], [filtered.p[last]]
        for k in range(last - 1, first - 1, -1):
            g = np.linalg.solve(filtered.p_pred[k + 1].T, (filtered.p[k] @ f.T).T).T
            xs.insert(0, filtered.x[k] + g @ (xs[0] - filtered.x_pred[k + 1]))
            ps.insert(0, filtered.p[k] + g @ (ps[0] - filtered.p_pred[k + 1]) @ g.T)
        return xs, ps

    if lag is None:
        return sweep(t - 1, 0)
    pairs = [sweep(min(t - 1, k + lag), k) for k in range(t)]
    return [x[0] for x, _ in pairs], [p[0] for _, p in pairs]


def kalman_series(series: DataFrame, keys: list[str], phi: float, q: float, r: float, sigma0: float, reject: float | None = None, smoother: bool = True) -> DataFrame:
    """Scalar AR(1) filter and smoother of each series (a null value is a gap); one series is one ordered group."""
    schema = ", ".join([f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys] + ["epoch double, v double, filtered double, filtered_var double, smoothed double, smoothed_var double, gap boolean, flagged boolean"])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        obs = [None if v != v or v is None else (np.array([v]), np.array([[r]])) for v in pdf["v"]]
        f = kalman(np.array([[[phi]]]), np.array([[q]]), np.array([[sigma0]]), obs, reject)
        xs, ps = smooth(f, np.array([[[phi]]])) if smoother else (f.x, f.p)
        return pdf[[*keys, "epoch", "v"]].assign(filtered=[x[0] for x in f.x], filtered_var=[p[0, 0] for p in f.p], smoothed=[x[0] for x in xs], smoothed_var=[p[0, 0] for p in ps], gap=f.gap, flagged=f.flagged)

    return series.select(*keys, "epoch", "v").groupBy(*keys).applyInPandas(kernel, schema)
