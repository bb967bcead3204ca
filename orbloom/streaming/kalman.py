"""Sequential estimation on streams: the Kalman filter's state lives between micro-batches.

Late epochs (older than the last one of their series) are dropped and counted in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbloom.functions.special import chi2_quantile
from orbloom.operators.kalman import Process
from orbloom.operators.sequential import kalman_step

OUT = "key string, epoch double, v double, filtered double, filtered_var double, flagged boolean"
STATE = "x double, p double, last double, late bigint, started boolean"


def stream_filter(stream: DataFrame, phi: float, q: float, r: float, sigma0: float, reject: float | None = None) -> DataFrame:
    """Scalar AR(1) filter of a stream (key, epoch, v); each series advances as its epochs arrive."""
    f, qq, rr = np.array([[phi]]), np.array([[q]]), np.array([[r]])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p, last, late, started = state.get if state.exists else (0.0, sigma0, float("-inf"), 0, False)
        rows = []
        for e, v in pd.concat(list(batches)).sort_values("epoch")[["epoch", "v"]].itertuples(index=False):
            if e <= last:
                late += 1
                continue
            obs = None if v is None or v != v else (np.array([v]), rr)
            xs, ps, _, _, bad = kalman_step(np.array([x]), np.array([[p]]), f, qq, obs, not started, reject)
            x, p, last, started = float(xs[0]), float(ps[0, 0]), float(e), True
            rows.append((key[0], e, v, x, p, bad))
        state.update((x, p, last, late, started))
        yield pd.DataFrame(rows, columns=["key", "epoch", "v", "filtered", "filtered_var", "flagged"])

    s = stream.select(F.col("key").cast("string").alias("key"), F.col("epoch").cast("double").alias("epoch"), F.col("v").cast("double").alias("v"))
    return s.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


VECTOR_OUT = "key string, epoch double, x array<double>, sigma array<double>, gap boolean, rejected boolean"
VECTOR_STATE = "x array<double>, p array<double>, last double, late bigint"


def stream_vectors(stream: DataFrame, models: dict[str, Process], alpha: float | None = None) -> DataFrame:
    """The vector filter of a stream (key, epoch, l, r): values with variances, or a gap where l is null.

    ``models`` has the process of each key; state and covariance of a key live between micro-batches.  With ``alpha``,
    an epoch whose innovation is beyond that level does not enter.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        process = models[key[0]]
        x, p, last, late = state.get if state.exists else (np.zeros(process.size), process.s0.ravel(), float("-inf"), 0)
        x, p, rows = np.asarray(x, float), np.asarray(p, float).reshape(process.size, process.size), []
        for r in pd.concat(list(batches)).sort_values("epoch").to_dict("records"):
            if r["epoch"] <= last:
                late += 1
                continue
            obs = process.observed(r | {"normal": None, "right": None})
            new = process.step(x, p, obs, False)
            bad = alpha is not None and new[3] is not None and new[3] > chi2_quantile(1 - alpha, new[4])
            x, p = process.step(x, p, obs, True)[:2] if bad else new[:2]
            last = float(r["epoch"])
            rows.append((key[0], last, x[: process.p].tolist(), np.sqrt(np.maximum(np.diag(p)[: process.p], 0)).tolist(), obs is None, bad))
        state.update((x.tolist(), p.ravel().tolist(), last, late))
        yield pd.DataFrame(rows, columns=["key", "epoch", "x", "sigma", "gap", "rejected"])

    s = stream.select(F.col("key").cast("string").alias("key"), F.col("epoch").cast("double").alias("epoch"), "l", "r")
    return s.groupBy("key").applyInPandasWithState(step, VECTOR_OUT, VECTOR_STATE, "append", GroupStateTimeout.NoTimeout)


def session_clusters(stream: DataFrame, time: str, keys: list[str], gap: str, watermark: str) -> DataFrame:
    """Groups of events closer than ``gap``; closed groups leave once the watermark has passed them."""
    return stream.withWatermark(time, watermark).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def hourly_means(stream: DataFrame, time: str, keys: list[str], value: str, watermark: str) -> DataFrame:
    """Tumbling hourly means of late-tolerant events."""
    return stream.withWatermark(time, watermark).groupBy(*keys, F.window(time, "1 hour").alias("w")).agg(F.avg(value).alias("v"), F.count("*").alias("n"))
