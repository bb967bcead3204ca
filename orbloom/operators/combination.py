"""Combination of several solutions, decompositions, uncertainty by simulation."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.operators import batches


def weighted_mean(coef: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over sources by inverse variance, with its sigma."""
    w = 1 / F.nullif(F.col("s") * F.col("s"), F.lit(0.0))
    return coef.groupBy(*keys).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"), F.sqrt(1 / F.sum(w)).alias("s"), F.count("*").alias("n_sources"))


def combine_sources(coef: DataFrame, source: str, keys: list[str], iterations: int = 6, robust: bool = False) -> DataFrame:
    """Mean over sources with a variance factor per (source, epoch), re-estimated from the residuals.

    Each pass is two aggregates: the weighted mean by coefficient and the factor by source and epoch.  Factors are
    few (sources times epochs), coefficients never leave Spark.
    """
    x = coef.withColumn("_w0", 1 / F.nullif(F.col("s") * F.col("s"), F.lit(0.0)))
    factor = x.select(source, *keys).distinct().withColumn("f", F.lit(1.0))
    on = [*keys, "n", "m", "cs"]
    mean = None
    for _ in range(iterations):
        y = x.join(factor, [source, *keys]).withColumn("_w", F.col("_w0") / F.col("f"))
        mean = y.groupBy(*on).agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v_mean"), F.sum("_w").alias("_sw"))
        z = y.join(mean, on)
        q, r = F.col("_w0") * (F.col("v") - F.col("v_mean")) ** 2, 1 - F.col("_w") / F.col("_sw")
        est = F.median(q / F.nullif(r, F.lit(0.0))) if robust else F.sum(q) / F.greatest(F.sum(r), F.lit(1e-12))
        factor = z.groupBy(source, *keys).agg(F.greatest(est, F.lit(1e-300)).alias("f"))
        factor = factor.checkpoint() if factor.sparkSession.sparkContext.getCheckpointDir() else factor
    return mean.select(*on, F.col("v_mean").alias("v"), F.sqrt(1 / F.col("_sw")).alias("s"))


def accumulate_normals(normals: DataFrame, keys: list[str], variance: str) -> DataFrame:
    """Sum of normal-equation entries (i, j, value) over their variance factors."""
    return normals.groupBy(*keys, "i", "j").agg(F.sum(F.col("value") / F.nullif(F.col(variance), F.lit(0.0))).alias("value"))


def combine_normals(parts: list[tuple[np.ndarray, np.ndarray, float, int]], most: int = 20, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Solves sum N / s x = sum b / s with variance factors s from each part's own residual and redundancy.

    A part is (N, b, l'Pl, number of observations). Returns x and the factors.
    """
    s = np.ones(len(parts))
    x = np.zeros(len(parts[0][1]))
    for _ in range(most):
        n = sum(a / f for (a, _, _, _), f in zip(parts, s))
        x = np.linalg.solve(n, sum(b / f for (_, b, _, _), f in zip(parts, s)))
        inv = np.linalg.inv(n)
        new = np.array([max((l - 2 * b @ x + x @ a @ x), 1e-300) / max(k - np.trace(inv @ a) / f, 1e-9) for (a, b, l, k), f in zip(parts, s)])
        done = np.abs(new / s - 1).max() < tol
        s = new
        if done:
            break
    return x, s


def compare_sets(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Differences of two sets in one row per key: RMS, correlation, and chi-square per coefficient."""
    j = a.join(b.select(*on, F.col("v").alias("w"), F.col("s").alias("t")), on)
    d = F.col("v") - F.col("w")
    return j.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rms_diff"), F.corr("v", "w").alias("corr"),
        F.avg(d * d / F.nullif(F.col("s") ** 2 + F.col("t") ** 2, F.lit(0.0))).alias("chi2_per_dof"),
    )


def gram(series: DataFrame, time: str, on: list[str], value: str) -> DataFrame:
    """Time-by-time products summed over space: T x T entries however many places there are (a self-join on place)."""
    x = series.select(*on, F.col(time).alias("t1"), F.col(value).alias("a"))
    y = series.select(*on, F.col(time).alias("t2"), F.col(value).alias("b"))
    return x.join(y, on).where("t1 <= t2").groupBy("t1", "t2").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def place_gram(series: DataFrame, time: str, place: str, value: str, places: int) -> np.ndarray:
    """Place-by-place products summed over time: one vector per epoch, a P x P sum for each task."""
    packed = series.where(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(time).agg(F.collect_list(place).alias("p"), F.collect_list(value).alias("a"))

    def run(batches):
        g = np.zeros((places, places))
        for pdf in batches:
            x = np.zeros((len(pdf), places))
            for k, (p, a) in enumerate(zip(pdf["p"], pdf["a"])):
                np.add.at(x[k], p, a)
            g += x.T @ x
        if g.any():
            yield pd.DataFrame({"i": range(places), "g": list(g)})

    out = np.zeros((places, places))
    sums = packed.select("p", "a").mapInPandas(run, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g"))
    for r in sums.groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r.i, r.j] = r.g
    return (out + out.T) / 2


def eof(series: DataFrame, time: str, on: list[str], value: str, modes: int = 6) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Modes (place, mode, pattern), principal components (time, mode, pc) and explained shares.

    From the Gram matrix over epochs or over places, whichever are fewer; it goes to the driver.
    """
    spark = series.sparkSession
    from pyspark.sql import Window as W

    kind = series.schema[time].dataType.simpleString()
    epochs, places = series.select(time).distinct().count(), series.select(*on).distinct().count()
    if not epochs:
        return series.select(*on, F.lit(0).alias("mode"), F.lit(0.0).alias("pattern")), series.select(time, F.lit(0).alias("mode"), F.lit(0.0).alias("pc")), np.zeros(0)
    if epochs > places:
        at = series.groupBy(*on).agg(F.avg(value).alias("_mean")).collect()
        number = spark.createDataFrame([(*[r[c] for c in on], r["_mean"], k) for k, r in enumerate(at)], ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in on) + ", _mean double, _p int")
        x = series.join(F.broadcast(number), on).select(*on, time, "_p", (F.col(value) - F.col("_mean")).alias("_a"))
        lam, v = np.linalg.eigh(place_gram(x, time, "_p", "_a", places))
        lam, v = np.maximum(lam[::-1], 0), v[:, ::-1]
        k = min(modes, places)
        patterns = spark.createDataFrame([(*[r[c] for c in on], j, float(v[i, j])) for i, r in enumerate(at) for j in range(k)], ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in on) + ", mode int, pattern double")
        pcs = x.join(F.broadcast(patterns), on).groupBy(time, "mode").agg(F.sum(F.col("_a") * F.col("pattern")).alias("pc"))
        return patterns, pcs, lam[:k] / max(lam.sum(), 1e-300)
    times = [r[0] for r in series.select(time).distinct().orderBy(time).collect()]
    x = series.select(*on, time, (F.col(value) - F.avg(value).over(W.partitionBy(*on))).alias("_a"))
    at = {t: k for k, t in enumerate(times)}
    g = np.zeros((len(times), len(times)))
    for r in gram(x, time, on, "_a").collect():
        g[at[r.t1], at[r.t2]] = g[at[r.t2], at[r.t1]] = r.g
    lam, v = np.linalg.eigh(g)
    lam, v = np.maximum(lam[::-1], 0), v[:, ::-1]
    k = min(modes, len(times))
    scale = np.sqrt(np.maximum(lam[:k], 1e-300))
    load = spark.createDataFrame([(t, j, float(v[i, j] / scale[j]), float(v[i, j] * scale[j])) for i, t in enumerate(times) for j in range(k)], f"`{time}` {kind}, mode int, _w double, pc double")
    patterns = x.join(F.broadcast(load), time).groupBy(*on, "mode").agg(F.sum(F.col("_a") * F.col("_w")).alias("pattern"))
    return patterns, load.select(time, "mode", "pc"), lam[:k] / max(lam.sum(), 1e-300)


def noise_median(ratio: float) -> float:
    """Median of the eigenvalues that unit noise alone would give for places over epochs = ``ratio``.

    The density is integrated over the angle that maps to 1 + ratio + 2 sqrt(ratio) cos(angle).
    """
    angle = np.linspace(np.pi, 0, 2001)
    x = 1 + ratio + 2 * np.sqrt(ratio) * np.cos(angle)
    mass = np.sin(angle) ** 2 / np.maximum(x, 1e-12)
    share = np.concatenate([[0.0], np.cumsum(mass[1:] + mass[:-1])])
    return float(np.interp(0.5, share / share[-1], x))


def separated_modes(lam: np.ndarray, places: int, epochs: int, most: int = 10) -> int:
    """How many leading modes form groups that stand clear of the next mode and above what noise alone would give.

    A group ends where the step to the next eigenvalue exceeds its sampling error, lam sqrt(2 / epochs).
    """
    ratio = places / epochs
    edge = np.median(lam) / noise_median(ratio) * (1 + np.sqrt(ratio)) ** 2
    ends = np.flatnonzero(-np.diff(lam) > lam[:-1] * np.sqrt(2 / epochs))
    good = np.logical_and.accumulate(lam[ends] > edge)
    return min(int(ends[good][-1]) + 1, most) if good.any() else 0


def separate(series: DataFrame, time: str, on: list[str], value: str, weight: str | None = None, keep: int | None = None, most: int = 10) -> tuple[DataFrame, int, float]:
    """The field (time, place, separated, noise) of the modes that stand clear, their number, and the noise's weighted RMS.

    separated + noise is the input less its mean over time at each place; ``weight`` (a column of the place, positive)
    scales what the modes are judged by.
    """
    from pyspark.sql import Window as W

    x = series.select(time, *on, F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    epochs, places = x.select(time).distinct().count(), x.select(*on).distinct().count()
    if many := epochs > places:
        # Few places: their means and numbers go to every task, and an epoch needs no row of another one.
        at = x.groupBy(*on).agg(F.avg("_v").alias("_mean")).collect()
        number = series.sparkSession.createDataFrame([(*[r[c] for c in on], r["_mean"], k) for k, r in enumerate(at)], ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in on) + ", _mean double, _p int")
        same = reduce(and_, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in on])
        x = x.alias("x").join(F.broadcast(number).alias("y"), same).select(time, *[f"x.{c}" for c in on], "_v", "_w", "_p", (F.col("_v") - F.col("_mean")).alias("_c"))
    else:
        x = x.withColumn("_c", F.col("_v") - F.avg("_v").over(W.partitionBy(*on)))
    x = x.withColumn("_s", F.sqrt("_w") * F.col("_c"))
    patterns, pcs, share = eof(x.select(time, *on, "_s"), time, on, "_s", min(epochs, places))
    n = min(separated_modes(share, places, epochs, most) if keep is None else keep, most, len(share))
    if many:
        base, row = np.zeros((places, n)), {tuple(r[c] for c in on): k for k, r in enumerate(at)}
        for r in patterns.where(F.col("mode") < n).collect():
            base[row[tuple(r[c] for c in on)], r["mode"]] = r["pattern"]
        out = _projected(x.select(time, *on, "_p", "_c", "_s", "_w"), time, on, base)
    else:
        modes = patterns.where(F.col("mode") < n).join(pcs.where(F.col("mode") < n), "mode")
        back = modes.groupBy(time, *on).agg(F.sum(F.col("pattern") * F.col("pc")).alias("_b"))
        out = x.join(back, [time, *on], "left")
    out = out.withColumn("separated", F.coalesce(F.col("_b") / F.sqrt("_w"), F.lit(0.0)))
    out = out.select(time, *on, "separated", (F.col("_c") - F.col("separated")).alias("noise"), "_w")
    rms = out.agg(F.sqrt(F.sum(F.col("_w") * F.col("noise") ** 2) / F.sum("_w"))).first()[0]
    return out.drop("_w"), n, rms


def _projected(x: DataFrame, time: str, on: list[str], base: np.ndarray) -> DataFrame:
    """Adds _b, each epoch's values _s at the places _p as the columns of ``base`` give them back; null without an epoch."""
    shared = x.sparkSession.sparkContext.broadcast(base)  # places by modes kept

    def run(table, at):
        base = shared.value
        group = np.repeat(np.arange(len(at)), np.diff([*at, table.num_rows]))
        p, s = table.column("_p").to_numpy(), batches.floats(table, "_s")
        s = np.where(np.isnan(s), 0.0, s)
        b = np.zeros(len(s))
        step = max(1, (1 << 20) // len(base))
        for lo in range(0, len(at), step):
            rows = (group >= lo) & (group < lo + step)
            field = np.zeros((min(step, len(at) - lo), len(base)))
            np.add.at(field, (group[rows] - lo, p[rows]), s[rows])
            b[rows] = ((field @ base) @ base.T)[group[rows] - lo, p[rows]]
        yield from table.append_column("_b", pa.array(b)).to_batches()

    schema = batches.types(x, x.columns) + "_b double"
    return batches.map_groups(x, [time], [], run, schema).withColumn("_b", F.when(F.col(time).isNotNull(), F.col("_b")))


def block_factors(covariance: DataFrame) -> DataFrame:
    """Cholesky factors (m, cs, n_row, n, l) of covariance rows (m, cs, n1 <= n2, cov); a block that is not positive definite is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        degrees = np.unique(np.concatenate([pdf["n1"], pdf["n2"]]))
        at = {int(n): k for k, n in enumerate(degrees)}
        c = np.zeros((len(at), len(at)))
        for a, b, x in zip(pdf["n1"], pdf["n2"], pdf["cov"]):
            c[at[int(a)], at[int(b)]] = c[at[int(b)], at[int(a)]] = x
        try:
            low = np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            raise ValueError(f"the covariance of order {pdf['m'].iloc[0]} is not positive definite") from None
        i, j = np.tril_indices(len(degrees))
        return pd.DataFrame({"m": pdf["m"].iloc[0], "cs": pdf["cs"].iloc[0], "n_row": degrees[i], "n": degrees[j], "l": low[i, j]})

    return covariance.groupBy("m", "cs").applyInPandas(run, "m int, cs int, n_row int, n int, l double")


DRAWS = 1 << 22


def monte_carlo(coef: DataFrame, transform, keys: list[str], samples: int = 500, seed: int = 1, covariance: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of ``transform`` (DataFrame with ``sample`` and ``v`` to one with keys and ``value``).

    Coefficients vary by their sigmas ``s``, or together by a block ``covariance`` (m, cs, n1 <= n2, cov): draws of a
    block are joined to its Cholesky factor and summed.  A coefficient without a block keeps its value then.

    Noise comes from hashes of (seed, sample, keys, coefficient) by Box-Muller, so a recomputed task draws the same and
    every set has draws of its own.
    Coefficients are dealt by ``keys`` before they are drawn, so that samples need no shuffle, into parts of about
    ``DRAWS`` draws, so that a part's sums stay in memory.
    """
    if set(keys) <= set(coef.columns):
        parts = max(1, -(-coef.count() * samples // DRAWS))
        coef = coef.repartition(parts, *keys)
    x = coef.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    own = [k for k in keys if k in coef.columns and k not in ("n", "m", "cs")]

    def u(k: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "sample", *own, "n", "m", "cs"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    z = F.sqrt(-2 * F.log(u(1))) * F.cos(6.283185307179586 * u(2))
    if covariance is None:
        drawn = x.withColumn("v", F.col("v") + F.coalesce("s", F.lit(0.0)) * z)
    else:
        # The factor's size is set by the largest degree; the join leaves its kind to the planner.
        part = x.withColumn("_z", z).select("sample", *own, "m", "cs", "n", "_z").join(block_factors(covariance), ["m", "cs", "n"])
        moved = part.groupBy("sample", *own, "m", "cs", F.col("n_row").alias("n")).agg(F.sum(F.col("l") * F.col("_z")).alias("_d"))
        drawn = x.join(moved, ["sample", *own, "m", "cs", "n"], "left").withColumn("v", F.col("v") + F.coalesce("_d", F.lit(0.0))).drop("_d")
    return transform(drawn).groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"), F.count("*").alias("samples"))
