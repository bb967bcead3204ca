"""Coefficient sets as tables (set_id, epoch, n, m, cs, v, s): packing, selection, row arithmetic.

``v`` is the value and ``s`` its standard deviation (null when unknown). Missing values are null, never NaN.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_table, literal_table

KEY = ["n", "m", "cs"]


def nan_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def unpack(packed: DataFrame, vector: str, nmax: int, min_degree: int = 0) -> DataFrame:
    """One row per coefficient from one vector per set; the index is a broadcast of (nmax + 1)**2 rows."""
    idx = F.broadcast(index_table(packed.sparkSession, nmax, min_degree))
    rows = packed.select(*[c for c in packed.columns if c != vector], F.posexplode(vector).alias("pos", "v"))
    return rows.withColumn("v", nan_to_null(F.col("v").cast("double"))).join(idx, "pos").drop("pos")


def pack(coef: DataFrame, keys: list[str], nmax: int, min_degree: int = 0) -> DataFrame:
    """One vector per set, in canonical order; absent coefficients are zero."""
    idx = F.broadcast(index_table(coef.sparkSession, nmax, min_degree))
    size = (nmax + 1) ** 2 - min_degree**2
    found = coef.join(idx, KEY).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("at"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.col("at")[p], F.lit(0.0))).alias("x"))


def truncate(coef: DataFrame, nmax: int) -> DataFrame:
    return coef.where(F.col("n") <= nmax)


def select_epochs(coef: DataFrame, first: float, last: float) -> DataFrame:
    """Both ends count."""
    if not first < last:
        raise ValueError("the range needs first < last")
    return coef.where(F.col("epoch").between(first, last))


def drop_incomplete(coef: DataFrame, keys: list[str]) -> DataFrame:
    """Without the sets that hold a null or non-finite value."""
    bad = coef.where(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).select(*keys).distinct()
    return coef.join(bad, keys, "left_anti")


def set_coefficient(coef: DataFrame, n: int, m: int, c: float, s: float, sigma: float | None = None) -> DataFrame:
    here = (F.col("n") == n) & (F.col("m") == m)
    value = F.when(F.col("cs") == 0, F.lit(c)).otherwise(F.lit(s))
    return coef.withColumn("v", F.when(here, value).otherwise(F.col("v"))).withColumn("s", F.when(here, F.lit(sigma).cast("double")).otherwise(F.col("s")))


def combine(a: DataFrame, b: DataFrame, on: list[str], sign: int = 1) -> DataFrame:
    """a + sign * b, coefficient by coefficient; sigmas add in squares."""
    b = b.select(*on, F.col("v").alias("bv"), F.col("s").alias("bs"))
    return a.join(b, on).withColumn("v", F.col("v") + sign * F.col("bv")).withColumn("s", F.sqrt(F.col("s") * F.col("s") + F.col("bs") * F.col("bs"))).drop("bv", "bs")


def scale(coef: DataFrame, factor: float) -> DataFrame:
    return coef.withColumn("v", F.col("v") * factor).withColumn("s", F.col("s") * abs(factor))


def weight(coef: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """Values and sigmas times a weight table on degree, order or both (a bounded table: broadcast)."""
    j = coef.join(F.broadcast(weights.select(*on, "w")), on)
    return j.withColumn("v", F.col("v") * F.col("w")).withColumn("s", F.col("s") * F.abs("w")).drop("w")


def rescale(coef: DataFrame, gm1: float, r1: float, gm2: float, r2: float) -> DataFrame:
    """To other reference constants: times (GM1 / GM2) (R1 / R2)**n."""
    f = F.lit(gm1 / gm2) * F.pow(F.lit(r1 / r2), F.col("n"))
    return coef.withColumn("v", F.col("v") * f).withColumn("s", F.col("s") * f)


def subtract_normal_field(coef: DataFrame, nmax: int, system: str = "WGS84", gm: float = special.GM_EARTH, r: float = special.R_EARTH) -> DataFrame:
    """Takes the rescaled even zonals of the level ellipsoid off C(n, 0)."""
    d = special.ELLIPSOIDS[system]
    zonal = special.normal_field(nmax, system) * (d["gm"] / gm) * (d["a"] / r) ** np.arange(nmax + 1)
    z = literal_table(coef.sparkSession, ["n", "m", "cs", "z"], [(n, 0, 0, float(x)) for n, x in enumerate(zonal)])
    return coef.join(F.broadcast(z), KEY, "left").withColumn("v", F.col("v") - F.coalesce("z", F.lit(0.0))).drop("z")


def apply_kernel(coef: DataFrame, factors) -> DataFrame:
    """Values and sigmas times degree factors."""
    k = literal_table(coef.sparkSession, ["n", "w"], [(n, float(x)) for n, x in enumerate(factors)])
    return weight(coef, k, ["n"])


def series_summary(coef: DataFrame) -> DataFrame:
    """Epochs, degree range and span of a series."""
    return coef.agg(F.countDistinct("epoch").alias("n_epochs"), F.max("n").alias("nmax"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))


def assert_compatible(headers: DataFrame) -> None:
    """GM, R within 1e-9 relative and one nmax over all sets, from one aggregate."""
    r = headers.agg(*[f(c).alias(f"{n}_{c}") for c in ("gm", "r", "nmax") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if r["lo_nmax"] != r["hi_nmax"] or any(abs(r[f"hi_{c}"] - r[f"lo_{c}"]) > 1e-9 * abs(r[f"hi_{c}"]) for c in ("gm", "r")):
        raise ValueError("sets of one series need one nmax, GM and R")


def assert_clean(coef: DataFrame, operation: str) -> None:
    if not coef.where(F.col("v").isNull() | F.isnan("v")).isEmpty():
        raise ValueError(f"{operation}: the series holds missing values")


def with_note(sets: DataFrame, note: str) -> DataFrame:
    return sets.withColumn("history", F.concat(F.coalesce("history", F.array().cast("array<string>")), F.array(F.lit(note))))


def assert_same_epochs(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, what: str = "combination") -> None:
    """Raises if sets of equal keys are further apart in time than the tolerance; a set without an epoch fits any."""
    x = a.select(*keys, F.col("epoch").alias("e1")).distinct().join(b.select(*keys, F.col("epoch").alias("e2")).distinct(), keys)
    apart = x.where(F.abs(F.col("e1") - F.col("e2")) > tolerance).first()
    if apart:
        raise ValueError(f"{what}: epochs {apart['e1']:.4f} and {apart['e2']:.4f} differ by more than {tolerance:.3f} years")


def by_epoch(df: DataFrame) -> DataFrame:
    """Rows in the order of their epochs, those without one last."""
    return df.orderBy(F.col("epoch").asc_nulls_last())
