"""Joins on time: nearest epoch within a tolerance, validity intervals, coverage, common epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, tolerance: float, left_time: str = "epoch", right_time: str = "epoch", how: str = "inner", prefix: str = "r_", by: list[str] | None = None) -> DataFrame:
    """Each left row with the right row nearest in time, at most ``tolerance`` away; the earlier wins a tie.

    An equi-join on time buckets of the tolerance's width (the right side stands in three), so it shuffles on a
    hashable key and never compares all pairs. ``left`` needs a unique ``row_key``. Right columns get ``prefix``.
    """
    by = by or []
    lb = left.withColumn("_b", F.floor(F.col(left_time) / tolerance))
    r = right.select(*[F.col(c) if c in by else F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    rt = f"{prefix}{right_time}"
    rb = r.withColumn("_b", F.explode(F.array(*[F.floor(F.col(rt) / tolerance) + k for k in (-1, 0, 1)])))
    gap = F.abs(F.col(left_time) - F.col(rt))
    cols = [c for c in r.columns if c not in by]
    best = (
        lb.join(rb, [*by, "_b"])
        .where(gap <= tolerance)
        .groupBy("row_key")
        .agg(F.min(F.struct(gap.alias("_d"), F.col(rt), *[F.col(c).alias(f"_{c}") for c in cols])).alias("_m"))
        .select("row_key", *[F.col(f"_m._{c}").alias(c) for c in cols])
    )
    return left.join(best, "row_key", how)


def add_background(coef: DataFrame, background: DataFrame, tolerance: float, allow_missing: bool = False, sets: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
    """Adds the background set nearest in epoch to every set; without one the set goes, or stays as it is.

    Epochs are matched first, on one row per set, so the wide coefficient rows join once, on equal keys.  ``sets`` and
    ``back`` (set_id, epoch) name the sets of both sides where that is known without looking through the coefficients.
    """
    sets = (coef.select("set_id", "epoch").distinct() if sets is None else sets.select("set_id", "epoch")).withColumnRenamed("set_id", "row_key")
    back = background.select("set_id", "epoch").distinct() if back is None else back.select("set_id", "epoch")
    match = nearest(sets, back, tolerance).select(F.col("row_key").alias("set_id"), F.col("r_set_id").alias("b_id"))
    x = coef.join(match, "set_id", "left" if allow_missing else "inner")
    b = background.select(F.col("set_id").alias("b_id"), "n", "m", "cs", F.col("v").alias("bv"))
    return x.join(b, ["b_id", "n", "m", "cs"], "left").withColumn("v", F.col("v") + F.coalesce("bv", F.lit(0.0))).drop("b_id", "bv")


def replace_low_degrees(coef: DataFrame, table: DataFrame, tolerance: float, targets: dict[tuple[int, int, int], str]) -> DataFrame:
    """Takes single coefficients from the table record nearest in epoch; a null there keeps the old value."""
    sets = coef.select(F.col("set_id").alias("row_key"), "epoch").distinct()
    match = nearest(sets, table, tolerance, prefix="t_").withColumnRenamed("row_key", "set_id").drop("epoch")
    x = coef.join(match, "set_id")
    value: Column = F.col("v")
    for (n, m, cs), c in targets.items():
        value = F.when((F.col("n") == n) & (F.col("m") == m) & (F.col("cs") == cs), F.coalesce(F.col(f"t_{c}"), F.col("v"))).otherwise(value)
    return x.withColumn("v", value).select(*coef.columns)


def covered(df: DataFrame, table: DataFrame, tolerance: float, time: str = "epoch") -> DataFrame:
    """Rows whose epoch lies within the table's span, widened by the tolerance."""
    span = table.agg((F.min(time) - tolerance).alias("_lo"), (F.max(time) + tolerance).alias("_hi"))
    return df.join(F.broadcast(span), F.col(time).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def evaluate_terms(epochs: DataFrame, terms: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Value of time-variable terms at epochs: pieces with t0 <= t < t1, trends and harmonics.

    ``terms``: key, kind (const, trnd, acos, asin), value, t0, t1, period.  Epochs and terms meet by an equi-join on
    buckets of time; a term stands in those buckets of its interval that lie within the epochs' span.
    """
    t = F.col("epoch") - F.col("t0")
    arg = F.lit(6.283185307179586) * t / F.nullif(F.col("period"), F.lit(0.0))
    part = F.when(F.col("kind") == "trnd", t).when(F.col("kind") == "acos", F.cos(arg)).when(F.col("kind") == "asin", F.sin(arg)).otherwise(F.lit(1.0))
    e = epochs.withColumn("_b", F.floor(F.col("epoch") / bucket))
    span = e.agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))  # one row
    x = terms.join(F.broadcast(span)).withColumn("_lo", F.greatest(F.floor(F.col("t0") / bucket), "_lo")).withColumn("_hi", F.least(F.floor(F.col("t1") / bucket), "_hi"))
    x = x.where("_lo <= _hi").withColumn("_b", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    j = e.join(x, "_b").where((F.col("epoch") >= F.col("t0")) & (F.col("epoch") < F.col("t1")))
    return j.groupBy("epoch", "key").agg(F.sum(F.col("value") * part).alias("value"))


def common_epochs(series: list[DataFrame], tolerance: float) -> DataFrame:
    """Epochs of the first series that have a neighbour in every other, with the neighbours' epochs."""
    out = series[0].select("epoch").distinct().withColumn("row_key", F.col("epoch"))
    for k, other in enumerate(series[1:], 1):
        out = nearest(out, other.select("epoch").distinct(), tolerance, prefix=f"s{k}_")
    return out.drop("row_key")


def missing_from(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(present, on, "left_anti")
