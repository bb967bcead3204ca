"""Whole processing chains as one lazy plan each; nothing runs before the caller asks for rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions.index import literal_table
from orbloom.functions.special import kernel_factors
from orbloom.operators import filters, nearest, regions, regression, statistics, transforms
from orbloom.operators.stored import stored

EARTH_M = 6371e3  # radius for areas

LOW = {(2, 0, 0): "c20", (3, 0, 0): "c30"}
GEOCENTRE = {(1, 0, 0): "c10", (1, 1, 0): "c11", (1, 1, 1): "s11"}


def standard_chain(coef: DataFrame, nmax: int, low_degrees: DataFrame | None = None, geocentre: DataFrame | None = None, rate: DataFrame | None = None, rate_epoch: float = 2010.0, filter_name: str = "gauss300", tolerance: float = 0.05) -> DataFrame:
    """Truncate, replace low degrees, remove a rate, filter. Epochs that a table does not cover go."""
    x = coef.where(F.col("n") <= nmax)
    for tab, targets in ((low_degrees, LOW), (geocentre, GEOCENTRE)):
        if tab is not None:
            x = nearest.replace_low_degrees(nearest.covered(x, tab, tolerance), tab, tolerance, targets)
    if rate is not None:
        x = regression.remove_rate(x, rate, rate_epoch, ["n", "m", "cs"])
    return x if filter_name == "none" else filters.weight(x, filters.weight_table(x.sparkSession, filters.parse_filter(filter_name, nmax)), ["n"])


def level2b(coef: DataFrame, low_degrees: DataFrame | None = None, targets: dict | None = None, mean: DataFrame | None = None, rate: DataFrame | None = None, rate_epoch: float = 2011.0, tolerance: float = 2e-3) -> DataFrame:
    """Replacement by begin epoch within a tight tolerance, less a mean field and a rate."""
    x = coef if low_degrees is None else nearest.replace_low_degrees(coef, low_degrees, tolerance, LOW if targets is None else targets)
    if mean is not None:
        m = mean.select("n", "m", "cs", F.col("v").alias("mv"))
        x = x.join(m, ["n", "m", "cs"], "left").withColumn("v", F.col("v") - F.coalesce("mv", F.lit(0.0))).drop("mv")
    return x if rate is None else regression.remove_rate(x, rate, rate_epoch, ["n", "m", "cs"])


def water_grid(coef: DataFrame, keys: list[str], nmax: int, lat_deg, lon_deg, kn, filter_name: str = "none") -> DataFrame:
    """Water heights (keys, lat, lon, value) in metres, filtered by degree before the synthesis."""
    return transforms.synthesis(coef, keys, nmax, lat_deg, lon_deg, kernel_factors("ewh", nmax, kn=kn) * filters.parse_filter(filter_name, nmax))


def cell_area(lat_deg, lon_deg, r: float = EARTH_M):
    """Area of a grid cell in square metres as a column of its latitude."""
    d_lat, d_lon = (abs(float(np.diff(x)[0])) for x in (lat_deg, lon_deg))
    return F.lit(r * r * np.radians(d_lat) * np.radians(d_lon)) * F.cos(F.radians("lat"))


def region_series(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """Area-weighted mean of regions (region, lat, lon, w) at every epoch of a grid (epoch, lat, lon, value)."""
    w = F.col("w") * F.cos(F.radians("lat"))
    return grid.join(mask, ["lat", "lon"]).groupBy("region", "epoch").agg((F.sum(w * F.col("value")) / F.nullif(F.sum(w), F.lit(0.0))).alias("v"))


def seasonal(series: DataFrame, keys: list[str], t0: float) -> DataFrame:
    """Trend with its sigma, annual amplitude and phase, and the deviation of the residuals of every series (keys, epoch, v)."""
    m = regression.fit(series, keys, t0)
    t = m.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == k, F.col("coef"))).alias(k) for k in ("trend", "cos_annual", "sin_annual")], F.max(F.when(F.col("term") == "trend", F.col("sigma"))).alias("trend_sigma"), F.sqrt(F.max("res_var")).alias("noise"))
    return t.select(*keys, "trend", "trend_sigma", F.hypot("cos_annual", "sin_annual").alias("amplitude"), F.atan2("sin_annual", "cos_annual").alias("phase"), "noise")


def storage_chain(coef: DataFrame, nmax: int, lat_deg, lon_deg, rings: DataFrame, kn, filter_name: str = "gauss300", t0: float = 2010.0) -> DataFrame:
    """Water storage of basins given as polygons (region, part, ring): trend, annual amplitude and phase, in cm (a year)."""
    grid = water_grid(coef, ["epoch"], nmax, lat_deg, lon_deg, kn, filter_name)
    places = literal_table(coef.sparkSession, ["lat", "lon"], [(float(a), float(b)) for a in lat_deg for b in lon_deg])
    mask = regions.inside(places, rings, ["region"]).withColumn("w", F.lit(1.0))
    return seasonal(region_series(grid.withColumn("value", 100 * F.col("value")), mask), ["region"], t0)


def ocean_chain(coef: DataFrame, nmax: int, lat_deg, lon_deg, ocean: DataFrame, kn, buffer_km: float = 300.0, filter_name: str = "gauss445", t0: float = 2010.0, atmosphere: DataFrame | None = None, tolerance: float = 0.05) -> DataFrame:
    """Mean water height of the ocean (lat, lon, w) away from its coasts, in one row.

    Trend in mm a year with its sigma and in Gt a year, annual amplitude in mm, and the noise in metres: the root of
    the median of the places' mean square residuals.  With ``atmosphere`` (epoch, v in metres; see ``mean_of_sets``) the
    mean of the nearest epoch goes first; epochs without one keep theirs.
    """
    grid = water_grid(coef, ["epoch"], nmax, lat_deg, lon_deg, kn, filter_name)
    sea = regions.shrink(ocean, buffer_km).select("lat", "lon", F.lit("ocean").alias("region"), "w")
    series = region_series(grid, sea)
    if atmosphere is not None:
        x = nearest.nearest(series.withColumn("row_key", F.col("epoch")), atmosphere.select("epoch", "v"), tolerance, how="left")
        series = x.select("region", "epoch", (F.col("v") - F.coalesce("r_v", F.lit(0.0))).alias("v"))
    m = seasonal(series, ["region"], t0)
    pixels = grid.join(sea.select("lat", "lon"), ["lat", "lon"]).withColumnRenamed("value", "v")
    fitted = regression.fit(pixels, ["lat", "lon"], t0).where("term = 'bias'")
    noise = fitted.select(F.sqrt(F.median(F.col("res_var") * (F.col("n_epochs") - 6) / F.col("n_epochs"))).alias("pixel_noise"))
    area = sea.agg(F.sum(cell_area(lat_deg, lon_deg)).alias("area"))
    out = m.join(noise).join(area)  # one row each
    return out.select((1000 * F.col("trend")).alias("trend_mm"), (1000 * F.col("trend_sigma")).alias("sigma_mm"), (F.col("trend") * F.col("area") * 1000 / 1e12).alias("gt_per_year"), (1000 * F.col("amplitude")).alias("amplitude_mm"), "pixel_noise", "area")


def mean_of_sets(coef: DataFrame, nmax: int, lat_deg, lon_deg, mask: DataFrame, kn) -> DataFrame:
    """(epoch, v): mean water height of each set over a mask (lat, lon, w), for instance of atmosphere sets over the ocean."""
    grid = water_grid(coef, ["epoch"], nmax, lat_deg, lon_deg, kn)
    return region_series(grid, mask.select("lat", "lon", F.lit("mask").alias("region"), "w")).select("epoch", "v")


def bottom_pressure_chain(coef: DataFrame, background: DataFrame, nmax: int, lat_deg, lon_deg, ocean: DataFrame, kn, first: float, last: float, filter_name: str = "gauss445", tolerance: float = 0.05) -> DataFrame:
    """Bottom pressure in cm of water (epoch, lat, lon, value) against the mean of a reference period; land is left out.

    The background goes back into the sets that have one near in time.  A period without epochs is an error.
    """
    x = nearest.add_background(coef, background, tolerance, True)
    grid = water_grid(x, ["epoch"], nmax, lat_deg, lon_deg, kn, filter_name).join(ocean.where("w > 0.5").select("lat", "lon"), ["lat", "lon"])
    inside = (F.col("epoch") >= first) & (F.col("epoch") < last)
    if coef.where(inside).isEmpty():
        raise ValueError(f"no epochs in the reference period {first} .. {last}")
    ref = grid.where(inside).groupBy("lat", "lon").agg(F.avg("value").alias("ref"))
    return grid.join(ref, ["lat", "lon"]).select("epoch", "lat", "lon", (100 * (F.col("value") - F.col("ref"))).alias("value"))


def ice_chain(coef: DataFrame, nmax: int, rings: DataFrame, kn, t0: float = 2010.0, filter_name: str = "none", ocean: DataFrame | None = None, noise: float | None = None, boxes: list[tuple[float, float, float, float]] = (), **how) -> DataFrame:
    """Mass trends of ice basins (region, part, ring), in Gt a year, from the leakage-corrected trend of every place.

    Every place of the Gauss-Legendre grid gets its trend; the noise that ends the inversion is the root mean square
    residual over the ``ocean`` (lat, lon, w) over the root of the epochs' spread, unless it is given.  Basins and
    neighbour ``boxes`` (south, north, west, east) may hold mass; basins alone are counted.  Returns region, gt_per_year,
    rounds and what ended the inversion, and the sum of all basins as region ``all``.
    """
    if ocean is None and noise is None:
        raise ValueError("the noise comes from an ocean mask, or must be given")
    sphere = regions.Sphere(nmax)
    lat, lon = sphere.degrees()
    grid = water_grid(coef, ["epoch"], nmax, lat, lon, kn, filter_name).withColumnRenamed("value", "v")
    fitted = stored(regression.fit(grid, ["lat", "lon"], t0).where("term = 'trend'"), "trend-grid")
    if noise is None:
        rms = F.col("res_var") * (F.col("n_epochs") - 6) / F.col("n_epochs")
        sea = fitted.join(ocean.where("w > 0.5").select("lat", "lon"), ["lat", "lon"]).agg(F.sqrt(F.sum(rms * F.cos(F.radians("lat"))) / F.sum(F.cos(F.radians("lat")))).alias("s")).first()["s"]
        spread = coef.select("epoch").distinct().agg((F.var_pop("epoch") * F.count("*")).alias("x")).first()["x"]
        noise = sea / spread**0.5
    places = literal_table(coef.sparkSession, ["lat", "lon"], [(a, b) for a in lat for b in lon])
    basins = stored(regions.inside(places, rings, ["region"]), "basins")
    extra = F.lit(False)
    for south, north, west, east in boxes:
        extra = extra | F.col("lat").between(south, north) & F.col("lon").between(west, east)
    mask = places.join(basins.select("lat", "lon").distinct().withColumn("in", F.lit(True)), ["lat", "lon"], "left")
    fields = fitted.select("lat", "lon", F.col("coef").alias("value")).join(mask, ["lat", "lon"])
    fields = fields.select(F.lit(0).alias("field"), "lat", "lon", "value", F.when(F.coalesce("in", F.lit(False)) | extra, 1.0).otherwise(0.0).alias("inside"), F.lit(float(noise)).alias("noise"))
    out = stored(regions.leakage_correct(fields, ["field"], nmax, filters.parse_filter(filter_name, nmax), **how), "corrected-trend")
    rings_w = {round(a, 9): float(w) for a, w in zip(lat, sphere.w.sum(axis=1) / sphere.n_lon * 4 * np.pi * EARTH_M**2)}
    area = literal_table(coef.sparkSession, ["lat", "area"], [(a, rings_w[round(a, 9)]) for a in lat])
    mass = basins.join(out, ["lat", "lon"]).join(area, "lat").withColumn("gt", F.col("corrected") * F.col("area") * 1000 / 1e12)
    each = mass.groupBy("region", "rounds", "ended").agg(F.sum("gt").alias("gt_per_year"))
    one = mass.dropDuplicates(["lat", "lon"]).groupBy("rounds", "ended").agg(F.sum("gt").alias("gt_per_year")).withColumn("region", F.lit("all"))
    return each.unionByName(one).select("region", "gt_per_year", "rounds", "ended")


def compare_series(a: DataFrame, b: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Two series (epoch, v) on common epochs: efficiency and effective correlation in one row."""
    j = nearest.nearest(a.withColumn("row_key", F.col("epoch")), b.select("epoch", "v"), tolerance).select(F.lit(1).alias("k"), "epoch", "v", F.col("r_v").alias("w"))
    return statistics.nash_sutcliffe(j, ["k"], "v", "w").join(statistics.effective_correlation(j, ["k"], "epoch", "v", "w"), "k").drop("k")
