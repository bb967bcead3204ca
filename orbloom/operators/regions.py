"""Regions: masks, buffers, basin kernels and averages, leakage, Slepian bases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays
from orbloom.operators import batches

EARTH_KM = 6378.1363


def inside_polygon(lat: np.ndarray, lon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule for a ring of (lat, lon) in degrees."""
    y, x = ring[:, 0], ring[:, 1]
    y2, x2 = np.roll(y, -1), np.roll(x, -1)
    hit = (y[None] > lat[:, None]) != (y2[None] > lat[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = x[None] + (lat[:, None] - y[None]) / (y2 - y)[None] * (x2 - x)[None]
    return (np.sum(hit & (lon[:, None] < cross), axis=1) % 2).astype(bool)


def polygon_mask(grid: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Adds w = 1 inside any ring, else 0."""
    shared = grid.sparkSession.sparkContext.broadcast([np.array(r, float) for r in rings])

    @F.pandas_udf("double")
    def w(lat: pd.Series, lon: pd.Series) -> pd.Series:
        inside = np.zeros(len(lat), bool)
        for r in shared.value:
            inside |= inside_polygon(lat.to_numpy(), lon.to_numpy(), r)
        return pd.Series(inside.astype(float))

    return grid.withColumn("w", w("lat", "lon"))


BAND = 5.0  # degrees of latitude in which edges and places meet


def edges(rings: DataFrame, names: list[str], band: float = BAND) -> DataFrame:
    """Edges of polygon parts, by latitude band: names, b, c, y1, x1, y2, x2.

    ``rings`` has a row (names, part, ring array<struct<lat, lon>>) for each outer ring and each hole, all alike: a place is
    inside a polygon if a line to the east crosses an odd number of its edges.  Longitudes x count from c, the mean
    direction of the part's vertices, so parts may lie across the date line.
    """
    bad = rings.where(F.exists("ring", lambda p: F.abs(p["lat"]) > 90)).first()
    if bad:
        raise ValueError("a vertex has a latitude beyond 90: vertices are (lat, lon)")
    sin, cos = (F.aggregate(F.transform("ring", part), F.lit(0.0), lambda a, v: a + v) for part in (lambda p: F.sin(F.radians(p["lon"])), lambda p: F.cos(F.radians(p["lon"]))))
    x = rings.withColumn("c", F.degrees(F.atan2(sin, cos)))
    flat = F.transform("ring", lambda p: F.struct(p["lat"].alias("y"), (F.pmod(p["lon"] - F.col("c") + 180, F.lit(360.0)) - 180).alias("x")))
    x = x.withColumn("p", flat).withColumn("q", F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)))
    e = x.select(*names, "c", F.explode(F.arrays_zip("p", "q")).alias("e")).select(*names, "c", F.col("e.p.y").alias("y1"), F.col("e.p.x").alias("x1"), F.col("e.q.y").alias("y2"), F.col("e.q.x").alias("x2"))
    e = e.where("y1 <> y2")  # a level edge is never crossed
    return e.withColumn("b", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))))


def inside(places: DataFrame, rings: DataFrame, names: list[str], band: float = BAND) -> DataFrame:
    """(lat, lon, names) of the places (lat, lon) inside each polygon, with parts and holes.

    Places meet the edges of their latitude band by an equi-join; the count of crossed edges is one grouped sum.
    """
    at = places.select("lat", "lon").distinct().withColumn("b", F.floor(F.col("lat") / band))
    x = F.pmod(F.col("lon") - F.col("c") + 180, F.lit(360.0)) - 180
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (x < F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    return at.join(edges(rings, names, band), "b").where(crosses).groupBy("lat", "lon", *names).count().where("count % 2 = 1").drop("count")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, haversine form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _cells(lat: Column, lon: Column, band: Column, degrees: float) -> Column:
    """The longitude cell of a place within a latitude band, and how many cells the band has, as a struct.

    A cell is at least as wide as the longitudes that ``degrees`` of distance can span anywhere in the band, so places
    that close lie in neighbouring cells; a band that reaches as near to a pole is one cell.
    """
    far = F.greatest(F.abs(band * degrees), F.abs((band + 1) * degrees))
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(degrees))) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12)))))
    count = F.when(far + degrees >= 90, F.lit(1.0)).otherwise(F.greatest(F.floor(360 / reach), F.lit(1.0))).cast("int")
    return F.struct(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * count).cast("int").alias("at"), count.alias("count"))


def near(places: DataFrame, others: DataFrame, within_km: float, keys: list[str] | None = None) -> DataFrame:
    """Places (keys, lat, lon) with at least one of the others at most that far away.

    An equi-join on latitude bands and longitude cells, in which the others stand in all cells around theirs, over the
    date line and the poles; then the distance.
    """
    keys = keys or []
    if not within_km:
        return places.select(*keys, "lat", "lon").join(others.select(*keys, "lat", "lon").distinct(), [*keys, "lat", "lon"], "left_semi").distinct()
    degrees = float(np.degrees(min(within_km / EARTH_KM, np.pi)))
    a = places.select(*keys, "lat", "lon").withColumn("_b", F.floor(F.col("lat") / degrees))
    a = a.withColumn("_c", _cells(F.col("lat"), F.col("lon"), F.col("_b"), degrees)["at"])
    b = others.select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    b = b.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_lat") / degrees) + k for k in (-1, 0, 1)])))
    cell = _cells(F.col("_lat"), F.col("_lon"), F.col("_b"), degrees)
    around = F.array_distinct(F.array(*[F.pmod(cell["at"] + k, cell["count"]).cast("int") for k in (-1, 0, 1)]))
    b = b.withColumn("_c", F.explode(around))
    close = distance_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= within_km
    return a.join(b, [*keys, "_b", "_c"]).where(close).select(*keys, "lat", "lon").distinct()


def shrink(grid: DataFrame, buffer_km: float, keys: list[str] | None = None) -> DataFrame:
    """Cells of each mask (w > 0.5) farther than the buffer from every cell outside it."""
    keys = keys or []
    inside = grid.where("w > 0.5")
    return inside.join(near(inside, grid.where("w <= 0.5"), buffer_km, keys), [*keys, "lat", "lon"], "left_anti")


def grow(grid: DataFrame, buffer_km: float, keys: list[str] | None = None) -> DataFrame:
    """Cells of the grid that are in a mask (w > 0.5) or at most the buffer away from it, with w = 1."""
    keys = keys or []
    outside = grid.where("w <= 0.5")
    close = near(outside, grid.where("w > 0.5"), buffer_km, keys)
    return grid.where("w > 0.5").withColumn("w", F.lit(1.0)).unionByName(outside.join(close, [*keys, "lat", "lon"], "left_semi").withColumn("w", F.lit(1.0)))


def basin_kernel(mask, nmax: int, min_degree: int = 2, taper_km: float = 0.0) -> np.ndarray:
    """Band-limited kernel b = Y'(w mask) of a mask function of (lat, lon) in degrees, on the quadrature grid."""
    n, m, cs = index_arrays(nmax, min_degree)
    lat, lon, w = special.quadrature(nmax, 2 * (nmax + 1), 4 * nmax + 4)
    b = special.ylm(lat, lon, n, m, cs).T @ (w * np.clip(mask(np.degrees(lat), np.degrees(lon)), 0, 1))
    return b * special.gaussian_weights(nmax, taper_km)[n] if taper_km else b


def sensitivity_kernel(b: np.ndarray, n: np.ndarray, alpha: float = 1.0, noise: np.ndarray | None = None, far: np.ndarray | None = None) -> np.ndarray:
    """Kernel that trades leakage for noise and keeps the response to the region itself at one."""
    m = 1 / (n + 1.0) if far is None else far
    cov = np.diag((1 + (n / 8.0) ** 3) ** 2) if noise is None else np.diag(noise**2) if noise.ndim == 1 else (noise + noise.T) / 2
    a = np.diag(m) + alpha * cov
    k0, v = np.linalg.solve(a, np.column_stack([m * b, b])).T
    return k0 + (b @ b - b @ k0) / (b @ v) * v if abs(b @ v) > 0 else k0


def basin_average(coef: DataFrame, kernels: DataFrame, keys: list[str], normalised: bool = True) -> DataFrame:
    """sum(b v) / sum(b b) by basin and key (or the bare sum), from kernels (basin, n, m, cs, b)."""
    j = coef.join(kernels, ["n", "m", "cs"])
    top = F.sum(F.col("b") * F.col("v"))
    return j.groupBy("basin", *keys).agg((top / F.nullif(F.sum(F.col("b") * F.col("b")), F.lit(0.0)) if normalised else top).alias("average"))


def deconvolution(kernels: np.ndarray, operator: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """The matrix that gives basin values c from averages B' x, where (B' W B) c = B' x: undoes what the filter W mixed between basins."""
    a = kernels.T @ operator @ kernels
    return np.linalg.inv(a + ridge * np.trace(a) / len(a) * np.eye(len(a)))


def deconvolve(averages: DataFrame, keys: list[str], names: list[str], matrix: np.ndarray) -> DataFrame:
    """Separated values of basins (keys, basin, average), a column for each of the named basins."""
    value = {n: F.max(F.when(F.col("basin") == n, F.col("average"))) for n in names}
    p = averages.groupBy(*keys).agg(*[v.alias(f"_{n}") for n, v in value.items()])
    return p.select(*keys, *[sum((float(matrix[i, j]) * F.col(f"_{o}") for j, o in enumerate(names)), F.lit(0.0)).alias(f"basin_{n}") for i, n in enumerate(names)])


def scaling_factor(pairs: DataFrame, keys: list[str], truth: str, filtered: str) -> DataFrame:
    """Gain sum(t f) / sum(f f) by key, with the number of epochs (null below three)."""
    gain = F.sum(F.col(truth) * F.col(filtered)) / F.nullif(F.sum(F.col(filtered) ** 2), F.lit(0.0))
    return pairs.where(F.col(truth).isNotNull() & F.col(filtered).isNotNull()).groupBy(*keys).agg(F.when(F.count("*") >= 3, gain).alias("gain"), F.count("*").alias("n"))


def slepian(mask, nmax: int, min_degree: int = 0, keep: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Basis of functions best concentrated in the mask, their concentrations, and the Shannon number."""
    n, m, cs = index_arrays(nmax, min_degree)
    lat, lon, w = special.quadrature(nmax, 2 * (nmax + 1), 4 * nmax + 4)
    y = special.ylm(lat, lon, n, m, cs)
    lam, g = np.linalg.eigh(y.T @ (y * (w * mask(np.degrees(lat), np.degrees(lon)))[:, None]))
    lam, g = np.clip(lam[::-1], 0, 1), g[:, ::-1]
    shannon = float(lam.sum())
    k = keep or max(1, round(shannon))
    return g[:, :k], lam[:k], shannon


def project(coef: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates in a basis (mode, n, m, cs, g): a grouped sum."""
    return coef.join(basis, ["n", "m", "cs"]).groupBy(*keys, "mode").agg(F.sum(F.col("g") * F.col("v")).alias("a"))


class Sphere:
    """Analysis and synthesis of fields [lat, lon] on a Gauss-Legendre grid, order by order."""

    def __init__(self, nmax: int, n_lat: int | None = None, n_lon: int | None = None):
        self.nmax, self.n_lat, self.n_lon = nmax, n_lat or nmax + 1, n_lon or 2 * nmax + 2
        lat, lon, w = special.quadrature(nmax, self.n_lat, self.n_lon)
        self.lat, self.lon = lat[:: self.n_lon], lon[: self.n_lon]
        self.w = w.reshape(self.n_lat, self.n_lon)
        self.p = special.legendre(nmax, self.lat)
        arg = np.arange(nmax + 1)[:, None] * self.lon[None, :]
        self.trig = np.stack([np.cos(arg), np.sin(arg)])

    def degrees(self) -> tuple[list[float], list[float]]:
        return np.degrees(self.lat).tolist(), np.degrees(self.lon).tolist()

    def analysis(self, field: np.ndarray) -> np.ndarray:
        """Coefficients [..., C or S, n, m] of fields [..., lat, lon]."""
        k = self.nmax + 1
        rings = (self.w * field) @ self.trig.reshape(2 * k, -1).T
        rings = rings.reshape(-1, self.n_lat, 2, k).transpose(3, 0, 2, 1).reshape(k, -1, self.n_lat)  # order, field and C or S, latitude
        out = (rings @ self.p.transpose(1, 2, 0)).reshape(k, -1, 2, k)
        return out.transpose(1, 2, 3, 0).reshape(*field.shape[:-2], 2, k, k)

    def synthesis(self, x: np.ndarray) -> np.ndarray:
        k = self.nmax + 1
        c = x.reshape(-1, 2, k, k).transpose(3, 0, 1, 2).reshape(k, -1, k)
        rings = (c @ self.p.transpose(1, 0, 2)).reshape(k, -1, 2, self.n_lat).transpose(1, 3, 2, 0).reshape(-1, self.n_lat, 2 * k)
        return (rings @ self.trig.reshape(2 * k, -1)).reshape(*x.shape[:-3], self.n_lat, self.n_lon)


def leakage_iterate(observed: np.ndarray, forward, mask: np.ndarray | None = None, gain: float = 1.0, noise: float = 0.0, tau: float = 1.2, most: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, int, str, float]:
    """Landweber iteration m += gain (obs - F m), kept to the mask; the field, rounds, what ended them, and the residual's RMS.

    With a noise level it ends when the residual is down to it (discrepancy), else when the field hardly changes.
    """
    on = np.ones(observed.shape, bool) if mask is None else mask
    out, rounds, ended, rms = leakage_iterate_many(observed[None], lambda x: forward(x[0])[None], on[None], np.array([noise]), gain, tau, most, tol)
    return out[0], int(rounds[0]), str(ended[0]), float(rms[0])


def leakage_iterate_many(observed: np.ndarray, forward, on: np.ndarray, noise: np.ndarray, gain: float = 1.0, tau: float = 1.2, most: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for many fields [field, ...] at once; a field leaves the rounds when its own iteration has ended."""
    count, rest = len(observed), tuple(range(1, observed.ndim))
    if not on.any(axis=rest).all() or not np.isfinite(observed[on]).all():
        raise ValueError("the mask is empty or the field has gaps in it")
    scale = np.abs(observed).max(axis=rest)
    out, rounds, rms = np.where(on, observed, 0.0), np.full(count, most), np.zeros(count)
    ended = np.full(count, "rounds", dtype=object)
    zero = scale == 0
    out[zero], rounds[zero], ended[zero] = observed[zero], 0, "zero"
    live = np.flatnonzero(~zero)
    obs, m, inside, first = observed[live], out[live], on[live], None
    for it in range(1, most + 1):
        if not len(live):
            break
        r = obs - forward(m)
        size = np.abs(r).max(axis=rest) / scale[live]
        first = size if first is None else first
        new = np.where(inside, m + gain * r, 0.0)
        level = np.sqrt(np.where(inside, r**2, 0.0).sum(axis=rest) / inside.sum(axis=rest))
        step = np.abs(new - m).max(axis=rest) / np.maximum(np.abs(new).max(axis=rest), 1e-300)
        m, given = new, noise[live] != 0
        down = given & (level <= tau * noise[live])
        if (~down & (~np.isfinite(size) | ((it > 2) & (size > 10 * first)))).any():
            raise ArithmeticError("the iteration diverges; lower the gain")
        still = ~given & (step < tol)
        ended[live[down]], ended[live[still]] = "discrepancy", "step"
        done = down | still
        if done.any() or it == most:
            out[live], rms[live], rounds[live[done]] = m, level, it
            obs, m, inside, first, live = obs[~done], m[~done], inside[~done], first[~done], live[~done]
    return out, rounds, ended, rms


def _fields(table: pa.Table, at: np.ndarray, sphere: Sphere, columns: list[str]) -> list[np.ndarray]:
    sizes = np.diff([*at, table.num_rows])
    if (sizes != sphere.w.size).any():
        raise ValueError(f"a field has {sizes[sizes != sphere.w.size][0]} of {sphere.w.size} places")
    return [batches.floats(table, c).reshape(-1, sphere.n_lat, sphere.n_lon) for c in columns]


def leakage_correct(fields: DataFrame, keys: list[str], nmax: int, weights, n_lat: int | None = None, n_lon: int | None = None, **how) -> DataFrame:
    """Fields (keys, lat, lon, value, inside, noise) on the Gauss-Legendre grid, with the smoothing of degree ``weights`` undone inside.

    Any number of regions and epochs go at once: whole fields come in batches, and a round moves all fields of a batch;
    the transform of a round is separable, so a round needs (nmax x grid) numbers.  Adds corrected, rounds, ended and residual.
    """
    shared = fields.sparkSession.sparkContext.broadcast(np.asarray(weights, float))  # nmax + 1 numbers
    names = [c for c in fields.columns if c not in ("value", "inside", "noise", *keys, "lat", "lon")]
    keep = [*keys, "lat", "lon", "value", "inside", *names]
    schema = ", ".join([f"`{c}` {fields.schema[c].dataType.simpleString()}" for c in keep] + ["corrected double, rounds int, ended string, residual double"])

    def run(table, at):
        sphere = Sphere(nmax, n_lat, n_lon)
        value, inside = _fields(table, at, sphere, ["value", "inside"])
        noise = batches.floats(table, "noise")[at] if "noise" in table.column_names else np.zeros(len(at))
        w = shared.value[:, None]
        out, rounds, ended, rms = leakage_iterate_many(value, lambda x: sphere.synthesis(w * sphere.analysis(x)), inside > 0.5, noise, **how)
        size = sphere.w.size
        out = table.select(keep).append_column("corrected", pa.array(out.ravel())).append_column("rounds", pa.array(np.repeat(rounds, size).astype("int32")))
        yield from out.append_column("ended", pa.array(np.repeat(ended, size), pa.string())).append_column("residual", pa.array(np.repeat(rms, size))).to_batches()

    return batches.map_groups(fields, keys, ["lat", "lon"], run, schema)


def sea_level(load: np.ndarray, ocean: np.ndarray, sphere: Sphere, kn, hn, rho_water: float = special.RHO_WATER, rho_earth: float = special.RHO_EARTH, most: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative sea level of loads (water height) [..., lat, lon], the rounds each took, and the eustatic level; mass is closed exactly in every round."""
    n = np.arange(sphere.nmax + 1)
    response = (3 * rho_water / rho_earth / (2 * n + 1) * (1 + np.asarray(kn)[n] - np.asarray(hn)[n]))[:, None]
    shape = load.shape[:-2]
    load, ocean = load.reshape(-1, *load.shape[-2:]), ocean.reshape(-1, *ocean.shape[-2:])

    def whole(x: np.ndarray) -> np.ndarray:
        return (sphere.w * x).sum(axis=(1, 2))[:, None, None]

    area, total = whole(ocean), whole(load)
    if (area <= 0).any():
        raise ValueError("there is no ocean")
    level, rounds = -total / area * ocean, np.full(len(load), most)
    live, s = np.arange(len(load)), level
    for it in range(1, most + 1):
        raw = sphere.synthesis(response * sphere.analysis(load[live] + s)) * ocean[live]
        new = raw + (-total[live] - whole(raw)) / area[live] * ocean[live]
        change, s = np.abs(new - s).max(axis=(1, 2)), new
        done = change <= tol * np.maximum(np.abs(s).max(axis=(1, 2)), 1e-300)
        level[live], rounds[live[done]] = s, it
        live, s = live[~done], s[~done]
        if not len(live):
            break
    return level.reshape(*shape, *level.shape[1:]), rounds.reshape(shape), (-total / area).reshape(shape)


def sea_level_fingerprints(loads: DataFrame, keys: list[str], nmax: int, kn, hn, n_lat: int | None = None, n_lon: int | None = None) -> DataFrame:
    """Sea level of every load (keys, lat, lon, load, ocean) on the Gauss-Legendre grid: adds level, rounds and eustatic."""
    shared = loads.sparkSession.sparkContext.broadcast((np.asarray(kn, float), np.asarray(hn, float)))  # 2 (nmax + 1) numbers
    keep = [*keys, "lat", "lon", "load", "ocean"]
    schema = ", ".join([f"`{c}` {loads.schema[c].dataType.simpleString()}" for c in keep] + ["level double, rounds int, eustatic double"])

    def run(table, at):
        sphere = Sphere(nmax, n_lat, n_lon)
        load, ocean = _fields(table, at, sphere, ["load", "ocean"])
        level, rounds, flat = sea_level(load * (1 - ocean), ocean, sphere, *shared.value)
        size = sphere.w.size
        out = table.append_column("level", pa.array(level.ravel())).append_column("rounds", pa.array(np.repeat(rounds, size).astype("int32")))
        yield from out.append_column("eustatic", pa.array(np.repeat(flat, size))).to_batches()

    return batches.map_groups(loads.select(*keep), keys, ["lat", "lon"], run, schema)
