"""Large matrices as tables of square tiles: products, Cholesky factors, inverses, and covariance conditioning.

A tiled matrix has a row (i, j, h, w, x) for each tile: its place in the grid of tiles, its height and width, and its
values row by row.  Tiles that are not there are zero.  A symmetric matrix may be given by its lower tiles.  No task
holds more than a strip of tiles (size times the matrix's order), and the driver holds none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays
from orbloom.functions.special import R_EARTH, kernel_factors
from orbloom.operators.stored import stored

SIZE = 256
TILE = "i int, j int, h int, w int, x array<double>"
COLUMNS = ["i", "j", "h", "w", "x"]


def _matrix(r) -> np.ndarray:
    return np.asarray(r["x"], float).reshape(int(r["h"]), int(r["w"]))


def _frame(tiles: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(i, j, *a.shape, np.ascontiguousarray(a).ravel()) for i, j, a in tiles], columns=COLUMNS)


def from_entries(entries: DataFrame, order: int, size: int = SIZE) -> DataFrame:
    """Tiles of a square matrix from its entries (row, col, value) from 0 on; repeated entries add up, missing ones are zero."""
    e = entries.select("row", "col", "value").withColumn("i", F.floor(F.col("row") / size).cast("int")).withColumn("j", F.floor(F.col("col") / size).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = np.zeros((min(size, order - i * size), min(size, order - j * size)))
        np.add.at(a, (pdf["row"].to_numpy() - i * size, pdf["col"].to_numpy() - j * size), pdf["value"].to_numpy())
        return _frame([(i, j, a)])

    return e.groupBy("i", "j").applyInPandas(run, TILE)


def entries(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(row, col, value) of all entries of the tiles that are there."""
    x = tiles.select("i", "j", "w", F.posexplode("x").alias("k", "value"))
    return x.select((F.col("i") * size + F.floor(F.col("k") / F.col("w")).cast("int")).alias("row"), (F.col("j") * size + F.col("k") % F.col("w")).alias("col"), "value")


def transposed(tiles: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield _frame([(r["j"], r["i"], _matrix(r).T) for r in pdf.to_dict("records")])

    return tiles.mapInPandas(run, TILE)


def mirrored(lower: DataFrame) -> DataFrame:
    """All tiles of a symmetric matrix from its lower ones."""
    return lower.unionByName(transposed(lower.where("i > j")))


def multiply(a: DataFrame, b: DataFrame, rows: int, columns: int, lower: bool = False) -> DataFrame:
    """The product of two tiled matrices with ``rows`` and ``columns`` tiles on the outer sides; ``lower`` keeps i >= j.

    Every tile of the result is a group: it meets the row of tiles of one side and the column of the other.
    """
    left = a.select(F.col("i").alias("oi"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("oj"), F.col("j").alias("k"), "h", "w", "x")
    right = b.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("oi"), F.col("j").alias("oj"), F.col("i").alias("k"), "h", "w", "x")
    if lower:
        left, right = left.where("oi >= oj"), right.where("oi >= oj")

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame(columns=COLUMNS)
        other, total = {int(r["k"]): r for r in two.to_dict("records")}, None
        for r in one.to_dict("records"):
            if int(r["k"]) in other:
                part = _matrix(r) @ _matrix(other[int(r["k"])])
                total = part if total is None else total + part
        return pd.DataFrame(columns=COLUMNS) if total is None else _frame([(int(one["oi"].iloc[0]), int(one["oj"].iloc[0]), total)])

    fresh = right.withColumnsRenamed({c: f"_{c}" for c in right.columns}).select(*[F.col(f"_{c}").alias(c) for c in right.columns])
    return left.groupBy("oi", "oj").cogroup(fresh.groupBy("oi", "oj")).applyInPandas(run, TILE)


def _with(tiles: DataFrame, other: DataFrame, on: str, name: str) -> DataFrame:
    """The tiles joined to a panel (one tile for each value of ``on``), whose values come as ``name``."""
    panel = other.select(F.col("i").alias(f"{name}_at"), F.col("h").alias(f"{name}_h"), F.col("w").alias(f"{name}_w"), F.col("x").alias(name))
    return tiles.join(panel, F.col(on) == F.col(f"{name}_at")).drop(f"{name}_at")


def _side(r, name: str) -> np.ndarray:
    return np.asarray(r[name], float).reshape(int(r[f"{name}_h"]), int(r[f"{name}_w"]))


def _mapped(df: DataFrame, make: Callable) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield _frame([(int(r["i"]), int(r["j"]), make(r)) for r in pdf.to_dict("records")])

    return df.mapInPandas(run, TILE)


def _factor(r) -> np.ndarray:
    try:
        return np.linalg.cholesky(_matrix(r))  # reads the lower triangle only
    except np.linalg.LinAlgError:
        raise ValueError(f"the matrix is not positive definite (tile {int(r['i'])})") from None


def filled(tiles: DataFrame, order: int, size: int = SIZE) -> DataFrame:
    """The lower tiles, with zeros where one is missing."""
    count = -(-order // size)
    i = F.floor((F.sqrt(8.0 * F.col("id") + 1) - 1) / 2).cast("int")
    grid = tiles.sparkSession.range(count * (count + 1) // 2).withColumn("i", i)
    grid = grid.select("i", (F.col("id") - F.col("i").cast("long") * (F.col("i") + 1) / 2).cast("int").alias("j"))
    height, width = (F.least(F.lit(size), order - F.col(c) * size).cast("int") for c in ("i", "j"))
    x = tiles.where("i >= j").select("i", "j", "x")
    return grid.join(x, ["i", "j"], "left").select("i", "j", height.alias("h"), width.alias("w"), F.coalesce("x", F.array_repeat(F.lit(0.0), height * width)).alias("x"))


def cholesky(tiles: DataFrame, order: int, size: int = SIZE) -> DataFrame:
    """Lower tiles of L with L L' the symmetric positive definite matrix, from its lower tiles.

    A wave for each column of tiles: the tile on the diagonal is factored, the tiles below it are solved against it
    (one join), and every tile further on loses the product of two of those (two joins).  Each wave's tiles are written
    to the shared folder.
    """
    rest, out = filled(tiles, order, size), None
    for k in range(-(-order // size)):
        head = stored(_mapped(rest.where(f"i = {k} AND j = {k}"), _factor), "cholesky-head")
        below = _with(rest.where(f"j = {k} AND i > {k}").withColumn("k", F.lit(k)), head, "k", "l")
        column = stored(_mapped(below, lambda r: np.linalg.solve(_side(r, "l"), _matrix(r).T).T), "cholesky-column")
        done = head.unionByName(column)
        out = done if out is None else out.unionByName(done)
        both = _with(_with(rest.where(f"j > {k}"), column, "i", "l"), column, "j", "r")
        rest = stored(_mapped(both, lambda r: _matrix(r) - _side(r, "l") @ _side(r, "r").T), "cholesky-rest")
    return out


def lower_inverse(lower: DataFrame, order: int, size: int = SIZE) -> DataFrame:
    """The tiles of L^-1: a wave for each row of tiles, which is solved and then taken off the rows below."""
    rest, out = None, None
    one = filled(lower.where("false"), order, size)
    rest = _mapped(one, lambda r: np.eye(int(r["h"])) if r["i"] == r["j"] else _matrix(r))
    for k in range(-(-order // size)):
        head = lower.where(f"i = {k} AND j = {k}")
        row = _with(rest.where(f"i = {k}").withColumn("k", F.lit(k)), head, "k", "l")
        row = stored(_mapped(row, lambda r: np.linalg.solve(_side(r, "l"), _matrix(r))), "inverse-row")
        out = row if out is None else out.unionByName(row)
        column = lower.where(f"j = {k} AND i > {k}")
        met = _with(rest.where(f"i > {k} AND j <= {k}"), column, "i", "l")
        panel = row.select(F.col("j").alias("i"), "h", "w", "x")
        met = _mapped(_with(met, panel, "j", "r"), lambda r: _matrix(r) - _side(r, "l") @ _side(r, "r"))
        rest = stored(met.unionByName(rest.where(f"i > {k} AND j > {k}")), "inverse-rest")
    return out


def inverse(tiles: DataFrame, order: int, size: int = SIZE) -> DataFrame:
    """Lower tiles of the inverse of a symmetric positive definite matrix: (L^-1)' L^-1."""
    count = -(-order // size)
    x = lower_inverse(cholesky(tiles, order, size), order, size)
    return multiply(transposed(x), x, count, count, lower=True)


def reordered(matrix: DataFrame, places: DataFrame) -> DataFrame:
    """Entries (row, col, value) at new places (old, new); rows and columns without a new place go."""
    row, col = places.select(F.col("old").alias("row"), F.col("new").alias("r")), places.select(F.col("old").alias("col"), F.col("new").alias("c"))
    return matrix.join(row, "row").join(col, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


# --- covariance conditioning ----------------------------------------------------------------------------------------


class Conditioner:
    """Maps a covariance of coefficients to water heights on an exact grid, weakens it there, and maps it back.

    The weight of two points is exp(-distance / psi0), and zero if they are in different regions.  Both factors are
    positive semidefinite, so the result is (Kvas, 2019, section 2.4).  ``regions`` gives an id for each latitude and
    longitude in degrees; the load Love numbers ``kn`` have no default.
    """

    def __init__(self, nmax: int, kn, psi0_km: float | None = None, regions: Callable | None = None, min_degree: int = 0, r: float = R_EARTH, bands: int = 4):
        self.n, self.m, self.cs = index_arrays(nmax, min_degree)
        self.factor = kernel_factors("ewh", nmax, kn=kn)[self.n]
        if np.any(self.factor == 0):
            raise ValueError("the load kernel vanishes at some degree")
        self.lat, self.lon, self.w = special.quadrature(nmax)
        self.psi0, self.r = psi0_km, r
        self.region = None if regions is None else np.asarray(regions(np.degrees(self.lat), np.degrees(self.lon)), float)
        if self.region is not None and self.region.shape != self.lat.shape:
            raise ValueError(f"{self.region.size} region ids for {self.lat.size} points")
        step = bands * (2 * nmax + 2)
        self.strips = [np.arange(lo, min(lo + step, len(self.lat))) for lo in range(0, len(self.lat), step)]

    def basis(self, points: np.ndarray) -> np.ndarray:
        return special.ylm(self.lat[points], self.lon[points], self.n, self.m, self.cs)

    def forward(self, points: np.ndarray) -> np.ndarray:
        """From coefficients to the points [points, coefficients]."""
        return self.basis(points) * self.factor

    def back(self, points: np.ndarray) -> np.ndarray:
        """From the points to coefficients [coefficients, points]; over all points the inverse of ``forward``."""
        return (self.basis(points) / self.factor).T * self.w[points]

    def weight(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones((len(a), len(b)))
        if self.region is not None:
            out *= self.region[a][:, None] == self.region[b][None, :]
        if self.psi0 is not None:
            cos = np.sin(self.lat[a])[:, None] * np.sin(self.lat[b]) + np.cos(self.lat[a])[:, None] * np.cos(self.lat[b]) * np.cos(self.lon[a][:, None] - self.lon[b])
            same = (a[:, None] == b[None, :])
            out *= np.exp(-np.where(same, 0.0, np.arccos(np.clip(cos, -1, 1))) * self.r / 1000 / self.psi0)
        return out

    def __call__(self, covariance: np.ndarray) -> np.ndarray:
        """For a matrix that fits in one place, such as a lag's covariance in ``kalman.fit_var``."""
        out = np.zeros_like(covariance)
        for a in self.strips:
            height, k = self.forward(a) @ covariance, np.zeros((len(a), len(self.n)))
            for b in self.strips:
                k += (self.weight(a, b) * (height @ self.forward(b).T)) @ self.back(b).T
            out += self.back(a) @ k
        return (out + out.T) / 2


def condition(tiles: DataFrame, conditioner: Conditioner, size: int = SIZE) -> DataFrame:
    """Lower tiles of the conditioned covariance from all tiles of a covariance.

    Points come in strips of latitude bands.  Water heights of a strip against a column of tiles are one group; a
    strip then meets all others with its row of heights only; a tile of the result gathers its column of strips.
    """
    order, strips = len(conditioner.n), len(conditioner.strips)
    count = -(-order // size)
    shared = tiles.sparkSession.sparkContext.broadcast(conditioner)  # grid and index vectors, set by nmax

    def cut(k: int) -> slice:
        return slice(k * size, min((k + 1) * size, order))

    def heights(pdf: pd.DataFrame) -> pd.DataFrame:
        c, a, j = shared.value, int(pdf["a"].iloc[0]), int(pdf["j"].iloc[0])
        g = c.forward(c.strips[a])
        return _frame([(a, j, sum(g[:, cut(int(r["i"]))] @ _matrix(r) for r in pdf.to_dict("records")))])

    def weakened(pdf: pd.DataFrame) -> pd.DataFrame:
        c, a = shared.value, int(pdf["i"].iloc[0])
        height, k = np.zeros((len(c.strips[a]), order)), np.zeros((len(c.strips[a]), order))
        for r in pdf.to_dict("records"):
            height[:, cut(int(r["j"]))] = _matrix(r)
        for b in c.strips:
            k += (c.weight(c.strips[a], b) * (height @ c.forward(b).T)) @ c.back(b).T
        return _frame([(a, j, k[:, cut(j)]) for j in range(count)])

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        c, i, j = shared.value, int(pdf["o"].iloc[0]), int(pdf["j"].iloc[0])
        total = sum(c.back(c.strips[int(r["i"])])[cut(i)] @ _matrix(r) for r in pdf.to_dict("records"))
        return _frame([(i, j, (total + total.T) / 2 if i == j else total)])

    high = tiles.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).groupBy("a", "j").applyInPandas(heights, TILE)
    weak = high.groupBy("i").applyInPandas(weakened, TILE)
    return weak.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where("o >= j").groupBy("o", "j").applyInPandas(gathered, TILE)


def error_map(tiles: DataFrame, nmax: int, lat_deg, lon_deg, factors=None, min_degree: int = 0, size: int = SIZE, points: int = 1024) -> DataFrame:
    """(lat, lon, sigma) of a field whose coefficients have the covariance of the tiles (all of them): the diagonal of B C B'.

    Every tile meets every strip of points and gives each point a share; shares add up by point.
    """
    n, m, cs = index_arrays(nmax, min_degree)
    factor = (np.ones(nmax + 1) if factors is None else np.asarray(factors, float))[n]
    lat, lon = np.repeat(np.asarray(lat_deg, float), len(lon_deg)), np.tile(np.asarray(lon_deg, float), len(lat_deg))
    shared = tiles.sparkSession.sparkContext.broadcast((n, m, cs, factor, lat, lon))  # grid and index, set by nmax
    strips = -(-len(lat) // points)

    def run(batches):
        n, m, cs, factor, lat, lon = shared.value
        for pdf in batches:
            for r in pdf.to_dict("records"):
                at = np.arange(r["strip"] * points, min((r["strip"] + 1) * points, len(lat)))
                i, j = (slice(r[k] * size, r[k] * size + r[s]) for k, s in (("i", "h"), ("j", "w")))
                one, two = (special.ylm(np.radians(lat[at]), np.radians(lon[at]), n[c], m[c], cs[c]) * factor[c] for c in (i, j))
                yield pd.DataFrame({"point": at, "share": ((one @ _matrix(r)) * two).sum(axis=1)})

    shares = tiles.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).mapInPandas(run, "point bigint, share double")
    sums = shares.groupBy("point").agg(F.sqrt(F.greatest(F.sum("share"), F.lit(0.0))).alias("sigma"))

    def placed(batches):
        *_, lat, lon = shared.value
        for pdf in batches:
            yield pd.DataFrame({"lat": lat[pdf["point"]], "lon": lon[pdf["point"]], "sigma": pdf["sigma"]})

    return sums.mapInPandas(placed, "lat double, lon double, sigma double")
