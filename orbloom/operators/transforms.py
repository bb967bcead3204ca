"""Synthesis of fields from coefficients and analysis of fields into coefficients.

Basis tables depend on nmax and the grid alone; they are made once in numpy and broadcast as dimension tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions import special
from orbloom.functions.index import index_arrays, literal_table
from orbloom.operators import batches


def legendre_rows(nmax: int, lat_deg) -> list[tuple]:
    p = special.legendre(nmax, np.radians(lat_deg))
    return [(float(lat), n, m, float(p[n, m, i])) for i, lat in enumerate(np.atleast_1d(lat_deg)) for n in range(nmax + 1) for m in range(n + 1)]


def longitude_rows(nmax: int, lon_deg) -> list[tuple]:
    """(lon, m, cs, factor)."""
    return [(float(lon), m, cs, float((np.cos, np.sin)[cs](m * np.radians(lon)))) for lon in np.atleast_1d(lon_deg) for m in range(nmax + 1) for cs in ((0, 1) if m else (0,))]


def synthesis(coef: DataFrame, keys: list[str], nmax: int, lat_deg, lon_deg, factors=None) -> DataFrame:
    """Field values by (keys, lat, lon): sums over degree by latitude and order, then over order by longitude.

    Sets are dealt by their keys and met whole, many in a batch; a null coefficient adds nothing, a set of nulls alone is null.
    """
    lat, lon = np.atleast_1d(np.asarray(lat_deg, float)), np.atleast_1d(np.asarray(lon_deg, float))
    k = np.ones(nmax + 1) if factors is None else np.asarray(factors, float)[: nmax + 1]
    shared = coef.sparkSession.sparkContext.broadcast((lat, lon, k))  # grid axes and factors

    def run(table, at):
        lat, lon, k = shared.value
        if "p" not in made:
            arg = np.arange(nmax + 1)[:, None] * np.radians(lon)
            made["p"], made["trig"] = special.legendre(nmax, np.radians(lat)) * k[:, None, None], np.concatenate([np.cos(arg), np.sin(arg)])
        group = np.repeat(np.arange(len(at)), np.diff([*at, table.num_rows]))
        n, m, cs = (table.column(c).to_numpy() for c in ("n", "m", "cs"))
        v = batches.floats(table, "v")
        good = ~np.isnan(v)
        c = np.zeros((nmax + 1, 2, len(at), nmax + 1))  # order, C or S, set, degree
        np.add.at(c, (m[good], cs[good], group[good], n[good]), v[good])
        null = np.bincount(group[good], minlength=len(at)) == 0
        step = max(1, (1 << 18) // (len(lat) * len(lon)))
        for lo in range(0, len(at), step):
            part = c[:, :, lo : lo + step]
            rings = np.stack([part[o] @ made["p"][:, o] for o in range(nmax + 1)])  # order, C or S, set, latitude
            field = np.moveaxis(rings, (1, 0), (2, 3)).reshape(part.shape[2], len(lat), -1) @ made["trig"]
            size, count = part.shape[2], len(lat) * len(lon)
            mask = np.repeat(null[lo : lo + step], count)
            columns = {"lat": np.tile(np.repeat(lat, len(lon)), size), "lon": np.tile(lon, len(lat) * size), "value": pa.array(field.ravel(), mask=mask)}
            yield batches.repeated(table, keys, np.repeat(at[lo : lo + step], count), columns)

    made: dict[str, np.ndarray] = {}
    rows = coef.where(F.col("n") <= nmax).select(*keys, "n", "m", "cs", F.col("v").cast("double").alias("v"))
    return batches.map_groups(rows, keys, [], run, batches.types(coef, keys) + "lat double, lon double, value double")


def synthesis_dense(vectors: DataFrame, nmax: int, lat_deg, lon_deg, factors=None, min_degree: int = 0) -> DataFrame:
    """The same from one vector per row, as matrix products in Arrow batches: for large nmax or many epochs."""
    n, m, cs = index_arrays(nmax, min_degree)
    lat, lon = np.repeat(np.radians(lat_deg), len(lon_deg)), np.tile(np.radians(lon_deg), len(lat_deg))
    basis = special.ylm(lat, lon, n, m, cs) * (np.ones(nmax + 1) if factors is None else np.asarray(factors))[n]
    shared = vectors.sparkSession.sparkContext.broadcast(basis)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ shared.value.T)) if len(x) else x

    return vectors.withColumn("grid", run("x"))


def synthesis_rings(vectors: DataFrame, keys: list[str], nmax: int, lat_deg, lon_deg, factors=None, min_degree: int = 0) -> DataFrame:
    """Fields of large degree: (keys, lat, field array over the longitudes), a row for each ring, from one vector per row.

    Sums over the degree by latitude and order, then over the order by longitude, as matrix products in the tasks: a set
    costs (nmax x grid) operations, and a task holds one set's grid and Legendre functions, not a dense basis.
    """
    n, m, cs = index_arrays(nmax, min_degree)
    factor = (np.ones(nmax + 1) if factors is None else np.asarray(factors, float))[n]
    shared = vectors.sparkSession.sparkContext.broadcast((n, m, cs, factor, np.asarray(lat_deg, float), np.asarray(lon_deg, float)))  # index and grid axes
    schema = "".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}, " for k in keys) + "lat double, field array<double>"

    def run(batches):
        n, m, cs, factor, lat, lon = shared.value
        p = special.legendre(nmax, np.radians(lat)).transpose(1, 2, 0).copy()  # order, latitude, degree
        arg = np.arange(nmax + 1)[:, None] * np.radians(lon)[None, :]
        trig = np.concatenate([np.cos(arg), np.sin(arg)])
        for pdf in batches:
            for r in pdf.to_dict("records"):
                c = np.zeros((nmax + 1, nmax + 1, 2))
                c[m, n, cs] = factor * r["x"]
                rings = p @ c  # order, latitude, C and S
                field = np.concatenate([rings[..., 0], rings[..., 1]]).T @ trig
                yield pd.DataFrame({**{k: [r[k]] * len(lat) for k in keys}, "lat": lat, "field": list(field)})

    return vectors.select(*keys, "x").mapInPandas(run, schema)


def synthesis_points(coef: DataFrame, points: DataFrame, keys: list[str], nmax: int, quantity: str = "potential", gm: float = special.GM_EARTH, r: float = special.R_EARTH, min_degree: int = 2) -> DataFrame:
    """Potential, disturbance or anomaly of every set at scattered points (point_id, lat, lon, radius).

    A point's basis is made once, batch by batch, whatever the number of sets; sets meet it by an equi-join on the
    coefficient and one grouped sum, combined before the shuffle.
    """
    n, m, cs = index_arrays(nmax, min_degree)
    power = {"potential": 1, "gravity_disturbance": 2, "gravity_anomaly": 2}[quantity]
    factor = special.kernel_factors(quantity, nmax, gm, r)[n]
    names = [f.name for f in points.schema]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema] + ["n int, m int, cs int, y double"])

    def run(batches):
        for pdf in batches:
            y = special.ylm(np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy()), n, m, cs) * factor * (r / pdf["radius"].to_numpy()[:, None]) ** (n + power)
            k = np.repeat(np.arange(len(pdf)), len(n))
            yield pdf[names].iloc[k].reset_index(drop=True).assign(n=np.tile(n, len(pdf)), m=np.tile(m, len(pdf)), cs=np.tile(cs, len(pdf)), y=y.ravel())

    basis = points.mapInPandas(run, schema)
    return coef.where(F.col("n") >= min_degree).join(basis, ["n", "m", "cs"]).groupBy(*keys, *names).agg(F.sum(F.col("v") * F.col("y")).alias("value"))


def deformation(coef: DataFrame, keys: list[str], nmax: int, lat_deg, lon_deg, kn, hn, ln, r: float = special.R_EARTH, least: int = 1) -> DataFrame:
    """Up, north and east load deformation; east is null at the poles."""
    n = np.arange(nmax + 1)
    load = np.where(n >= least, r / (1 + np.asarray(kn, float)[: nmax + 1]), 0.0)
    p, d, _ = special.legendre_derivative(nmax, np.radians(lat_deg))
    rows = []
    for i, lat in enumerate(np.atleast_1d(lat_deg)):
        cos = np.cos(np.radians(lat))
        for a in range(nmax + 1):
            for m in range(a + 1):
                east = float(load[a] * ln[a] * m * p[a, m, i] / cos) if cos > 1e-12 else None
                rows.append((float(lat), a, m, float(load[a] * hn[a] * p[a, m, i]), float(load[a] * ln[a] * d[a, m, i]), east))
    spark = coef.sparkSession
    basis = F.broadcast(literal_table(spark, ["lat", "n", "m", "u", "d", "e"], rows))
    t = literal_table(spark, ["lon", "m", "cs", "f"], longitude_rows(nmax, lon_deg))
    turned = t.select("lon", "m", (1 - F.col("cs")).alias("cs"), F.when(F.col("cs") == 1, -F.col("f")).otherwise(F.col("f")).alias("g"))
    t = F.broadcast(t.join(turned, ["lon", "m", "cs"], "left").withColumn("g", F.coalesce("g", F.lit(0.0))))
    rings = coef.join(basis, ["n", "m"]).groupBy(*keys, "lat", "m", "cs").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in "ude"])
    return rings.join(t, ["m", "cs"]).groupBy(*keys, "lat", "lon").agg(F.sum(F.col("u") * F.col("f")).alias("up"), F.sum(F.col("d") * F.col("f")).alias("north"), F.sum(F.col("e") * F.col("g")).alias("east"))


def gradient_tensor(vectors: DataFrame, nmax: int, lat_deg, lon_deg, height: float = 250e3, gm: float = special.GM_EARTH, r: float = special.R_EARTH, least: int = 2) -> DataFrame:
    """North, east, up second derivatives of the potential at a height: nn, ee, uu, ne, nu, eu; their trace is zero."""
    n, m, cs = index_arrays(nmax, 0)
    lat, lon = np.repeat(np.radians(lat_deg), len(lon_deg)), np.tile(np.radians(lon_deg), len(lat_deg))
    p, d, dd = (x[n, m].T for x in special.legendre_derivative(nmax, lat))
    arg = lon[:, None] * m
    f, g = np.where(cs == 0, np.cos(arg), np.sin(arg)), np.where(cs == 0, -np.sin(arg), np.cos(arg)) * m
    rad = r + height
    scale = np.where(n >= least, gm / rad**3 * (r / rad) ** n, 0.0)
    cos, tan = np.cos(lat)[:, None], np.tan(lat)[:, None]
    basis = {
        "uu": scale * (n + 1) * (n + 2) * p * f,
        "nn": scale * (dd - (n + 1) * p) * f,
        "ee": scale * ((-(m**2) / cos**2 - (n + 1)) * p - tan * d) * f,
        "ne": scale * (d + tan * p) / cos * g,
        "nu": -scale * (n + 2) * d * f,
        "eu": -scale * (n + 2) * p / cos * g,
    }
    shared = vectors.sparkSession.sparkContext.broadcast(basis)
    cols = [c for c in vectors.columns if c != "x"]
    schema = ", ".join([f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in cols] + [f"{k} array<double>" for k in basis])

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(n)))
            yield pdf[cols].assign(**{k: list(x @ b.T) for k, b in shared.value.items()})

    return vectors.mapInPandas(run, schema)


def _coefficients(table: pa.Table, keys: list[str], at: np.ndarray, index: tuple, x: np.ndarray, null: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each set and coefficient, from the sets' vectors."""
    size = len(index[0])
    v = pa.array(np.ascontiguousarray(x).ravel(), mask=None if null is None else np.repeat(null, size))
    return batches.repeated(table, keys, np.repeat(at, size), {c: np.tile(i.astype("int32"), len(at)) for c, i in zip(("n", "m", "cs"), index)} | {"v": v})


def analysis(grid: DataFrame, keys: list[str], nmax: int, weights: bool = True, kaula: float = 0.0) -> DataFrame:
    """Least-squares coefficients of points (lat, lon, value), by chunked normal equations; fields at equal points share one factor."""
    index = n, m, cs = index_arrays(nmax, 0)

    def run(table, at):
        ends = [*at[1:], table.num_rows]
        lat, lon, value = (batches.floats(table, c) for c in ("lat", "lon", "value"))
        places: dict[tuple, list[int]] = {}
        for g, (lo, hi) in enumerate(zip(at, ends)):
            places.setdefault((lat[lo:hi].tobytes(), lon[lo:hi].tobytes()), []).append(g)
        x = np.zeros((len(at), len(n)))
        for groups in places.values():
            first, size = at[groups[0]], ends[groups[0]] - at[groups[0]]
            rows = at[groups][:, None] + np.arange(size)
            a, b = np.zeros((len(n), len(n))), np.zeros((len(groups), len(n)))
            for lo in range(0, size, 2000):
                hi = min(size, lo + 2000)
                part = np.radians(lat[first + lo : first + hi])
                y = special.ylm(part, np.radians(lon[first + lo : first + hi]), n, m, cs)
                w = y * np.cos(part)[:, None] if weights else y
                a += w.T @ y
                b += value[rows[:, lo:hi]] @ w
            if kaula:
                a = a + kaula * np.diag(np.maximum(n, 1.0) ** 4)
            elif np.linalg.matrix_rank(a) < len(n):
                raise ValueError(f"the points do not determine {len(n)} coefficients")
            x[groups] = np.linalg.solve(a, b.T).T
        yield _coefficients(table, keys, at, index, x)

    rows = grid.where(F.col("value").isNotNull()).select(*keys, *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "value")])
    return batches.map_groups(rows, keys, ["lat", "lon"], run, batches.types(grid, keys) + "n int, m int, cs int, v double")


def analysis_quadrature(grid: DataFrame, keys: list[str], nmax: int, lat_deg, lon_deg, weights) -> DataFrame:
    """Coefficients of fields on a Gauss-Legendre grid: ring sums by order, then by degree; many fields in a batch.

    Places off the grid do not count; a null value adds nothing, a field of nulls alone gives nulls.
    """
    index = n, m, cs = tuple(np.array(i) for i in zip(*[(n, m, cs) for n in range(nmax + 1) for m in range(n + 1) for cs in ((0, 1) if m else (0,))]))
    axes = np.asarray(lat_deg, float), np.asarray(lon_deg, float), np.asarray(weights, float)
    shared = grid.sparkSession.sparkContext.broadcast(axes)
    made: dict[str, np.ndarray] = {}

    def run(table, at):
        lat, lon, w = shared.value
        if "p" not in made:
            arg = np.radians(lon)[:, None] * np.arange(nmax + 1)
            made["p"], made["trig"] = special.legendre(nmax, np.radians(lat)) * w, np.concatenate([np.cos(arg), np.sin(arg)], axis=1)
        group = np.repeat(np.arange(len(at)), np.diff([*at, table.num_rows]))
        value = batches.floats(table, "value")
        i, j = (pd.Index(a).get_indexer(batches.floats(table, c)) for a, c in ((lat, "lat"), (lon, "lon")))
        on = (i >= 0) & (j >= 0)
        good = on & ~np.isnan(value)
        field = np.zeros((len(at), len(lat), len(lon)))
        np.add.at(field, (group[good], i[good], j[good]), value[good])
        rings = (field @ made["trig"]).reshape(len(at), len(lat), 2, nmax + 1)
        c = np.stack([np.einsum("sic,ni->scn", rings[..., o], made["p"][:, o], optimize=True) for o in range(nmax + 1)], axis=-1)  # set, C or S, degree, order
        keep = np.bincount(group[on], minlength=len(at)) > 0
        null = np.bincount(group[good], minlength=len(at)) == 0
        yield _coefficients(table, keys, at[keep], index, c[keep][:, cs, n, m], null[keep])

    rows = grid.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "value")])
    return batches.map_groups(rows, keys, [], run, batches.types(grid, keys) + "n int, m int, cs int, v double")


def amplitude_phase(cos_field: DataFrame, sin_field: DataFrame, on: list[str]) -> DataFrame:
    j = cos_field.select(*on, F.col("value").alias("c")).join(sin_field.select(*on, F.col("value").alias("s")), on)
    return j.select(*on, F.hypot("c", "s").alias("amplitude"), F.atan2("s", "c").alias("phase"))


def error_map(covariance: np.ndarray, nmax: int, lat_deg, lon_deg, factors=None, min_degree: int = 2) -> np.ndarray:
    """Standard deviation of the field: square root of the diagonal of A M A' through a factor of M."""
    n, m, cs = index_arrays(nmax, min_degree)
    lat, lon = np.repeat(np.radians(lat_deg), len(lon_deg)), np.tile(np.radians(lon_deg), len(lat_deg))
    a = special.ylm(lat, lon, n, m, cs) * (np.ones(nmax + 1) if factors is None else factors)[n]
    try:
        root = np.linalg.cholesky(covariance)
    except np.linalg.LinAlgError:
        w, v = np.linalg.eigh((covariance + covariance.T) / 2)
        root = v * np.sqrt(np.maximum(w, 0))
    return np.sqrt(((a @ root) ** 2).sum(axis=1)).reshape(len(lat_deg), len(lon_deg))
