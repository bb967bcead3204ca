"""Readers and writers of the file formats of gravity-field products.

Files come through Spark's own readers (any store that Spark can open), a file at a time; parsing runs in the
tasks that read them.  Gzip is recognised by its first bytes.  Broken records are kept as rows of kind ``bad``.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbloom.functions.index import literal_table
from orbloom.functions.scalars import date_code_epoch, file_name_epoch, product_of
from orbloom.functions.special import GM_EARTH, R_EARTH

ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
PACKED_MARK = b"ORBK"  # of our own packing of block matrices; the published form is read by block_matrix


def _content(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _parsed(spark: SparkSession, path: str, pattern: str | None, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    r = spark.read.format("binaryFile")
    files = (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content").where(~F.col("path").endswith(".provenance.json"))
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0), b.column(1)):
                rows = []
                for r in parse(p.as_py(), _content(raw.as_py())):
                    if isinstance(r, pa.Table):  # parsed in bulk
                        yield from r.select(arrow.names).cast(arrow).to_batches(max_chunksize=100_000)
                    else:
                        rows.append(r)
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches(max_chunksize=100_000)

    return files.mapInArrow(run, schema)


def number(token: str) -> float | None:
    """A number with an E or a Fortran D exponent; None for NaN or anything else."""
    try:
        x = float(token.replace("D", "E").replace("d", "e"))
    except ValueError:
        return None
    return x if x == x else None


# --- coefficient files ----------------------------------------------------------------------------------------------

GFC = "path string, kind string, n int, m int, c double, s double, sigma_c double, sigma_s double, t0 double, t1 double, period double, text string"
KINDS = {"gfc": "gfc", "gfct": "gfct", "trnd": "trnd", "dot": "trnd", "acos": "acos", "asin": "asin"}


def _static_gfc(path: str, body: bytes) -> pa.Table | None:
    """Records of static coefficients in one pass; None if there is anything else among them."""
    try:
        x = pd.read_csv(io.BytesIO(body.replace(b"D", b"E")), sep=r"\s+", header=None)
    except (ValueError, pd.errors.ParserError):
        return None
    if len(x.columns) not in (5, 7) or not (x[0] == "gfc").all() or any(x[k].dtype.kind not in "if" for k in x.columns[1:]) or x[[1, 2, 3, 4]].isna().any(axis=None):
        return None
    n = len(x)
    sigma = {f"sigma_{c}": pa.array(x[k].astype(float), from_pandas=True) if k in x.columns else pa.nulls(n, pa.float64()) for c, k in (("c", 5), ("s", 6))}
    empty = {c: pa.nulls(n, pa.float64()) for c in ("t0", "t1", "period")}
    return pa.table({"path": pa.array([path]).take(pa.array(np.zeros(n, np.int32))), "kind": pa.array(["gfc"]).take(pa.array(np.zeros(n, np.int32))), "n": x[1].astype(int), "m": x[2].astype(int), "c": x[3].astype(float), "s": x[4].astype(float), **sigma, **empty, "text": pa.nulls(n, pa.string())})


def parse_gfc(path: str, raw: bytes) -> Iterator[dict | pa.Table]:
    """Header lines as kind 'header' (key and value in text), then the records."""
    at = raw.find(b"end_of_head")
    start = raw.find(b"\n", at) + 1 if at >= 0 else 0
    if (start or at < 0) and raw[start : start + 4].strip() == b"gfc" and (table := _static_gfc(path, raw[start:])) is not None:
        yield table
        raw = raw[:start]
    lines = raw.decode("utf-8", "replace").splitlines()
    end = next((i for i, x in enumerate(lines) if x.strip().startswith("end_of_head")), -1)
    for x in lines[:end] if end >= 0 else []:
        if len(w := x.split(None, 1)) == 2:
            yield {"path": path, "kind": "header", "text": f"{w[0]}\t{w[1].strip()}"}
    for x in lines[end + 1 :]:
        w = x.split()
        if not w or w[0] not in KINDS:
            continue
        v = [number(t) for t in w[1:]]
        if len(v) < 4 or any(q is None for q in v[:4]):
            yield {"path": path, "kind": "bad", "text": x}
            continue
        kind, rest = KINDS[w[0]], v[4:]
        row = {"path": path, "kind": kind, "n": int(v[0]), "m": int(v[1]), "c": v[2], "s": v[3]}
        times = rest[2:] if len(rest) >= 2 else []
        row |= {"sigma_c": rest[0] if len(rest) >= 2 else None, "sigma_s": rest[1] if len(rest) >= 2 else None}
        if kind in ("acos", "asin") and len(times) in (1, 3):
            row["period"], times = times[-1], times[:-1]
        if times:
            row |= {"t0": times[0], "t1": times[1] if len(times) > 1 else None}
        yield row


def read_gfc(spark: SparkSession, path: str, pattern: str = "*.gfc*", nmax: int | None = None) -> DataFrame:
    """All records of coefficient files, with epochs of their time spans as decimal years."""
    x = _parsed(spark, path, pattern, parse_gfc, GFC)
    x = x.withColumns({t: date_code_epoch(F.col(t)) for t in ("t0", "t1")})
    return x if nmax is None else x.where(F.col("n").isNull() | (F.col("n") <= nmax))


def gfc_headers(records: DataFrame) -> DataFrame:
    """One row per file: header map, GM, R, product and epoch from the file name."""
    kv = F.split("text", "\t", 2)
    h = records.where("kind = 'header'").groupBy("path").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(kv[0].alias("k"), kv[1].alias("v"))))).alias("header"))
    name = F.element_at(F.split("path", "/"), -1)

    def num(key: str, default: float):
        return F.coalesce(F.expr(f"try_cast(replace(replace(header['{key}'], 'D', 'E'), 'd', 'e') AS double)"), F.lit(default))

    return h.select("path", "header", num("earth_gravity_constant", GM_EARTH).alias("gm"), num("radius", R_EARTH).alias("r"), F.coalesce(F.col("header")["modelname"], name).alias("name"), product_of(name).alias("product"), file_name_epoch(name).alias("epoch"))


def gfc_coefficients(records: DataFrame) -> DataFrame:
    """Static coefficients as (set_id, epoch, n, m, cs, v, s); S(n, 0) is left out."""
    x = records.where("kind IN ('gfc', 'gfct')").withColumn("epoch", file_name_epoch(F.element_at(F.split("path", "/"), -1)))
    parts = F.array(F.struct(F.lit(0).alias("cs"), F.col("c").alias("v"), F.col("sigma_c").alias("s")), F.struct(F.lit(1).alias("cs"), F.col("s").alias("v"), F.col("sigma_s").alias("s")))
    return x.select(F.col("path").alias("set_id"), "epoch", "n", "m", F.explode(parts).alias("x")).where("x.cs = 0 OR m > 0").select("set_id", "epoch", "n", "m", "x.cs", "x.v", "x.s")


def gfc_terms(records: DataFrame) -> DataFrame:
    """Time-variable terms in the layout of ``nearest.evaluate_terms``; key is 'path/n/m/cs'."""
    x = records.where("kind IN ('gfct', 'trnd', 'acos', 'asin')")
    parts = F.array(F.struct(F.lit(0).alias("cs"), F.col("c").alias("v")), F.struct(F.lit(1).alias("cs"), F.col("s").alias("v")))
    kind = F.when(F.col("kind") == "gfct", F.lit("const")).otherwise(F.col("kind"))
    return x.select(kind.alias("kind"), "path", "n", "m", "t0", F.coalesce("t1", F.lit(9999.0)).alias("t1"), "period", F.explode(parts).alias("x")).select(F.concat_ws("/", "path", "n", "m", "x.cs").alias("key"), "kind", F.col("x.v").alias("value"), "t0", "t1", "period")


def write_gfc(coef: DataFrame, path: str, nmax: int, name: str = "model", gm: float = GM_EARTH, r: float = R_EARTH, tide: str = "unknown", sidecar: bool = True) -> None:
    """One set as a text file, degree by degree; one set has at most (nmax + 1)**2 rows, so one task writes it."""
    spark = coef.sparkSession
    head = ["product_type gravity_field", f"modelname {name}", f"earth_gravity_constant {gm:.14e}", f"radius {r:.14e}", f"max_degree {nmax}", "errors formal", "norm fully_normalized", f"tide_system {tide}", "end_of_head"]
    lines = spark.createDataFrame([(-1, k, x) for k, x in enumerate(head)], "a int, b int, value string")
    side = [F.coalesce(F.max(F.when(F.col("cs") == k, F.col(c))), F.lit(0.0)).alias(f"{c}{k}") for c in ("v", "s") for k in (0, 1)]
    rec = coef.groupBy("n", "m").agg(*side).select(F.col("n").alias("a"), F.col("m").alias("b"), F.format_string("gfc %5d %5d %22.14e %22.14e %22.14e %22.14e", "n", "m", "v0", "v1", "s0", "s1").alias("value"))
    lines.unionByName(rec).coalesce(1).sortWithinPartitions("a", "b").select("value").write.text(path)
    if sidecar:
        note = json.dumps({"tool": "orbloom", "file": path, "name": name, "nmax": nmax})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{path}.provenance.json")


SHM = "path string, kind string, n int, m int, c double, s double, sigma_c double, sigma_s double, first string, last string"


def parse_shm(path: str, raw: bytes) -> Iterator[dict]:
    """GRCOF2 (fields) or GRDOTA (rates) records after a YAML header; one file holds one kind."""
    text = raw.decode("utf-8", "replace")
    body = text.split("# End of YAML header", 1)[-1]
    kinds = set()
    for line in body.splitlines():
        w = line.split()
        if not w or w[0] not in ("GRCOF2", "GRDOTA") or len(w) < 5:
            continue
        kinds.add(w[0])
        if len(kinds) > 1:
            raise ValueError(f"{path} mixes fields and rates")
        v = [number(t) for t in w[1:7]] + [None] * 6
        yield {"path": path, "kind": w[0], "n": int(v[0]), "m": int(v[1]), "c": v[2], "s": v[3], "sigma_c": v[4], "sigma_s": v[5], "first": w[7] if len(w) > 7 else None, "last": w[8] if len(w) > 8 else None}


def read_shm(spark: SparkSession, path: str, pattern: str | None = None, nmax: int | None = None) -> DataFrame:
    x = _parsed(spark, path, pattern, parse_shm, SHM)
    return x if nmax is None else x.where(F.col("n") <= nmax)


# --- correction tables (plain text: Catalyst expressions only) ------------------------------------------------------------


def read_geocentre(spark: SparkSession, path: str) -> DataFrame:
    """TN-13: two GRCOF2 lines a month to (epoch, c10, c11, s11) with sigmas; the epoch is the middle of the span."""
    w = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).where("value LIKE 'GRCOF2%'").select(*[w[k].alias(f"w{k}") for k in range(9)])
    d = {c: F.expr(f"try_cast(replace(w{k}, 'D', 'E') AS double)") for c, k in (("c", 3), ("s", 4), ("sc", 5), ("ss", 6), ("d0", 7), ("d1", 8))}
    x = x.where("w1 = '1'").select("w2", *[e.alias(c) for c, e in d.items()])

    def pick(m: str, c: str):
        return F.max(F.when(F.col("w2") == m, F.col(c)))

    g = x.groupBy("d0", "d1").agg(pick("0", "c").alias("c10"), pick("1", "c").alias("c11"), pick("1", "s").alias("s11"), pick("0", "sc").alias("sigma_c10"), pick("1", "sc").alias("sigma_c11"), pick("1", "ss").alias("sigma_s11"))
    return g.withColumn("epoch", (date_code_epoch(F.floor("d0").cast("double")) + date_code_epoch(F.floor("d1").cast("double"))) / 2).drop("d0", "d1")


def read_low_degrees(spark: SparkSession, path: str) -> DataFrame:
    """TN-14: lines of ten numbers to (epoch, c20, c30) with sigmas; a NaN C30 is null."""
    w = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).where((F.size(w) == 10) & F.trim("value").rlike(r"^[0-9.]+\s"))
    v = [F.nullif(F.replace(w[k], F.lit("D"), F.lit("E")).try_cast("double"), F.lit(float("nan"))) for k in range(10)]
    return x.select(((v[1] + v[9]) / 2).alias("epoch"), v[2].alias("c20"), (v[4] * 1e-10).alias("sigma_c20"), v[5].alias("c30"), (v[7] * 1e-10).alias("sigma_c30"))


def read_table(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Numbers of a white-space table with # comments, as an array of ``columns`` or more."""
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.trim("value").startswith("#") & (F.size(w) >= columns)).select(F.transform(w, lambda t: t.try_cast("double")).alias("x"))


def read_love_numbers(spark: SparkSession, path: str, columns: tuple[str, ...] = ("n", "k")) -> DataFrame:
    """Rows of degree and load numbers; comment and header lines go, the first row of a degree counts."""
    x = read_table(spark, path, len(columns)).where(F.col("x")[0].isNotNull())
    x = x.select(*[(F.col("x")[k].cast("int") if c == "n" else F.col("x")[k]).alias(c) for k, c in enumerate(columns)])
    return x.where("n IS NOT NULL").dropDuplicates(["n"])


def parse_load_column(path: str, raw: bytes, least: int = 100) -> Iterator[dict]:
    """One column of numbers by degree: a matrix of N x 1 behind a two-line head, or bare, if it is long and all numbers."""
    lines = [x for x in raw.decode("utf-8", "replace").strip().splitlines() if x.strip()]
    if len(lines) >= 3 and "groops matrix" in lines[0]:
        size = re.search(r"Matrix\(\s*(\d+)\s*x\s*(\d+)\s*\)", lines[1])
        if not size or int(size[2]) != 1:
            raise ValueError(f"{path}: a matrix of one column is expected, not {lines[1].strip()!r}")
        lines, least = lines[2 : 2 + int(size[1])], int(size[1])
    values = [number(x.strip()) for x in lines]
    if len(values) < least or any(v is None or v in (float("inf"), float("-inf")) for v in values):
        raise ValueError(f"{path}: neither a matrix file nor a column of at least {least} numbers")
    for n, v in enumerate(values):
        yield {"path": path, "n": n, "value": v}


def read_load_column(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, n, value) of matrix files with one load number for each degree."""
    return _parsed(spark, path, pattern, parse_load_column, "path string, n int, value double")


def love_frame_shift(numbers: DataFrame, offset: float) -> DataFrame:
    """Changes the frame of degree 1 by an offset of k (and of h and l, where present)."""
    cols = [c for c in ("k", "h", "l") if c in numbers.columns]
    return numbers.withColumns({c: F.when(F.col("n") == 1, F.col(c) - offset).otherwise(F.col(c)) for c in cols})


def interpolate_love(degrees: np.ndarray, values: np.ndarray, nmax: int) -> np.ndarray:
    """Monotone cubic interpolation in log(1 + n) to all degrees up to nmax."""
    x, y = np.log1p(degrees.astype(float)), values.astype(float)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros_like(y)
    for i in range(1, len(y) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])
    m[0], m[-1] = d[0], d[-1]
    t = np.log1p(np.arange(nmax + 1.0))
    k = np.clip(np.searchsorted(x, t, "right") - 1, 0, len(h) - 1)
    s = (t - x[k]) / h[k]
    return (1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h[k] * m[k] + s * s * (3 - 2 * s) * y[k + 1] + s * s * (s - 1) * h[k] * m[k + 1]


# --- matrices --------------------------------------------------------------------------------------------------------------

SINEX = "path string, block string, i int, j int, cs int, n int, m int, value double, sigma double, name string"


def parse_sinex(path: str, raw: bytes, only: str | None = None) -> Iterator[dict]:
    """Estimates, matrices (each entry and its mirror) and statistics; with ``only`` stops after that block."""
    block = None
    for line in raw.decode("utf-8", "replace").splitlines():
        if line.startswith("+"):
            block = line[1:].split()[0]
            continue
        if line.startswith("-"):
            if only and block and only in block:
                return
            block = None
            continue
        if not block or line.startswith("*") or (only and only not in block):
            continue
        w = line.split()
        if block == "SOLUTION/ESTIMATE" and len(w) >= 6 and w[1] in ("CN", "SN"):
            # Producers put the order in different columns: it is the first whole number behind the degree that does not exceed it.
            whole = [int(t) for t in w[2:-2] if t.isdigit()]
            m = next((k for k in whole[1:] if k <= whole[0]), None)
            yield {"path": path, "block": "estimate" if m is not None else "bad", "i": int(w[0]) - 1, "cs": int(w[1] == "SN"), "n": whole[0] if whole else None, "m": m, "value": number(w[-2]), "sigma": number(w[-1])}
        elif "MATRIX" in block and len(w) >= 3:
            i, j = int(w[0]) - 1, int(w[1]) - 1
            for k, t in enumerate(w[2:]):
                yield {"path": path, "block": "normal" if "NORMAL" in block else "covariance", "i": i, "j": j + k, "value": number(t)}
                if i != j + k:
                    yield {"path": path, "block": "normal" if "NORMAL" in block else "covariance", "i": j + k, "j": i, "value": number(t)}
        elif block == "SOLUTION/NORMAL_EQUATION_VECTOR" and len(w) >= 3:
            yield {"path": path, "block": "rhs", "i": int(w[0]) - 1, "value": number(w[-1])}
        elif block == "SOLUTION/STATISTICS" and len(w) >= 2:
            yield {"path": path, "block": "statistics", "name": " ".join(w[:-1]), "value": number(w[-1])}


def read_sinex(spark: SparkSession, path: str, pattern: str | None = None, only: str | None = None) -> DataFrame:
    return _parsed(spark, path, pattern, lambda p, raw: parse_sinex(p, raw, only), SINEX)


def sinex_covariance(spark: SparkSession, path: str, order: list[tuple[int, int, int]] | None = None, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Estimates (i, n, m, cs, value, sigma) and covariance entries (row, col, value) of one file, in the given order of (n, m, cs).

    Normal equations are inverted tile by tile, so the matrix is never in one place; a covariance is taken as it is.
    """
    from orbloom.operators import tiles

    rows = read_sinex(spark, path)
    est = rows.where("block = 'estimate'").select("i", "n", "m", "cs", "value", "sigma")
    count = est.count()
    kinds = {r.block for r in rows.where("block IN ('normal', 'covariance')").select("block").distinct().collect()}
    if not count or not kinds:
        raise ValueError(f"{path}: no estimates or no matrix")
    e = rows.where(F.col("block") == ("normal" if "normal" in kinds else "covariance")).select(F.col("i").alias("row"), F.col("j").alias("col"), "value")
    if e.where((F.col("row") >= count) | (F.col("col") >= count)).limit(1).count():
        raise ValueError(f"{path}: the matrix has more parameters than the {count} estimates")
    if "normal" in kinds:
        e = tiles.entries(tiles.mirrored(tiles.inverse(tiles.from_entries(e.where("row >= col"), count, size), count, size)), size)
    if order is None:
        return est, e
    places = literal_table(spark, ["new", "n", "m", "cs"], [(k, *o) for k, o in enumerate(order)])
    missing = places.join(est, ["n", "m", "cs"], "left_anti").first()
    if missing:
        raise ValueError(f"{path}: coefficient {missing.n}, {missing.m}, {'CS'[missing.cs]} is not in the file")
    moved = est.join(places, ["n", "m", "cs"])
    return moved.select(F.col("new").alias("i"), "n", "m", "cs", "value", "sigma"), tiles.reordered(e, moved.select(F.col("i").alias("old"), "new"))


def sinex_year(token: str) -> float:
    """yy:doy:seconds to a decimal year; yy below 80 is 20yy."""
    y, d, s = (int(x) for x in token.split(":"))
    y += 2000 if y < 80 else 1900
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return y + (d - 1 + s / 86400) / (366 if leap else 365)


BLOCKS = "path string, m int, cs int, n_row int, n_col int, w double"


def parse_blocks(path: str, raw: bytes) -> Iterator[dict]:
    """Filter matrices: 'block m cs n1 n2' and its rows as text, or our own packed form."""
    if raw[:4] == PACKED_MARK:
        yield from _binary_blocks(path, raw)
        return
    head, row = None, 0
    for line in raw.decode("utf-8", "replace").splitlines():
        w = line.split()
        if not w or w[0].startswith("#"):
            continue
        if w[0] == "block":
            head, row = tuple(int(t) for t in w[1:5]), 0
            continue
        m, cs, n1, n2 = head
        if len(w) != n2 - n1 + 1:
            raise ValueError(f"{path}: a row of block {head} has {len(w)} numbers")
        for k, t in enumerate(w):
            yield {"path": path, "m": m, "cs": cs, "n_row": n1 + row, "n_col": n1 + k, "w": number(t)}
        row += 1


def _binary_blocks(path: str, raw: bytes) -> Iterator[dict]:
    """Our own packing, little-endian: mark, count, then (m, cs, n1, n2) and column-major doubles for every block."""
    at = 8
    for _ in range(struct.unpack_from("<I", raw, 4)[0]):
        m, cs, n1, n2 = struct.unpack_from("<4i", raw, at)
        k = n2 - n1 + 1
        w = np.frombuffer(raw, "<f8", k * k, at + 16).reshape(k, k, order="F")
        at += 16 + 8 * k * k
        for i in range(k):
            for j in range(k):
                yield {"path": path, "m": m, "cs": cs, "n_row": n1 + i, "n_col": n1 + j, "w": float(w[i, j])}


def pack_blocks(blocks: list[tuple[int, int, int, int, np.ndarray]]) -> bytes:
    out = PACKED_MARK + struct.pack("<I", len(blocks))
    for m, cs, n1, n2, w in blocks:
        out += struct.pack("<4i", m, cs, n1, n2) + np.asarray(w, "<f8").tobytes(order="F")
    return out


def read_blocks(spark: SparkSession, path: str, pattern: str | None = None, nmax: int | None = None) -> DataFrame:
    """Block filter matrices as (m, cs, n_row, n_col, w); nmax keeps the leading part of every block."""
    x = _parsed(spark, path, pattern, parse_blocks, BLOCKS)
    return x if nmax is None else x.where((F.col("n_row") <= nmax) & (F.col("n_col") <= nmax))


# --- grids and polygons -------------------------------------------------------------------------------------------------------


def write_grid(grid: DataFrame, path: str, units: str, name: str = "field") -> None:
    """Long grids (epoch, lat, lon, value) as Parquet by epoch, with units and name as column metadata."""
    value = F.col("value").alias("value", metadata={"units": units, "long_name": name})
    grid.select("epoch", "lat", "lon", value).write.partitionBy("epoch").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    g = spark.read.parquet(path)
    return g.withColumn("epoch", F.col("epoch").cast("double")).withColumn("lon", F.pmod(F.col("lon"), F.lit(360.0)))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Rings of a GeoJSON file's polygons and multi-part polygons: (name, part, hole, ring array<struct<lat, lon>>).

    The first ring of a part is its outline, the others are holes; a repeated last vertex goes.
    """
    schema = "struct<features:array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>>"
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["features"]).alias("f")).select(F.col("f.properties.name").alias("name"), "f.geometry.*")
    ring = "array<array<double>>"
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", f"array<{ring}>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<array<{ring}>>"))
    x = x.select("name", F.posexplode(parts).alias("part", "rings")).select("name", "part", F.posexplode("rings").alias("k", "r"))
    points = F.transform("r", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    closed = (F.size("r") > 1) & (F.element_at("r", 1) == F.element_at("r", -1))
    return x.select("name", F.col("part").cast("int").alias("part"), (F.col("k") > 0).alias("hole"), F.when(closed, F.slice(points, 1, F.size("r") - 1)).otherwise(points).alias("ring"))


def parse_classic_netcdf(raw: bytes) -> dict:
    """Dimensions, attributes and variables of a classic netCDF file (versions 1 and 2, fixed-size variables)."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("not a classic netCDF file")
    wide, at = raw[3] == 2, 8
    kinds = {1: ("b", 1), 2: ("c", 1), 3: (">h", 2), 4: (">i", 4), 5: (">f", 4), 6: (">d", 8)}

    def u32() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">I", raw, at - 4)[0]

    def text() -> str:
        nonlocal at
        n = u32()
        s = raw[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def values():
        nonlocal at
        code, n = kinds[u32()], u32()
        data = raw[at : at + n * code[1]]
        at += -(-n * code[1] // 4) * 4
        return data.decode("latin-1") if code[0] == "c" else np.frombuffer(data, code[0].replace("b", "i1"))

    def attributes() -> dict:
        u32()
        return {text(): values() for _ in range(u32())}

    u32()
    dims = [(text(), u32()) for _ in range(u32())]
    glob = attributes()
    u32()
    out = {}
    for _ in range(u32()):
        name = text()
        axes = [dims[u32()] for _ in range(u32())]
        att = attributes()
        code = kinds[u32()]
        u32()
        begin = (u32() << 32 | u32()) if wide else u32()
        n = int(np.prod([k for _, k in axes])) if axes else 1
        out[name] = {"dims": [d for d, _ in axes], "attributes": att, "data": np.frombuffer(raw, code[0].replace("b", "i1").replace("c", "S1"), n, begin).reshape([k for _, k in axes])}
    return {"attributes": glob, "variables": out}


def read_netcdf_grid(spark: SparkSession, path: str, variable: str = "lwe_thickness") -> DataFrame:
    """Grids (epoch, lat, lon, value) of classic netCDF files with 'days since' times."""

    def parse(p: str, raw: bytes) -> Iterator[dict]:
        v = parse_classic_netcdf(raw)["variables"]
        low = {k.lower(): k for k in v}
        lat, lon, time = (v[low[next(c for c in names if c in low)]] for names in (("lat", "latitude"), ("lon", "longitude"), ("time",)))
        y0 = pd.Timestamp(str(time["attributes"].get("units", "days since 2002-01-01")).split("since")[1].strip("\0 ")[:10])
        t = y0 + pd.to_timedelta(time["data"].astype(float), unit="D")
        epoch = t.year + (t.dayofyear - 1 + (t.hour / 24)) / np.where(t.is_leap_year, 366, 365)
        x = v[variable]
        g = np.transpose(x["data"], [x["dims"].index(d) for d in (time["dims"][0], lat["dims"][0], lon["dims"][0])])
        for k, e in enumerate(epoch):
            for i, a in enumerate(lat["data"]):
                for j, b in enumerate(lon["data"]):
                    yield {"epoch": float(e), "lat": float(a), "lon": float(b) % 360, "value": float(g[k, i, j])}

    return _parsed(spark, path, None, parse, "epoch double, lat double, lon double, value double")
