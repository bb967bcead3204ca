"""Time series of grids in classic netCDF files (versions 1, 2 and 5), as a Spark data source.

A file's head says where each record of a variable starts, so a partition is a range of epochs and a task reads the bytes
of its own epochs alone.  Filters on ``epoch`` reach the plan: epochs outside them are never read.  Packed values
(scale_factor, add_offset) are unpacked, fill and missing values are null.

    spark.dataSource.register(GridSeriesSource)
    spark.read.format("grid_series").load(path).where("epoch >= 2010 AND epoch < 2011")

The variable is the one given as option ``variable``, or the first of the usual names; its slowest dimension is time, in
``days since`` a date, and a layout or a unit that is not known is an error.  Files are opened through Arrow's
filesystems, by path or URI.
"""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from orbloom.sources.block_matrix import opened

# Fixed values of the format and the usual names of the variables.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
HEIGHT, LATITUDE, LONGITUDE, TIME = ("lwe_thickness", "lwe", "water_thickness", "ewh"), ("lat", "latitude"), ("lon", "longitude"), ("time", "t")
SCHEMA = "epoch double, lat double, lon double, value double"
EPOCHS = 8  # in a partition


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    kind: str
    begin: int
    stride: int  # bytes from one step of the slowest dimension to the next
    record: bool = False
    attributes: dict = field(default_factory=dict)


class _Short(Exception):
    pass


def parse_head(raw: bytes) -> dict[str, Variable]:
    """All variables of a file from its first bytes; _Short if more of them are needed."""
    if raw[:3] != b"CDF" or len(raw) < 4 or raw[3] not in (1, 2, 5):
        raise ValueError("not a classic netCDF file")
    version, at = raw[3], 4

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise _Short
        at += n
        return raw[at - n : at]

    def number(wide: bool = version == 5) -> int:
        return struct.unpack(">Q" if wide else ">I", take(8 if wide else 4))[0]

    def text() -> str:
        n = number()
        return take(-(-n // 4) * 4)[:n].decode("utf-8", "replace")

    def attributes() -> dict:
        number(False)
        out = {}
        for _ in range(number()):
            name, kind, n = text(), KINDS[number(False)], number()
            size = np.dtype(kind).itemsize * n
            data = take(-(-size // 4) * 4)[:size]
            out[name] = data.decode("latin-1").rstrip("\0") if kind == "S1" else np.frombuffer(data, kind)
        return out

    records = number()
    number(False)
    dims = [(text(), number()) for _ in range(number())]
    attributes()
    number(False)
    out, sizes = {}, []
    for _ in range(number()):
        name = text()
        axes = [dims[number()] for _ in range(number())]
        att, kind = attributes(), KINDS[number(False)]
        number()
        begin = number(version != 1)
        record = bool(axes) and axes[0][1] == 0
        shape = [records if k == 0 else k for _, k in axes]
        stride = int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(kind).itemsize
        out[name] = Variable([d for d, _ in axes], shape, kind, begin, stride, record, att)
        if record:
            sizes.append(stride)
    # Records of all variables follow each other, each padded to four bytes unless it is the only one.
    whole = sum(-(-s // 4) * 4 for s in sizes) if len(sizes) > 1 else sum(sizes)
    for v in out.values():
        if v.record:
            v.stride = whole
    return out


def read_head(source) -> dict[str, Variable]:
    size, n = source.size(), 1 << 14
    while True:
        try:
            return parse_head(source.read_at(min(n, size), 0))
        except _Short:
            if n >= size:
                raise ValueError("the head is cut short") from None
            n *= 4


def read_steps(source, v: Variable, first: int, count: int) -> np.ndarray:
    """``count`` steps of the slowest dimension from ``first`` on, unpacked; missing ones are NaN."""
    shape = v.shape[1:]
    size = int(np.prod(shape, dtype=np.int64)) * np.dtype(v.kind).itemsize
    if v.stride == size:
        raw = source.read_at(size * count, v.begin + first * size)
    else:
        raw = b"".join(source.read_at(size, v.begin + (first + k) * v.stride) for k in range(count))
    if len(raw) != size * count:
        raise ValueError("the file ends before its last record")
    x = np.frombuffer(raw, v.kind).reshape([count, *shape])
    gone = np.zeros(x.shape, bool)
    for name in ("_FillValue", "missing_value"):
        for value in np.atleast_1d(v.attributes.get(name, [])):
            gone |= x == value
    out = x.astype(float) * float(np.atleast_1d(v.attributes.get("scale_factor", 1.0))[0]) + float(np.atleast_1d(v.attributes.get("add_offset", 0.0))[0])
    out[gone] = np.nan
    return out


def years(days: np.ndarray, units: str) -> np.ndarray:
    m = re.match(r"days\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})", units or "")
    if not m:
        raise ValueError(f"unknown time units: {units!r}")
    start = datetime.datetime(*(int(k) for k in m.groups()))
    out = []
    for d in days.tolist():
        t = start + datetime.timedelta(days=d)
        a, b = datetime.datetime(t.year, 1, 1), datetime.datetime(t.year + 1, 1, 1)
        out.append(t.year + (t - a) / (b - a))
    return np.array(out)


@dataclass
class Layout:
    height: Variable
    lat: np.ndarray
    lon: np.ndarray
    epochs: np.ndarray
    swap: bool  # longitude stands before latitude


def layout(source, name: str | None = None) -> Layout:
    """The grid and its places and epochs: three small reads besides the head."""
    variables = read_head(source)

    def pick(names: tuple[str, ...]) -> str:
        got = next((n for n in names if n in variables), None)
        if got is None:
            raise ValueError(f"none of {', '.join(names)} among {', '.join(variables)}")
        return got

    h, la, lo, t = pick((name,) if name else HEIGHT), pick(LATITUDE), pick(LONGITUDE), pick(TIME)
    v = variables[h]
    dims = [d.lower() for d in v.dims]
    kinds = ["t" if d in TIME or d == variables[t].dims[0].lower() else "lat" if d in LATITUDE else "lon" if d in LONGITUDE else "?" for d in dims]
    if kinds not in (["t", "lat", "lon"], ["t", "lon", "lat"]):
        raise ValueError(f"{h} has dimensions {', '.join(v.dims)}: time must be the slowest, before latitude and longitude")
    lat, lon = (read_steps(source, variables[k], 0, variables[k].shape[0]) for k in (la, lo))
    days = read_steps(source, variables[t], 0, variables[t].shape[0])
    return Layout(v, lat, np.mod(lon, 360), years(days, variables[t].attributes.get("units")), kinds[1] == "lon")


@dataclass(frozen=True)
class Epochs(InputPartition):
    first: int
    count: int


class GridSeriesReader(DataSourceReader):
    def __init__(self, path: str, variable: str | None):
        self.path, self.variable, self.low, self.high = path, variable, -np.inf, np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the epoch set which records are read; Spark checks them again on the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("epoch",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Epochs]:
        with opened(self.path) as source:
            wanted = [int(k) for k in np.flatnonzero((lambda e: (e >= self.low) & (e <= self.high))(layout(source, self.variable).epochs))]
        out: list[Epochs] = []
        for k in wanted:
            if out and out[-1].first + out[-1].count == k and out[-1].count < EPOCHS:
                out[-1] = Epochs(out[-1].first, out[-1].count + 1)
            else:
                out.append(Epochs(k, 1))
        return out

    def read(self, partition: Epochs) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as source:
            g = layout(source, self.variable)
            for k in range(partition.first, partition.first + partition.count):
                x = read_steps(source, g.height, k, 1)[0]
                x = x.T if g.swap else x
                lat, lon = np.repeat(g.lat, len(g.lon)), np.tile(g.lon, len(g.lat))
                value = pa.array(x.ravel(), mask=np.isnan(x.ravel()))
                yield pa.record_batch([pa.array(np.full(lat.size, g.epochs[k])), pa.array(lat), pa.array(lon), value], names=["epoch", "lat", "lon", "value"])


class GridSeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridSeriesReader:
        return GridSeriesReader(self.options["path"], self.options.get("variable"))


def read_grid_series(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """(epoch, lat, lon, value) of one file; epochs that a filter excludes are not read."""
    spark.dataSource.register(GridSeriesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("grid_series")
    return (r.option("variable", variable) if variable else r).load(path)
