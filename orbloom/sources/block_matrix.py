"""Block-diagonal filter matrices in the published binary form, as a Spark data source.

The file starts with a byte-order mark, version, kind and counts; metadata, the ends of the blocks and the packed
blocks (column by column) follow.  The reader reads the head once, in the driver, and plans one partition for each
block, with the place of its numbers in the file; a task reads the columns that it needs and no more.  Filters on
m, cs, n_row and n_col reach the plan: blocks of other orders are not opened, and columns beyond the largest degree
are not read.

    spark.dataSource.register(BlockMatrixSource)
    spark.read.format("block_matrix").load(path).where("m <= 10 AND n_row <= 60 AND n_col <= 60")

Files are opened through Arrow's filesystems, by path or URI.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format: the mark (the letters BI, low byte first), known versions, sizes of names, texts.
MARK = 18754
VERSIONS = (2.1, 2.2, 2.3, 2.4, 2.5)
NAME, LINE = 24, 80
WITH_SECOND_SIDE = ("BDFULLV0", "BDFULLVN")
SCHEMA = "m int, cs int, n_row int, n_col int, w double"


def opened(path: str):
    """A file that can be read from any place, and counts nothing but what is asked for."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


@dataclass(frozen=True)
class Block(InputPartition):
    m: int
    cs: int
    first: int  # degree of the first row and column
    size: int
    at: int  # byte of its first number
    order: str  # of bytes
    keep: int | None = None  # largest degree that is asked for


def read_head(source) -> tuple[int, list[Block]]:
    """The largest degree and all blocks."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        raw = source.read_at(n, at)
        if len(raw) != n:
            raise ValueError(f"the head ends after {at + len(raw)} bytes")
        at += n
        return raw

    mark = take(2)
    order = next((e for e in "<>" if struct.unpack(f"{e}H", mark)[0] == MARK), None)
    if order is None:
        raise ValueError("no byte-order mark: not a block matrix file")

    def numbers(kind: str, n: int = 1) -> tuple:
        return struct.unpack(f"{order}{n}{kind}", take(n * struct.calcsize(f"{order}{kind}")))

    text = take(6).decode("ascii", "replace")
    try:
        version = float(text[2:].strip())
    except ValueError:
        version = None
    if version not in VERSIONS:
        raise ValueError(f"unknown version: {text!r}")
    kind = take(8).decode("ascii", "replace").strip()
    if not kind.startswith("BD"):
        raise ValueError(f"not a block-diagonal matrix: {kind!r}")
    take(LINE)
    n_ints, n_doubles, side, other = numbers("I", 4)
    packed, _ = numbers("I" if version < 2.4 else "Q", 2)
    vectors, notes = (0, 0) if version <= 2.1 else numbers("i", 2)
    (count,) = numbers("i")
    take(LINE * notes)
    names = [take(NAME).decode("ascii", "replace").strip() for _ in range(n_ints)]
    values = dict(zip(names, numbers("i" if version <= 2.4 else "q", n_ints))) if n_ints else {}
    lmax = next((v for k, v in values.items() if k.startswith("Lmax")), None)
    lmin = next((v for k, v in values.items() if k.startswith("Lmin")), 2)
    if lmax is None:
        raise ValueError("the head does not give the largest degree")
    at += n_doubles * (NAME + 8) + NAME * side
    ends = numbers("i", count)
    if kind in WITH_SECOND_SIDE and version > 2.2:
        at += NAME * other
    at += 8 * vectors * side
    blocks, before, used = [], 0, 0
    for k, end in enumerate(ends):
        m, cs, size = (k + 1) // 2, int(k > 0 and k % 2 == 0), end - before
        first = max(lmin, m)
        if size != lmax - first + 1:
            raise ValueError(f"block {k} has {size} rows, degrees {first} to {lmax} need {lmax - first + 1}")
        blocks.append(Block(m, cs, first, size, at + 8 * used, order))
        before, used = end, used + size * size
    if used != packed:
        raise ValueError(f"the blocks take {used} numbers, the file says {packed}")
    if source.size() < at + 8 * packed:
        raise ValueError("the packed numbers are cut short")
    return lmax, blocks


def read_block(source, b: Block) -> np.ndarray:
    """The leading part of a block up to the degree that is asked for: whole columns, from one place of the file."""
    k = b.size if b.keep is None else min(b.size, b.keep - b.first + 1)
    return np.frombuffer(source.read_at(8 * k * b.size, b.at), f"{b.order}f8").reshape(b.size, k, order="F")[:k]


class BlockMatrixReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.limits: dict[str, int] = {"n_row": int(options["nmax"]), "n_col": int(options["nmax"])} if options.get("nmax") else {}
        self.equal: dict[str, int] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds orders and degrees; a degree's bound is a hint for reading and is checked again by Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo) and name in ("m", "cs"):
                self.equal[name] = f.value
                continue
            if isinstance(f, (LessThanOrEqual, LessThan)) and name in ("m", "n_row", "n_col"):
                top = f.value - isinstance(f, LessThan)
                self.limits[name] = min(top, self.limits.get(name, top))
                if name == "m":
                    continue
            yield f

    def partitions(self) -> list[Block]:
        with opened(self.path) as source:
            _, blocks = read_head(source)
        most = max(self.limits[c] for c in ("n_row", "n_col")) if {"n_row", "n_col"} <= set(self.limits) else None
        out = []
        for b in blocks:
            if any(getattr(b, k) != v for k, v in self.equal.items()) or b.m > self.limits.get("m", b.m) or most is not None and b.first > most:
                continue
            out.append(Block(b.m, b.cs, b.first, b.size, b.at, b.order, most))
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as source:
            w = read_block(source, partition)
        k = len(w)
        row, col = np.divmod(np.arange(k * k), max(k, 1))
        m, cs = np.full(k * k, partition.m), np.full(k * k, partition.cs)
        yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (m, cs, row + partition.first, col + partition.first)] + [pa.array(w.astype(float).ravel())], names=["m", "cs", "n_row", "n_col", "w"])


class BlockMatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockMatrixReader:
        return BlockMatrixReader(self.options["path"], self.options)


def read_block_matrix(spark: SparkSession, path: str, nmax: int | None = None) -> DataFrame:
    """(m, cs, n_row, n_col, w) of one file; ``nmax`` keeps the leading part of every block, and only that is read."""
    spark.dataSource.register(BlockMatrixSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("block_matrix")
    return (r.option("nmax", nmax) if nmax is not None else r).load(path)
