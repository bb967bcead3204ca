"""Shared helpers: Arrow columns as numpy views, word splitting, hashes, tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

# White space that ends a word, and the multipliers of the 64-bit hashes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
LONG_WORD = 512  # bytes beyond which a word is hashed by itself

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs; multiplications and shifts alternate, so no sum of terms can cancel as in a polynomial."""
    h = a * MIX1 + (b ^ (b >> np.uint64(29))) * MIX2
    h ^= h >> np.uint64(32)
    h *= BASE
    h ^= h >> np.uint64(29)
    return h


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes at a time."""
    n = ends - starts
    h = n.astype(np.uint64) * BASE
    if not len(h):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    live, at = np.flatnonzero(n <= LONG_WORD), 0
    while len(live):
        left = n[live] - at
        x = lanes[starts[live] + at] & masks[np.minimum(left, 8)]
        h[live] = joined(h[live], x)
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return mix(h)


def window_hashes(values: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all runs of each length, by doubling: two runs that overlap or touch make a longer one."""
    h, width, out = mix(values + BASE), 1, {}
    for length in sorted(set(lengths)):
        if len(values) < length:
            out[length] = np.zeros(0, np.uint64)
            continue
        while 2 * width <= length:
            h = joined(h[:-width], h[width:])
            width *= 2
        n = len(values) - length + 1
        out[length] = mix(joined(h[:n], h[length - width : length - width + n]) if width < length else h)
    return [out[length] for length in lengths]


def window_hash(values: np.ndarray, length: int) -> np.ndarray:
    return window_hashes(values, length)[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Runs of rows of about ``limit`` bytes at most; a longer row is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ and, by row, the index of its first word."""
    ink = ~IS_SPACE[data]
    at = np.zeros(len(data) + 1, bool)
    at[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | at[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | at[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of this session hold ``BATCH_BYTES`` at most, however long the texts are; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_private: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a private one only in local mode without that setting."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _private:
            _private.append("file://" + tempfile.mkdtemp(prefix="orbloom-"))
        d = _private[0]
    return d.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder and reads them back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    tidied(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_saved_at"] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote and that no later step reads, and lets the cleaner take their shuffle files."""
    for t in tables:
        if (path := t.__dict__.get("_saved_at")) in _written:
            _written.remove(path)
            _delete(t.sparkSession, path)
    if tables:
        tidied(tables[0].sparkSession)


def discard(spark: SparkSession) -> None:
    """Deletes all tables that ``saved`` wrote in this process; call it when the results have been stored."""
    while _written:
        _delete(spark, _written.pop())


def released() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(spark: SparkSession) -> None:
    """Lets go of what the driver holds of steps that are over: plans, broadcasts, collected rows, shuffle files."""
    gc.collect()
    released()
    spark.sparkContext._jvm.System.gc()


def tidy(run):
    """A function over Arrow batches that gives freed memory back to the system when its task ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return whole
