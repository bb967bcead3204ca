"""Where windows of fixed length occur more than once in a corpus, exactly and in a few linear passes.

The units are words or bytes.  Every window of ``length`` units owns one anchor: of the ``width``-unit strings in
it the one with the smallest hash (the leftmost, if several).  Equal windows own equal anchors at equal places, so a
window can be repeated only if its anchor's fingerprint occurs twice.  About one anchor in ``(length - width) / 2``
units leaves a document, not one row per window:

1. a scan emits the anchors, with a hash of all units that their windows cover;
2. one aggregate finds fingerprints that occur twice;
3. one text of each different cover, with its number, goes to the others of its fingerprint, in shards of bounded
   size, and an exact kernel says which of its windows occur twice.

Anchors only say which stretches meet; every window of every stretch is decided by the kernel.  A fingerprint with
very many different covers does not go to one shard: its covers are taken as documents again, with anchors half as
far from the window's length, so they part by what stands around the old anchor.  With anchors as long as the
window each cover is one window and no fingerprint has two different ones, so this ends.

Hashes are non-linear (see ``_arrow.joined``); two covers count as one if their fingerprints and their hashes, 128
bits, agree.  Every count is over all documents; windows are judged on the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.llm._arrow import MIX1, bounded_batches, dropped, joined, mix, released, saved, slices, tidy, utf8, window_hashes, word_hash, words

CHUNK = 1 << 18  # units of a longer document that are in memory at once
MANY_COVERS = 2000  # different covers of one fingerprint, beyond which they get longer anchors
SHARD_COVERS = 1000  # covers in a shard, on average


@dataclass(frozen=True)
class Spec:
    length: int
    width: int
    by_word: bool
    kernel: Callable[[list[bytes], np.ndarray, np.ndarray, int], list[np.ndarray]]

    def wider(self) -> Spec:
        return Spec(self.length, self.length - (self.length - self.width) // 2 if self.length - self.width > 1 else self.length, self.by_word, self.kernel)


def unit_values(data: np.ndarray, offsets: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """64-bit values of the units, unit offsets of the rows, and byte starts and ends of words."""
    if not by_word:
        return data.astype(np.uint64), offsets, None, None
    starts, ends, rows = words(data, offsets)
    return word_hash(data, starts, ends), rows, starts, ends


def sliding_min(k: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while 2 * width <= span:
        k = np.minimum(k[:-width], k[width:])
        width *= 2
    return np.minimum(k[: len(k) - (span - width)], k[span - width :]) if width < span else k


def window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """All places where a window begins, row by row."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    return np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


def anchors(values: np.ndarray, offsets: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Row, fingerprint, cover hash, first and last window start (within the row) of every anchor."""
    p = window_starts(offsets, length)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z.view(np.uint64), z, z
    g, whole = window_hashes(values, width, length)
    i = np.arange(len(g))
    low = np.uint64((1 << int(len(values)).bit_length()) - 1)
    owner = (sliding_min((g & ~low) | i.astype(np.uint64), length - width + 1)[p] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (p[1:] != p[:-1] + 1)]))
    p0, p1, a = p[first], p[np.concatenate([first[1:] - 1, [len(p) - 1]])], owner[first]
    row = np.searchsorted(offsets, p0, "right") - 1
    # The first and the last window have all units of the cover, for they overlap or touch.
    cover = mix(joined(whole[p0], whole[p1]) ^ ((p1 - p0) * length + a - p0 + 1).astype(np.uint64) * MIX1)
    return row, g[a], cover, p0 - offsets[row], p1 - offsets[row]


def key_columns(docs: DataFrame) -> tuple:
    """The key (a, b) that tells rows of one doc_id and different texts apart, and the text (null: empty)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 62))), F.xxhash64(text), text


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a, b and text of every row."""
    a, b, text = key_columns(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), text.alias("text"))


def _anchor_rows(items: DataFrame, spec: Spec) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(3))
            a, b, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for lo, hi in slices(off, CHUNK):
                part = data[off[lo] : off[hi]]
                for v, units, shift in _chunks(part, off[lo : hi + 1] - off[lo], spec):
                    row, fp, cover, p0, p1 = anchors(v, units, spec.length, spec.width)
                    if len(row):
                        row = lo + row
                        yield pa.record_batch(
                            [pa.array(fp.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(a[row]), pa.array(b[row]), pa.array(n[row]), pa.array((p0 + shift).astype(np.int32)), pa.array((p1 + shift).astype(np.int32))],
                            names=["fp", "cover", "a", "b", "n", "p0", "p1"],
                        )

    return items.select("a", "b", "n", "text").mapInArrow(run, "fp bigint, cover bigint, a bigint, b bigint, n bigint, p0 int, p1 int")


def _chunks(data: np.ndarray, off: np.ndarray, spec: Spec):
    """Units of some rows; a single very long row comes in parts that overlap by a window less one unit."""
    values, units, _, _ = unit_values(data, off, spec.by_word)
    if len(off) > 2 or len(values) <= CHUNK:
        yield values, units, 0
        return
    for lo in range(0, len(values) - spec.length + 1, CHUNK):
        part = values[lo : lo + CHUNK + spec.length - 1]
        yield part, np.array([0, len(part)]), lo


def _covers(items: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """The text that the wanted anchors' windows cover, as items of their own: a is the fingerprint, b the cover."""
    lists = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("p0", "p1", "fp", "cover", "n", "many")).alias("x"))
    # Of equal rows one is read; tasks merge theirs before the shuffle, so a row that stands very often is no hot key.
    single = items.groupBy("a", "b").agg(F.first("text").alias("text"))
    pairs = single.join(lists, ["a", "b"]).select("text", "x")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            lst = batch.column(1)
            flat, lo_off = lst.flatten(), lst.offsets.to_numpy() - lst.offsets[0].as_py()
            p0, p1, fp, cover, n, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            for r in range(batch.num_rows):
                lo, hi = int(lo_off[r]), int(lo_off[r + 1])
                part = data[off[r] : off[r + 1]]
                first, last = p0[lo:hi], p1[lo:hi] + spec.length - 1
                if spec.by_word:
                    starts, ends, _ = words(part, np.array([0, len(part)]))
                    first, last = starts[first], ends[last]
                else:
                    last = last + 1
                raw = part.tobytes()
                yield pa.record_batch(
                    [pa.array(fp[lo:hi]), pa.array(cover[lo:hi]), pa.array(n[lo:hi]), pa.array(many[lo:hi]), pa.array((p1[lo:hi] - p0[lo:hi] + 1).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(first.tolist(), last.tolist())], pa.binary())],
                    names=["a", "b", "n", "many", "windows", "text"],
                )

    return pairs.mapInArrow(run, "a bigint, b bigint, n bigint, many boolean, windows int, text binary")


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _exact(covers: DataFrame, spec: Spec, shards: int) -> DataFrame:
    """Runs of repeated windows (by window number in the cover), shard by shard."""

    def run(table: pa.Table) -> pa.Table:
        masks = spec.kernel(table["text"].to_pylist(), table["n"].to_numpy(), table["windows"].to_numpy(), spec.length)
        out: list[tuple] = [(a, b, lo, hi) for a, b, m in zip(table["a"].to_pylist(), table["b"].to_pylist(), masks) for lo, hi in _runs(m)]
        cols = list(zip(*out)) if out else [[], [], [], []]
        del masks, out
        released()
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "lo", "hi"])

    return covers.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(run, "a bigint, b bigint, lo int, hi int")


def _decided(items: DataFrame, spec: Spec) -> tuple[DataFrame, list[DataFrame]]:
    """a, b, lo, hi: ranges of window starts that are repeated, of items with a key (a, b), a number n and a text.

    Also the written tables that the ranges are read from.
    """
    found = saved(_anchor_rows(items, spec), "anchors")
    twice = found.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1")
    # Written first, so that the join shuffles both sides anew and can split a hot fingerprint over tasks.
    twice = saved(twice.select("fp"), "repeated-fingerprints")
    hits = saved(found.join(twice, "fp"), "repeated-anchors")
    dropped(found)
    each = hits.groupBy("fp", "cover").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "p0", "p1")).alias("at"))
    each = saved(each.select("fp", "cover", "n", "at.*"), "different-covers")
    many = each.groupBy("fp").agg((F.count("*") > MANY_COVERS).alias("many")) if spec.width < spec.length else twice.withColumn("many", F.lit(False))
    wanted = saved(each.join(many, "fp").select("fp", "cover", "n", "many", "a", "b", "p0", "p1"), "covers-wanted")
    dropped(each, twice)
    covers = saved(_covers(items, wanted, spec), "covers")
    sums = wanted.groupBy("many").count().collect()  # two rows
    dropped(wanted)
    counts = {r["many"]: r["count"] for r in sums}
    shards = max(8, -(-counts.get(False, 0) // SHARD_COVERS))
    checked, inner = _exact(covers.where(~F.col("many")), spec, shards), []
    if counts.get(True):
        longer, inner = _decided(covers.where("many").select("a", "b", "n", "text"), spec.wider())
        checked = checked.unionByName(longer)
    checked = saved(checked, "repeated-windows")
    dropped(covers, *inner)
    return hits.join(checked.withColumnsRenamed({"a": "fp", "b": "cover"}), ["fp", "cover"]).select("a", "b", (F.col("p0") + F.col("lo")).alias("lo"), (F.col("p0") + F.col("hi")).alias("hi")), [hits, checked]


def repeated(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and by (a, b) the ranges of window starts that are repeated."""
    bounded_batches(docs.sparkSession)
    rows = keyed(docs)
    ranges, tables = _decided(rows.withColumn("n", F.lit(1).cast("long")), spec)
    ranges = saved(ranges.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "repeated-ranges")
    dropped(*tables)
    return rows, ranges


def covered(ranges: pa.Scalar, n: int, length: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    mark = np.zeros(n + 1, np.int32)
    if ranges is not None and ranges.is_valid:
        v = ranges.values
        np.add.at(mark, v.field(0).to_numpy(zero_copy_only=False), 1)
        np.add.at(mark, v.field(1).to_numpy(zero_copy_only=False) + length, -1)
    return np.cumsum(mark[:-1]) > 0
