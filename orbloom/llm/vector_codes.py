"""Vector code compression: product codes in integers, each found by a float32 screen that cannot lose the best entry.

Components become integers floor(1024 * x); a vector is cut into ``PARTS`` consecutive parts, each coded by the index
of its nearest codebook entry (squared Euclidean distance, ties to the lower index).  An assignment takes two steps:

* one float32 matrix product gives every distance, with an interval around it that bounds the rounding of the
  conversion, the product and the sum, in whatever order the product is summed;
* entries whose interval reaches below the smallest upper end are measured again in int64, and the smallest of these
  distances, at the lowest index, wins.  All other entries are further away, whatever the rounding was.

Codebooks start at the parts of the ``ENTRIES`` smallest ids and are replaced by floored means for a stated number of
rounds; a round is one pass over the vectors and one aggregate of sums, of which PARTS * ENTRIES rows reach the
driver.

Defined results: rows whose vector is null or empty, or holds a null or non-finite component, or has another length
than most rows (the smaller, if tied) take no part; components that would overflow a squared distance count as
the largest that does not (2**27 for 64 components); a length that PARTS does not divide gives its first parts one
component more; null ids come last among the smallest ids, equal ids are ordered by vector; fewer vectors than
ENTRIES give a shorter codebook; repeated rows are coded each; an empty table gives an empty result; further columns
of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbloom.llm._arrow import saved, tidy

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 4096  # vectors that are screened at once
UNIT = 2.0**-24  # rounding of float32
LONGEST = 2**63 - 1


def largest(dims: int) -> int:
    """The largest component for which the squared distance of two vectors stays below 2**62."""
    return 1 << ((62 - max(dims - 1, 1).bit_length()) // 2 - 1)


def cuts(dims: int, parts: int = PARTS) -> list[tuple[int, int]]:
    size = [dims // parts + (k < dims % parts) for k in range(parts)]
    ends = np.cumsum(size).tolist()
    return list(zip([0, *ends[:-1]], ends))


@dataclass
class Codebook:
    """Entries [K, L] of one part in int64, and what the screen needs of them."""

    entries: np.ndarray

    def __post_init__(self):
        self.single = self.entries.astype(np.float32).T.copy()
        self.square = (self.entries * self.entries).sum(axis=1).astype(np.float64)
        self.norm = np.sqrt(self.square) * (1 + 2.0**-50)


def screen(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Distances less |x|**2 of each row of x to each entry, from a float32 product, and a bound of their error.

    A product of n float32 terms, summed in any order, is off by less than g(n) * sum |x_i c_i| with
    g(n) = n u / (1 - n u); converting both factors adds two roundings.  The sum is at most |x| |c|.  The rest is
    float64: a few roundings of u**2 each on terms no larger than |c|**2 + 2 |x| |c|.
    """
    n = x.shape[1] + 2
    g = n * UNIT / (1 - n * UNIT)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2.0**-48)
    both = norm[:, None] * book.norm[None, :]
    dot = (x.astype(np.float32) @ book.single).astype(np.float64)
    return book.square[None, :] - 2 * dot, 2 * g * both * (1 + 2.0**-40) + 2.0**-48 * (book.square[None, :] + 2 * both)


def assign(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry and exact squared distance of each row; how many entries were measured in int64."""
    which, error, measured = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        near, slack = screen(part, book)
        best = (near + slack).min(axis=1)
        rows, entries = np.nonzero(near - slack <= best[:, None])
        gap = part[rows] - book.entries[entries]
        exact = (gap * gap).sum(axis=1)
        first = np.searchsorted(rows, np.arange(len(part)))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[rows])
        lead = hit[np.concatenate([[True], rows[hit][1:] != rows[hit][:-1]])]  # the lowest index of each row
        which[lo : lo + BLOCK], error[lo : lo + BLOCK] = entries[lead], least
        measured += len(rows)
    return which, error, measured


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """id, label and integer components q of the rows that take part, and how many components each has."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors[column].cast("array<double>").alias("v"))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    widths = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = widths["n"] if widths else 0
    top = float(largest(dims))
    held = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * SCALE, F.lit(top)), F.lit(-top))), F.lit(int(top))), F.lit(-int(top))).cast("long"))
    return v.where(F.size("v") == dims).select("vec_id", "label", held.alias("q")), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _sums(kept: DataFrame, books: list[Codebook], dims: int) -> list:
    """For every entry that a part chose: slot (part * ENTRIES + index), count and componentwise sums."""
    shared = kept.sparkSession.sparkContext.broadcast([b.entries for b in books])
    entries = len(books[0].entries)
    widest = max(b - a for a, b in cuts(dims, len(books)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in shared.value]
        total = np.zeros((len(own) * entries, widest + 1), np.int64)
        for batch in batches:
            q = _matrix(batch.column(0), dims)
            for p, (a, b) in enumerate(cuts(dims, len(own))):
                which, _, _ = assign(q[:, a:b], own[p])
                order = np.argsort(which, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(which[order]) > 0])) if len(order) else order
                slots = p * entries + which[order][at]
                total[slots, 1 : b - a + 1] += np.add.reduceat(q[order, a:b], at, axis=0) if len(at) else 0
                total[slots, 0] += np.diff(np.append(at, len(order)))
        used = np.flatnonzero(total[:, 0])
        yield pa.record_batch([pa.array(used.astype(np.int32)), *(pa.array(total[used, k]) for k in range(widest + 1))], names=["slot", "n", *(f"s{k}" for k in range(widest))])

    names = [f"s{k}" for k in range(widest)]
    each = kept.select("q").mapInArrow(run, ", ".join(["slot int", "n bigint", *(f"{n} bigint" for n in names)]))
    out = each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names]).collect()  # PARTS * ENTRIES rows
    shared.unpersist()
    return [(r["slot"], int(r["n"]), [int(r[n]) for n in names]) for r in out]


def codebooks(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks of all parts after the rounds."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()  # ENTRIES rows
    start = np.array([r.q for r in first], np.int64).reshape(len(first), dims)
    books = [Codebook(start[:, a:b]) for a, b in cuts(dims, parts)]
    for _ in range(rounds if len(first) else 0):
        new = [b.entries.copy() for b in books]
        for slot, n, sums in _sums(kept, books, dims):
            p, k = divmod(slot, len(first))
            new[p][k] = [s // n for s in sums[: new[p].shape[1]]]  # Python's division goes down
        books = [Codebook(e) for e in new]
    return books


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """vec_id, label, code (bytes, one per part) and error of every vector that takes part, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    kept, dims = integer_vectors(vectors)
    kept = saved(kept, "integer-vectors")
    books = codebooks(kept, dims, parts, entries, rounds)
    shared = kept.sparkSession.sparkContext.broadcast([b.entries for b in books])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(2), dims)
            code, error = np.zeros((len(q), len(own)), np.uint8), np.zeros(len(q), np.int64)
            for p, (a, b) in enumerate(cuts(dims, len(own))):
                code[:, p], e, _ = assign(q[:, a:b], own[p])
                error += e
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id bigint, label {label}, code binary, error bigint"), books


def decompress(codes: DataFrame, books: list[Codebook]) -> DataFrame:
    """The codes with the vectors that they stand for (column ``vector``)."""
    shared = codes.sparkSession.sparkContext.broadcast([b.entries for b in books])
    at = codes.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(batch.num_rows, len(shared.value))
            v = np.hstack([e[c[:, p]] for p, e in enumerate(shared.value)]) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error (errors summed over equal labels, nulls together) and the codebooks' digest."""
    codes, books = compress(vectors)
    codes = saved(codes, "vector-codes")
    # Sums meet before the shuffle, one row for each task and label; they come back by an equi-join with null as a key.
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
