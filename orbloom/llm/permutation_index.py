"""Approximate nearest neighbours with a permutation index.

Vectors are represented by the order of their ``PREFIX`` nearest pivots.  A vector is posted in the inverted files of
these pivots only, in the order of the pivot's place.  A query reads the files of its own nearest pivots, and of
these only the postings at most ``REACH`` places from its own; each posting lowers the footrule distance of the two
orders, in which a pivot that one of them lacks counts as ``PREFIX`` places away.  The ``SHARE`` of a shard that is
nearest by footrule is reranked with exact inner products.

Nearness is the largest inner product, so all vectors are lifted to one length first: a coordinate
sqrt(M**2 - |x|**2) is added, M the largest norm, and queries get a zero there.

Every vector is indexed; pivots are a sample of ``PIVOTS`` vectors (the smallest hashes of their ids).  Shards have
a bounded number of vectors; all queries, in blocks, meet each shard.

Defined results: vectors that are null, zero or hold null or non-finite components, or whose length differs from
the most common one, take no part; a query's own row is no candidate; equal scores go to the smaller vec_id; with
fewer candidates than asked for all come back; rows without a vec_id take no part; an empty table gives an empty
result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.llm._arrow import saved, tidy

PIVOTS = 256
PREFIX = 64
REACH = 48
SHARE = 0.25  # of a shard's vectors that are reranked
SHARD = 8192
QUERY_BLOCK = 64


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v"))
    ok = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(ok)
    widths = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (widths["n"] if widths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


class Shard:
    """Inverted files of one shard, one behind the other: rows and places, sorted by pivot, place and row."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, top: float):
        o = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots, self.top = ids[o], x[o], pivots, top
        self.prefix = min(PREFIX, len(pivots))
        lift = np.sqrt(np.maximum(top * top - (self.x * self.x).sum(axis=1), 0))
        order = self._order(np.column_stack([self.x, lift]))
        slot = (order * self.prefix + np.arange(self.prefix)).ravel()  # (pivot, place)
        by_slot = np.argsort(slot, kind="stable")
        self.rows = (by_slot // self.prefix).astype(np.int32)
        self.places = (by_slot % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(slot[by_slot], np.arange(len(pivots) * self.prefix + 1))

    def _order(self, lifted: np.ndarray) -> np.ndarray:
        return np.argsort(-(lifted @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]

    def near(self, order: np.ndarray, take: int) -> tuple[np.ndarray, int]:
        """The ``take`` rows nearest to an order by footrule, ties to smaller ids, and how many postings were read."""
        gain, read = np.zeros(len(self.ids), np.int32), 0
        for place, pivot in enumerate(order.tolist()):
            lo = self.starts[pivot * self.prefix + max(0, place - REACH)]
            hi = self.starts[pivot * self.prefix + min(self.prefix, place + REACH + 1)]
            gain[self.rows[lo:hi]] += self.prefix - np.abs(self.places[lo:hi] - place)
            read += int(hi - lo)
        if take >= len(gain):
            return np.arange(len(gain)), read
        edge = np.partition(gain, len(gain) - take)[len(gain) - take]
        above = np.flatnonzero(gain > edge)
        return np.concatenate([above, np.flatnonzero(gain == edge)[: take - len(above)]]), read

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and scores of the k best candidates of each query in this shard."""
        n = len(self.ids)
        norms = np.sqrt((q * q).sum(axis=1, keepdims=True))
        orders = self._order(np.column_stack([q / norms * self.top, np.zeros(len(q))]))
        take = min(n, max(int(np.ceil(SHARE * n)), k + 1))
        out_q, out_v, out_s = [], [], []
        for i in range(len(q)):
            near, _ = self.near(orders[i], take)
            near = near[self.ids[near] != ids[i]]
            s = self.x[near] @ q[i]
            if len(near) > k:
                best = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                near, s = near[best], s[best]
            o = np.lexsort((self.ids[near], -s))[:k]
            out_q.append(np.full(len(o), ids[i]))
            out_v.append(self.ids[near][o])
            out_s.append(s[o])
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_v, out_s))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found. Both inputs come from ``usable``."""
    spark = vectors.sparkSession
    vectors, queries = saved(vectors, "vectors"), saved(queries, "queries")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    shards = max(1, -(-size["n"] // SHARD))
    top = float(np.sqrt(size["top"] or 0.0))
    sample = np.array([r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()])  # PIVOTS rows
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    pivots = np.column_stack([sample, np.sqrt(np.maximum(top * top - (sample * sample).sum(axis=1), 0))])
    shared = spark.sparkContext.broadcast((pivots, top))

    # A shard's vectors come first in its partition, then the queries: they stream past the finished index.
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    index = vectors.select(shard_of.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    rows = index.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, m = shared.value
        shard, parts, built = None, [], None
        for b in batches:
            no, kind, ids, x = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3))) if b.num_rows else ([], [], [], [])
            edges = np.flatnonzero(np.diff(no.astype(np.int64) * 2 + kind)) + 1 if b.num_rows else []
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if lo == hi:
                    continue
                if no[lo] != shard:
                    shard, parts, built = no[lo], [], None
                if kind[lo] == 0:
                    parts.append((ids[lo:hi], x[lo:hi]))
                    continue
                if not parts:
                    continue
                built = built or Shard(np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts]), piv, m)
                for at in range(lo, hi, QUERY_BLOCK):
                    q, v, s = built.search(ids[at : min(hi, at + QUERY_BLOCK)], x[at : min(hi, at + QUERY_BLOCK)], k)
                    yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
