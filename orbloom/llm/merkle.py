"""Merkle manifest of a dataset: hash trees per language under one root, built and checked by supersteps over vertices.

Every row is a leaf.  Leaves of a language, in the order of doc_id, are cut into runs of ``FANOUT``; a run's node is
the SHA-256 of its digests, and so on up to the language's subroot; subroots, in the order of their languages, make
the root the same way.

The trees live in RDDs of vertices keyed by (tree, place), and every level is a superstep:

* upward, each node sends its digest to its parent; messages of one parent are merged before the shuffle, a parent
  with all its children's digests is complete, hashes them and sends on.  A level is written to the shared folder, so
  a lost executor costs no more than the level at hand;
* downward, from the root, each parent sends its children the path above them: for every level the place in the run and
  the siblings' digests.  A parent sends one message for all its leaves.

A leaf folds its own digest, or that of a changed row, with the siblings of its path; the result is the root exactly if
the row is unchanged.

Places come from a range-partitioned sort: numbers within a partition, plus the counts of the partitions before.

Defined results: null fields count as ``-``; a null language is a tree of its own and comes first; a null doc_id comes
first in its language and is never changed by ``tampered``; rows of one doc_id are ordered by digest; repeated rows are
leaves each; an empty table gives an empty result; further columns of the input are not read; texts of any length are
hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbloom.llm._arrow import saved, tidy

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART_ROWS = 40_000  # vertices in a partition of a superstep, about
LEVEL = "tree bigint, place bigint, nodes bigint, digest string, children array<string>"


def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if f == "text" else docs[f]) for f in FIELDS]), 256)


def tampered(docs: DataFrame) -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the decimal doc_id, else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.translate(docs["text"].cast("string"), upper, upper.lower()))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (rank of the language), place, nodes (leaves of the tree), doc_id, digest and the digest after tampering (null: unchanged)."""
    spark = docs.sparkSession
    bent = tampered(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), leaf_digest(docs, docs["text"]).alias("digest"), F.when(bent.isNotNull(), leaf_digest(docs, bent)).alias("bent"))
    rows = saved(rows, "leaf-digests")
    # Equal rows may part anywhere, so a row that is repeated very often is no hot key of the sort.
    keys = [F.col(k).asc_nulls_first() for k in ("lang", "doc_id", "digest")]
    ordered = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("any")).sortWithinPartitions(*keys).drop("any")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lang, count = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            at = []
            for x in b.column(1).to_pylist():
                count = count + 1 if x == lang else 0
                lang = x
                at.append(count)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(at, pa.int64())], names=[*b.schema.names, "part", "at"])

    ordered = saved(ordered.mapInArrow(run, "doc_id bigint, lang string, digest string, bent string, part bigint, at bigint"), "ordered-leaves")
    counts = saved(ordered.groupBy("part", "lang").agg(F.count("*").alias("rows")), "leaf-counts")  # a row for each partition and language in it
    langs = counts.groupBy("lang").agg(F.sum("rows").alias("nodes")).orderBy(F.col("lang").asc_nulls_first())
    ranks = saved(spark.createDataFrame(langs.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1], r[0][1])), "of_lang string, tree bigint, nodes bigint"), "languages")
    before = F.coalesce(F.sum("rows").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).join(ranks, F.col("lang").eqNullSafe(F.col("of_lang"))).select(F.col("part").alias("of_part"), "of_lang", "before", "tree", "nodes")
    starts = saved(starts, "leaf-starts")
    placed = ordered.join(starts, (F.col("part") == F.col("of_part")) & F.col("lang").eqNullSafe(F.col("of_lang")))
    return placed.select("tree", (F.col("before") + F.col("at")).alias("place"), "nodes", "doc_id", "digest", "bent")


def _merged(a: dict, b: dict) -> dict:
    a.update(b)
    return a


def _complete(item: tuple) -> tuple:
    """The parent of a run, once all children's digests are there."""
    (tree, place), (nodes, got) = item
    if len(got) != min(FANOUT, nodes - FANOUT * place):
        raise ValueError(f"tree {tree}: {len(got)} digests for node {place}")
    children = [got[k] for k in range(len(got))]
    return tree, place, -(-nodes // FANOUT), hashed(children), children


def parts(vertices: int) -> int:
    return max(2, -(-vertices // PART_ROWS))


def ascend(nodes: DataFrame, widest: int, total: int) -> list[DataFrame]:
    """The levels above the given nodes (tree, place, nodes, digest), lowest first; trees of one node are done."""
    levels = []
    while widest > 1:
        live = nodes.where("nodes > 1").select("tree", "place", "nodes", "digest")
        sent = live.rdd.map(lambda r: ((r[0], r[1] // FANOUT), (r[2], {r[1] % FANOUT: r[3]})))
        total = -(-total // FANOUT)
        met = sent.reduceByKey(lambda a, b: (a[0], _merged(a[1], b[1])), parts(total))
        nodes = saved(live.sparkSession.createDataFrame(met.map(_complete), LEVEL, verifySchema=False), "tree-level")
        levels.append(nodes)
        widest = -(-widest // FANOUT)
    return levels


def step(place: int, children: list[str]) -> str:
    """What a child's path says of its own run: its place in it, and the siblings."""
    return f"{place}{''.join(children[:place] + children[place + 1:])}/"


def _families(level: DataFrame) -> RDD:
    return level.select("tree", "place", "children").rdd.map(lambda r: ((r[0], r[1]), r[2]))


def _children(item: tuple) -> list[tuple]:
    (tree, place), (children, (subroot, path)) = item
    return [((tree, FANOUT * place + k), (subroot, step(k, children) + path)) for k in range(len(children))]


def descend(levels: list[DataFrame], at: int, messages: RDD, size: int) -> RDD:
    """The messages that the nodes of level ``at`` send their children; ``messages`` has those that reached the level."""
    return _families(levels[at - 1]).join(messages, parts(size)).flatMap(_children)


def fold(digest: str, path: str) -> str:
    """The root that a digest and its path lead to."""
    for run in path.split("/")[:-1]:
        cut = 1 + 64 * int(run[0])
        digest = hashlib.sha256(f"{run[1:cut]}{digest}{run[cut:]}".encode()).hexdigest()
    return digest


def proof(path: str) -> str:
    return hashlib.sha256("".join(run[1:] for run in path.split("/")).encode()).hexdigest()


MANIFEST = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, keep_path: bool = False) -> DataFrame:
    """Every row's leaf, subroot, root, digest of its proof, and the root that it folds to after ``tampered``.

    With ``keep_path`` the path itself comes too: for each level the place in the run, the siblings' digests and a slash.
    """
    spark = docs.sparkSession
    schema = MANIFEST + (", path string" if keep_path else "")
    base = saved(leaves(docs), "leaf-vertices")
    trees = base.groupBy("tree").agg(F.first("nodes").alias("nodes"))
    widest, total, count = trees.agg(F.max("nodes"), F.sum("nodes"), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], schema)

    levels = ascend(base, widest, total)
    done = base.where("nodes = 1").select("tree", "digest", F.lit(0).alias("level"))
    for k, level in enumerate(levels, 1):
        done = done.unionByName(level.where("nodes = 1").select("tree", "digest", F.lit(k).alias("level")))
    subroots = saved(done, "subroots")
    above = ascend(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("nodes"), "digest"), count, count)
    root = (above[-1] if above else subroots).first()["digest"]

    # Down from the root to the subroots, then from each subroot, at its own level, to its leaves.
    messages = spark.sparkContext.parallelize([((0, 0), (root, ""))], 1)
    for at in range(len(above), 0, -1):
        messages = descend(above, at, messages, -(-count // FANOUT**at))
    starts = subroots.rdd.map(lambda r: (r[0], (r[2], r[1]))).join(messages.map(lambda m: (m[0][1], m[1][1])), parts(count))
    starts = starts.map(lambda s: (s[1][0][0], (s[0], 0), (s[1][0][1], s[1][1])))  # level, vertex, (subroot, path)

    def starting(level: int) -> RDD:
        return starts.filter(lambda s: s[0] == level).map(lambda s: s[1:])

    messages = spark.sparkContext.emptyRDD()
    for at in range(len(levels), 1, -1):
        messages = descend(levels, at, messages.union(starting(at)) if at < len(levels) else starting(at), -(-total // FANOUT**at))
    if levels:
        reached = messages.union(starting(1)) if len(levels) > 1 else starting(1)
        heads = _families(levels[0]).join(reached, parts(-(-total // FANOUT))).map(lambda m: ((*m[0], 1), m[1]))
    else:
        heads = spark.sparkContext.emptyRDD()
    heads = heads.union(starting(0).map(lambda s: ((*s[0], 0), (None, s[1]))))

    def own(r: tuple) -> tuple:
        tree, place, nodes, doc_id, digest, bent = r
        return ((tree, place // FANOUT, 1) if nodes > 1 else (tree, 0, 0)), (place % FANOUT, doc_id, digest, bent)

    def rows(group: tuple) -> Iterator[tuple]:
        members, above = group[1]
        for children, (subroot, path) in above:
            for place, doc_id, digest, bent in members:
                whole = path if children is None else step(place, children) + path
                folded = fold(bent or digest, whole)
                yield (doc_id, digest, subroot, root, proof(whole), folded, folded == root, *([whole] if keep_path else []))

    met = base.rdd.map(own).cogroup(heads, parts(total)).flatMap(rows)
    return spark.createDataFrame(met, schema, verifySchema=False)
