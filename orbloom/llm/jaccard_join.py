"""N-gram Jaccard join with token-combination prefixes, up to connected components.

A document's set holds the 64-bit hashes of its distinct word shingles.  Documents with equal sets are one node.

* Prefixes are extended first: of its tokens, in the order of their hashes, a node keeps as many as make sure that
  two nodes that link share not one token of them but ``depth`` (about half as many as a plain prefix has).
* All extended prefixes are counted, so how many nodes have each of their tokens is known exactly.  A node drops the
  tokens that no other node has and, since it must share ``depth`` of them, its ``depth - 1`` most frequent ones.
  What is left is the index: tokens by themselves where they are rare, two-token combinations where they are frequent
  (for which one of the dropped tokens comes back).  Sets of more than ``COMBINED`` tokens would have too many
  combinations and index their frequent tokens singly; sets near the limit do both.
* Within a posting list every node meets the list's hub first (linear in the list).  The hub of a list of more than
  ``FREQUENT`` nodes is the one nearest to the majority of its near copies' bitmaps, so that they link to it and not to
  each other; each node votes once, for all lists it is in.  Then only nodes of different components meet, if their sizes and places in the prefix still
  allow a link.  Parity bitmaps, which bound the symmetric difference from below, and at last the whole sets decide.

Defined results: a null text or one without words has an empty set, links with nothing and is its own component;
fewer words than a shingle are one shingle; equal texts link; a component's id is its smallest doc_id that is not
null; rows without a doc_id that link with no other have a null component; repeated rows stay repeated; an empty
table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbloom.llm._arrow import bounded_batches, MIX1, MIX2, dropped, joined, lower_ascii, mix, saved, slices, tidy, utf8, word_hash, words

FREQUENT = 64  # nodes with a token beyond which it is frequent
COMBINED = 200  # sets up to this size index two-token combinations of frequent tokens
DEPTH = 8  # tokens that nodes must share, if their plain prefixes are short
BITMAP = 1024  # bits of a set's parity bitmap, at least
FOLD = 16  # 64-bit numbers of a bitmap's fold
BLOOM_BITS = 1 << 25
PART = 512  # voters whose bits are counted together


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, with repeats, and the row of each."""
    data = lower_ascii(data)
    starts, ends, rows = words(data, offsets)
    w = word_hash(data, starts, ends)
    count = np.diff(rows)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(k)), k)
    begin = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(len(row))
    size = np.minimum(n, count)[row]
    h = size.astype(np.uint64)
    for i in range(n):
        more = np.flatnonzero(size > i) if (size <= i).any() else slice(None)
        h[more] = joined(h[more], w[begin[more] + i])
    return mix(h), row


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row after row and sorted within a row, and their row offsets."""
    h, row = shingles(data, offsets, n)
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def depth(n: int, percent: int) -> int:
    """How many tokens two nodes share in their extended prefixes, if the smaller has n tokens; never falls with n."""
    return min(-(-n * percent // 100), max(DEPTH, prefix_size(n, percent) // 2))


def extended_prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set, of which a linked set shares ``depth``; the tokens are in the order of their hashes."""
    n = len(tokens)
    return tokens[: prefix_size(n, percent) - 1 + depth(n, percent)]


def index_keys(keys: np.ndarray, counts: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a set of n tokens, from its extended prefix, the places of their (first) tokens and what is before.

    ``counts`` says how many nodes have each token of the prefix in theirs.  The last two results are, for each key, the
    set's token before its first one and, for combinations, the one before its second, if it is not the first (0: none).
    Two sets that agree in one of them share an earlier key.
    """
    shared = depth(-(-n * percent // 100), percent)  # with the smallest set that can link
    o = np.lexsort((keys, counts))
    o = o[: len(keys) - shared + min(shared, 2)]
    single, c = o[: len(keys) - shared + 1], counts[o]
    rare = int(np.searchsorted(c, FREQUENT, "right"))
    singles = single if 100 * n >= percent * COMBINED or shared < 2 else single[:rare]
    singles = singles[counts[singles] > 1]
    out, place = keys[singles], singles
    first = np.concatenate([np.zeros(min(1, len(out)), out.dtype), out[:-1]])
    second = np.zeros(len(out), out.dtype)
    if percent * n <= 100 * COMBINED and rare < len(o) and shared >= 2:
        f = o[rare:]
        i, j = np.triu_indices(len(f), 1)
        out = np.concatenate([out, mix(joined(np.minimum(keys[f[i]], keys[f[j]]), np.maximum(keys[f[i]], keys[f[j]])) ^ MIX1)])
        place = np.concatenate([place, np.minimum(f[i], f[j])])
        none = np.uint64(0)
        first = np.concatenate([first, np.where(i > 0, keys[f[i - 1]], none)])
        second = np.concatenate([second, np.where(j > i + 1, keys[f[j - 1]], none)])
    return out, place, first, second


def _text(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))


def set_ids(parts: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sorted token sets, as two columns; 0, 0 for an empty set."""
    raw = b"".join(hashlib.blake2b(t.tobytes(), digest_size=16).digest() if len(t) else bytes(16) for t in parts)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits; about a bit for each token, a power of two and BITMAP at least."""
    width = max(BITMAP, 1 << (len(tokens) - 1).bit_length())
    bits = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def signature(bits: bytes) -> list[int]:
    """A bitmap folded to FOLD signed 64-bit numbers, for comparisons without Python."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.int64).reshape(-1, FOLD)).tolist()


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two bitmaps differ; the wider one is folded, which keeps its parities."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _by_row(b: pa.RecordBatch, text: int, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the distinct shingle hashes of their rows."""
    data, off = utf8(b.column(text))
    for lo, hi in slices(off):
        h, at = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
        yield b.slice(lo, hi - lo), [h[at[r] : at[r + 1]] for r in range(hi - lo)]


def _sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_id, d1 and d2 (digest of the set; null if empty) and n_shingles of every row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in _by_row(b, 1, n):
                ids, none = set_ids(found), np.array([not len(t) for t in found], bool)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(ids[:, 0], mask=none), pa.array(ids[:, 1], mask=none), pa.array([len(t) for t in found], pa.int64())], names=["doc_id", "text_id", "d1", "d2", "n_shingles"])

    return _text(docs).mapInArrow(run, "doc_id bigint, text_id bigint, d1 bigint, d2 bigint, n_shingles bigint")


def _nodes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per distinct set that is not empty: node (a number), d1, d2, least doc_id, size, bitmap and its fold, extended prefix."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in _by_row(b, 1, n):
                ids, keep = set_ids(found), np.array([bool(len(t)) for t in found], bool)
                found = [t for t in found if len(t)]
                maps = [bitmap(t) for t in found]
                ids = ids[keep]
                yield pa.record_batch(
                    [part.column(0).filter(pa.array(keep)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([len(t) for t in found], pa.int32()), pa.array(maps, pa.binary()), pa.array([signature(m) for m in maps], pa.list_(pa.int64())), pa.array([extended_prefix(t, percent).view(np.int64) for t in found], pa.list_(pa.int64()))],
                    names=["doc_id", "d1", "d2", "size", "bits", "sig", "keys"],
                )

    rows = _text(docs).mapInArrow(run, "doc_id bigint, d1 bigint, d2 bigint, size int, bits binary, sig array<bigint>, keys array<bigint>")
    one = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.first(F.struct("size", "bits", "sig", "keys")).alias("x"))
    return one.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "least", "x.size", "x.bits", *[F.col("x.sig")[k].alias(f"s{k}") for k in range(FOLD)], "x.keys")


def _postings(nodes: DataFrame, percent: int) -> DataFrame:
    """What each node has in the index: key, node, size, place, the tokens before (see ``index_keys``), ``own``, ``few``, ``apart``.

    ``own`` is how many thousandths of its prefix no other node has; for the last two see ``_central``.
    """
    each = nodes.select("node", "size", F.size("keys").alias("m"), F.posexplode("keys").alias("place", "key"))
    live = saved(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "live-tokens")
    found = saved(each.join(live, "key").groupBy("node").agg(F.first("size").alias("size"), F.first("m").alias("m"), F.collect_list(F.struct("place", "key", "n")).alias("x")), "found-tokens")
    central = _central(found, nodes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = b.column(3).flatten(), b.column(3).offsets.to_numpy()
            off = off - off[0]
            place, key, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            cols: list[list] = [[] for _ in range(9)]
            for r, (node, size, m, few, apart) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)))):
                at = place[off[r] : off[r + 1]]
                # Tokens that no other node has keep their places in the order, with a key that is never posted.
                keys, counts = np.zeros(m, np.int64), np.ones(m, np.int64)
                keys[at], counts[at] = key[off[r] : off[r + 1]], count[off[r] : off[r + 1]]
                k, p, first, second = index_keys(keys.view(np.uint64), counts, size, percent)
                own = 1000 * (m - len(at)) // m
                one = (np.full(len(k), v, np.int32) for v in (own, few, apart))
                for c, v in zip(cols, (k.view(np.int64), np.full(len(k), node), np.full(len(k), size, np.int32), p.astype(np.int32), first.view(np.int64), second.view(np.int64), *one)):
                    c.append(v)
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["key", "node", "size", "place", "before", "between", "own", "few", "apart"])

    ranked = found.join(central, "node", "left").select("node", "size", "m", "x", F.coalesce("few", F.lit(64)).alias("few"), F.coalesce("apart", F.lit(0)).alias("apart"))
    posts = saved(ranked.mapInArrow(run, "key bigint, node bigint, size int, place int, before bigint, between bigint, own int, few int, apart int"), "postings")
    dropped(live, found, central)
    return posts


def _possible(sa: Column, ia: Column, sb: Column, ib: Column, percent: int) -> Column:
    """Whether sizes and the places of a shared key still allow a link."""
    sa, ia, sb, ib = (c.cast("long") for c in (sa, ia, sb, ib))
    most = F.least(ia, ib) + F.lit(1) + F.least(sa - ia, sb - ib) - 1
    return (F.least(sa, sb) * 100 >= F.greatest(sa, sb) * percent) & (most * (100 + percent) >= (sa + sb) * percent)


def majority(counts: np.ndarray, nodes: int) -> list[int]:
    """The folded bitmap of the bits that more than half of the nodes have; counts as ``np.unpackbits`` orders the bits."""
    return np.packbits(2 * counts > nodes).view(np.int64).tolist()


def _central(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, few and apart of every node with a frequent token: how near it is to the middle of its near copies.

    A node votes once, among those whose rarest frequent token is also its own: what all near copies of a text share has
    at least their number of nodes, and most of them have the rarest of it.  ``apart`` is in how many bits its folded
    bitmap differs from the majority of the voters' bitmaps; ``few`` falls by 1 when the voters double, as the majority
    of a few nodes says little.  A bitmap travels once for each node, however many lists the node is in.
    """
    sig = [f"s{k}" for k in range(FOLD)]
    rarest = F.array_min(F.transform(F.filter("x", lambda t: t["n"] > FREQUENT), lambda t: F.struct(t["n"], t["key"])))
    voters = found.select("node", rarest["key"].alias("key")).where("key IS NOT NULL")
    voters = saved(voters.join(nodes.select("node", *sig), "node"), "voters")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / PART)).alias("part")
    parts = voters.join(voters.groupBy("key").agg(F.count("*").alias("m")), "key").select("key", *sig, part)

    def count(t: pa.Table) -> pa.Table:
        words = np.ascontiguousarray(np.stack([t.column(k).to_numpy() for k in range(1, FOLD + 1)], axis=1))
        bits = np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        return pa.table({"key": t.column(0).slice(0, 1), "n": [t.num_rows], "bits": pa.array([bits], pa.list_(pa.int32()))})

    def vote(t: pa.Table) -> pa.Table:
        bits = t.column(2).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(axis=0, dtype=np.int64)
        n = sum(t.column(1).to_pylist())
        return pa.table({"key": t.column(0).slice(0, 1), "n": [n], **{f"m{k}": pa.array([v], pa.int64()) for k, v in enumerate(majority(bits, n))}})

    counts = parts.groupBy("key", "part").applyInArrow(count, "key bigint, n bigint, bits array<int>")
    votes = saved(counts.groupBy("key").applyInArrow(vote, "key bigint, n bigint, " + ", ".join(f"m{k} bigint" for k in range(FOLD))), "majorities")
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"m{k}"))) for k in range(FOLD)), F.lit(0))
    few = (F.lit(63) - F.floor(F.log2("n"))).cast("int")
    central = saved(voters.join(votes, "key").select("node", few.alias("few"), apart.alias("apart")), "central")
    dropped(voters, votes)
    return central


def _hubs(posts: DataFrame) -> DataFrame:
    """key and hub (own, size, place, node) of every list of two nodes or more.

    The hub of a short list is the node that has least of its own: among near copies, the one that the others were made
    from.  A prefix tells too little of that where many copies have nothing of their own in it; the hub of a list of more
    than ``FREQUENT`` nodes is the one nearest to the majority of the most nodes (see ``_central``).
    """
    least, central = (F.min(F.struct(*c, "own", "size", "place", "node")).alias(k) for k, c in (("least", ()), ("central", ("few", "apart"))))
    one = posts.groupBy("key").agg(F.count("*").alias("m"), least, central).where("m > 1")
    hub = F.when(F.col("m") <= FREQUENT, F.col("least")).otherwise(F.struct(*[F.col(f"central.{k}") for k in ("own", "size", "place", "node")]))
    return saved(one.select("key", hub.alias("hub")), "hubs")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bitmaps first, then the whole sets."""
    a = nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba"))
    b = nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb"))

    @tidy
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            (d1, o1), (d2, o2) = utf8(x.column(3)), utf8(x.column(5))
            if len(d1) == len(d2) == x.num_rows * BITMAP // 8:
                apart = np.bitwise_count(d1 ^ d2).reshape(x.num_rows, -1).sum(axis=1, dtype=np.int64)
            else:
                apart = np.array([bits_apart(d1[o1[i] : o1[i + 1]], d2[o2[i] : o2[i + 1]]) for i in range(x.num_rows)])
            total = x.column(2).to_numpy().astype(np.int64) + x.column(4).to_numpy()
            yield x.select([0, 1]).filter(pa.array((total - apart) * (100 + percent) >= 2 * percent * total))

    near = saved(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "ba", "sb", "bb").mapInArrow(close, "a bigint, b bigint"), "near-pairs")
    members = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    members = saved(nodes.select("node", "d1", "d2").join(members, "node"), "members")
    whole = _whole_sets(docs, members, n)
    sa = whole.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    sb = whole.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))

    @tidy
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for ta, tb in zip(x.column(2), x.column(3)):
                p, q = np.frombuffer(ta.as_buffer(), np.uint64), np.frombuffer(tb.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int(np.count_nonzero(q[at] == p))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = saved(near.join(sa, "a").join(sb, "b").select("a", "b", "ta", "tb").mapInArrow(link, "a bigint, b bigint"), "links")
    dropped(near, members, whole)
    return links


def _whole_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Each member's sorted tokens, once. A Bloom filter of fixed size keeps most other sets out of the shuffle."""
    rows = (
        members.select(F.pmod(F.col("d1"), F.lit(BLOOM_BITS)).cast("long").alias("bit"))
        .select(F.shiftright("bit", 15).cast("int").alias("block"), (F.col("bit") % (1 << 15)).cast("int").alias("at"))
        .groupBy("block")
        .agg(F.collect_set("at").alias("at"))
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                bits = np.zeros(1 << 15, np.uint8)
                bits[x.values.to_numpy()] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    table = np.zeros((BLOOM_BITS >> 15, 1 << 12), np.uint8)
    for r in rows.mapInArrow(packed, "block int, bits binary").toLocalIterator():  # 1024 rows of 4 KB at most
        table[r.block] = np.frombuffer(r.bits, np.uint8)
    bloom = docs.sparkSession.sparkContext.broadcast(table.ravel())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for b in batches:
            for _, found in _by_row(b, 0, n):
                ids = set_ids(found)
                k = ids[:, 0] % BLOOM_BITS
                hit = np.flatnonzero((bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool) & np.array([bool(len(t)) for t in found], bool))
                if len(hit):
                    yield pa.record_batch([pa.array(ids[hit, 0]), pa.array(ids[hit, 1]), pa.array([found[i].tobytes() for i in hit.tolist()], pa.binary())], names=["d1", "d2", "tokens"])

    found = docs.select("text").mapInArrow(run, "d1 bigint, d2 bigint, tokens binary")
    return saved(found.groupBy("d1", "d2").agg(F.first("tokens").alias("tokens")).join(members, ["d1", "d2"]).select("node", "tokens"), "whole-sets")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternating large-star and small-star steps: each node's neighbours turn to its smallest neighbour.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = saved(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        dropped(e)
        e = new
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge to a root, which has none itself; then each edge leads to its component's smallest node."""
    if not e.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty()


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after more links (a, b), which may hold nodes of their own: only roots are linked."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    base = saved(comp.union(ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("root"))), "components")
    one, two = (base.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b"))
    roots = components(links.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    roots = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return base.join(roots, "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def _rooted(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_sizes`` with their nodes, and node, its least doc_id and the root of its component."""
    bounded_batches(docs.sparkSession)
    nodes = saved(_nodes(docs, n, percent), "nodes")
    posts = _postings(nodes, percent)
    hubs = _hubs(posts)  # stored, so that the join shuffles both sides anew and can split a hot key over tasks
    lists = saved(posts.join(hubs, "key"), "posting-lists")
    dropped(posts, hubs)
    shared = (
        lists.where((F.col("node") != F.col("hub.node")) & _possible(F.col("size"), F.col("place"), F.col("hub.size"), F.col("hub.place"), percent))
        .groupBy("node", F.col("hub.node").alias("hub"))
        .agg(F.count("*").alias("keys"))
    )
    shared = saved(shared, "star-keys")
    star = saved(shared.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "star-pairs")
    # A node meets the hub with which it shares most keys first; other hubs only if they are still in different components.
    best = shared.groupBy("node").agg(F.max(F.struct("keys", "hub")).alias("x")).select(F.least("node", "x.hub").alias("a"), F.greatest("node", "x.hub").alias("b"))
    best = saved(best.distinct(), "best-pairs")
    comp = saved(components(_verified(best, nodes, docs, n, percent)), "components")
    one, two = (comp.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b"))
    rest = star.join(best, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    rest = saved(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "other-pairs")
    if not rest.isEmpty():
        links = _verified(rest, nodes, docs, n, percent)
        if not links.isEmpty():
            comp = saved(merged(comp, links), "components")
    dropped(shared, best, rest)

    # Nodes of different components that share a list, other than those that met the hub.
    sig = [f"s{k}" for k in range(FOLD)]
    labelled = lists.join(comp, "node", "left").select("key", "node", "size", "place", "before", "between", (F.col("node") == F.col("hub.node")).alias("is_hub"), F.coalesce("root", "node").alias("c"))
    centre = labelled.groupBy("key").agg(F.max(F.when(F.col("is_hub"), F.col("c"))).alias("hc"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key", "hc")
    centre = saved(centre, "mixed-keys")
    mixed = saved(labelled.join(centre, "key").withColumn("minor", F.col("c") != F.col("hc")), "mixed-lists")
    signed = mixed.join(nodes.select("node", *sig), "node")  # only now, so that lists stay narrow until here
    both = F.col("x_size").cast("long") + F.col("y_size")
    apart = sum((F.bit_count(F.col(f"x_{k}").bitwiseXOR(F.col(f"y_{k}"))) for k in sig), F.lit(0))
    x = signed.where("minor").select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "place", "before", "between", *sig, "c")])
    y = signed.select("key", "minor", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "place", "before", "between", *sig, "c")])
    # Nodes that agree in a token before share an earlier key and meet in its list.
    first = ((F.col("x_before") != F.col("y_before")) | (F.col("x_before") == 0)) & ((F.col("x_between") != F.col("y_between")) | (F.col("x_between") == 0))
    more = (
        x.join(y, "key")
        .where(first)
        .where((F.col("x_c") != F.col("y_c")) & (~F.col("minor") | (F.col("x_node") < F.col("y_node"))) & _possible(F.col("x_size"), F.col("x_place"), F.col("y_size"), F.col("y_place"), percent))
        .where((both - apart) * (100 + percent) >= both * (2 * percent))
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    later = _verified(saved(more, "cross-pairs"), nodes, docs, n, percent)
    if not later.isEmpty():
        comp = saved(merged(comp, later), "components")

    named = saved(nodes.select("node", "d1", "d2", "least").join(comp, "node", "left").select("node", "d1", "d2", "least", F.coalesce("root", "node").alias("root")), "rooted-nodes")
    dropped(lists, mixed, nodes)
    return _sizes(docs, n), named


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sizes, named = _rooted(docs, n, percent)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.join(ids, "root").select("d1", "d2", "component_id")
    return sizes.join(by_node, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Exactly one row of each component, and all rows with an empty set; all columns stay.

    The row with the smallest doc_id stays (nulls last), then that with the smallest set and text ids, then any one of
    equal rows.  Rows are told apart by doc_id and text, so one doc_id may stand on several texts.
    """
    sizes, named = _rooted(docs, n, percent)
    rows = saved(sizes.where(F.col("d1").isNotNull()).groupBy("doc_id", "text_id", "d1", "d2").agg(F.count("*").alias("copies")), "distinct-rows")
    rows = saved(rows.join(named.select("d1", "d2", "node", "root"), ["d1", "d2"]), "rooted-rows")
    best = saved(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "text_id")).alias("best")), "best-rows")
    same = (F.col("text_id") == F.col("best.text_id")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    drop = saved(rows.join(best, "root").select("doc_id", "text_id", "copies", same.alias("best")).where("copies > 1 OR NOT best"), "other-rows")
    dropped(rows, best)
    # The documents travel as one struct, so no name of theirs can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    other = drop.select(F.col("doc_id").alias("of_d"), F.col("text_id").alias("of_t"), "best")
    on = (F.col("t") == F.col("of_t")) & F.col("d").eqNullSafe(F.col("of_d"))
    single = keyed.join(other, on, "left_anti").select("row")
    repeated = keyed.join(other.where("best"), on, "left_semi").groupBy("d", "t").agg(F.first("row").alias("row")).select("row")
    return single.union(repeated).select("row.*")
