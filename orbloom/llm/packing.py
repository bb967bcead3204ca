"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` tokens.  How pieces can
share a sequence depends on their lengths alone, so the problem is the counts of
at most ``capacity`` lengths, however many documents there are.  A chromosome is
a list of bins; equal bins (the same lengths) are one gene with a multiplicity.
Each island evolves its own population in a task of its own:

* the first packings take the lengths in random order, so none of them is the
  greedy packing from the start;
* crossover injects whole well-filled bins of one parent into the other, takes
  out the other's bins that now hold pieces twice, and best-fits the displaced
  pieces into the bins that stay;
* mutation breaks up a few of the worst-filled bins and best-fits their pieces;
* after each epoch every island's elite moves to the next island of the ring,
  where it replaces the worst packing and takes part in the next crossovers.

All generations run, however good a packing is.  The greedy packing of longest
pieces first serves as a check: the result may not need more bins than it.  The
winner's bins go back to the pieces by rank within their length.

Defined results: a null text is empty; an empty text is one piece that holds
the closing id alone; equal texts get equal ids; ties between lengths go to the
rank of (hash, doc_id, piece); an empty table gives an empty result; further
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbloom.llm._arrow import saved, tidy, utf8

CAPACITY = 2048
CLOSING_ID = 0
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 5
POPULATION = 6
WELL_FILLED = 0.9995  # share of a bin that makes it fit to be passed on
WORDS_KEPT = 16_000_000  # bytes of words and their ids that a worker keeps

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


class WordTokenizer:
    """Token ids of whole texts, equal to the library's own.

    No token of this vocabulary reaches over white space or from one part of its splitting pattern to the next, so
    ids are kept by word and by part.  Parts of plain Latin letters, digits and signs, where lower case and normal
    form are beyond doubt, go to a faster byte-pair merger with the same ranks; a word's end is byte 0xFF there,
    which UTF-8 never has.  All other words go to the tokenizers library as they are.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(split).findall
        self.plain = regex.compile("[\\x21-\\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017f]+").fullmatch
        shown = self._shown_bytes()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = token.endswith("</w>")
            body = token[:-4] if ends else token
            if all(c in shown for c in body):
                ranks[bytes(shown[c] for c in body) + (b"\xff" if ends else b"")] = i
        spare = max(ranks.values()) + 1
        for i in range(256):
            ranks.setdefault(bytes([i]), spare + i)
        self.merge = tiktoken.Encoding("word ends", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known: dict[bytes, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _shown_bytes() -> dict[str, int]:
        """The printable stand-ins that byte-level vocabularies write for bytes."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not (text.isascii() and text.isprintable()) and not self.plain(text) or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text, known, out = text.lower(), self.known_parts, b""
        for part in (text,) if text.isalpha() else self.parts(text):
            ids = known.get(part)
            if ids is None:
                ids = known[part] = array("I", self.merge(part.encode() + b"\xff")).tobytes()
            out += ids
        return out

    def encode(self, text: bytes) -> np.ndarray:
        words = text.split()  # ASCII white space only; what is left inside a word is the tokenizer's
        known = self.known
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), "<u4")
        except KeyError:
            new = {w for w in words if w not in known}
        if self.held > WORDS_KEPT:
            known.clear()
            self.known_parts.clear()
            self.held = 0
            new = set(words)
        for w in new:
            ids = known[w] = self._word(w)
            self.held += 240 + 2 * (len(w) + len(ids))  # the parts of a word are kept as well
        return np.frombuffer(b"".join([known[w] for w in words]), "<u4")


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that words stay known from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its document's ids before it, its length and the CRC-32 of its ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in batches:
            data, off = utf8(b.column(1))
            raw = data.tobytes()
            rows: list[list] = [[], [], [], [], []]
            for i, doc in enumerate(b.column(0).to_pylist()):
                ids = np.append(tok.encode(raw[off[i] : off[i + 1]]), np.uint32(CLOSING_ID)).astype("<u4")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo : lo + capacity]
                    for col, v in zip(rows, (doc, k, lo, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=PIECES.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)


# --- the grouping genetic algorithm, over counts of lengths -------------------------------------------------------

Bins = dict[tuple[int, ...], int]  # the lengths in a bin, longest first -> how many such bins


def best_fit(counts: np.ndarray, capacity: int, bins: Bins | None = None, rng: np.random.Generator | None = None, shake: float = 0.07) -> Bins:
    """Places counts[length] pieces, longest first, each into the open bin that it fills best.

    Bins with equal contents move together, so the work follows the number of distinct bins, not of pieces.
    With ``rng``, the order of lengths is shaken: a little, or with ``shake`` 1 completely.
    """
    done: Bins = {}
    by_room: list[Bins] = [{} for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 2, bool)
    for content, n in (bins or {}).items():
        by_room[capacity - sum(content)][content] = by_room[capacity - sum(content)].get(content, 0) + n
    for r in range(capacity + 1):
        rooms[r] = bool(by_room[r])
    lengths = np.flatnonzero(counts[: capacity + 1])[::-1]
    lengths = lengths[lengths > 0]
    if rng is not None and len(lengths) > 1:
        lengths = lengths[np.argsort(-(lengths * rng.uniform(1.0 - shake, 1.0, len(lengths)) if shake < 1 else rng.random(len(lengths))), kind="stable")]
    for length in lengths.tolist():
        left = int(counts[length])
        while left:
            fit = int(np.argmax(rooms[length : capacity + 1])) + length
            if not rooms[fit] or fit > capacity:
                # No open bin has room: open full rows of this length at once.
                per = capacity // length
                full, rest = divmod(left, per)
                for content, n in (((length,) * per, full), ((length,) * rest, 1 if rest else 0)):
                    if n:
                        room = capacity - length * len(content)
                        by_room[room][content] = by_room[room].get(content, 0) + n
                        rooms[room] = True
                left = 0
                continue
            content, n = next(iter(by_room[fit].items()))
            per = min(fit // length, max(1, left // n))
            take = min(n, max(1, left // per))
            grown = tuple(sorted(content + (length,) * per, reverse=True))
            if take == n:
                del by_room[fit][content]
                rooms[fit] = bool(by_room[fit])
            else:
                by_room[fit][content] = n - take
            room = fit - length * per
            by_room[room][grown] = by_room[room].get(grown, 0) + take
            rooms[room] = True
            left -= per * take
    for group in by_room:
        for content, n in group.items():
            done[content] = done.get(content, 0) + n
    return done


def content_counts(bins: Bins, capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    for content, n in bins.items():
        for length, k in Counter(content).items():
            out[length] += n * k
    return out


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, the packing with fuller bins (mean square fill)."""
    total = sum(bins.values())
    return total, -sum(n * (sum(c) / capacity) ** 2 for c, n in bins.items())


def crossover(a: Bins, b: Bins, capacity: int, rng: np.random.Generator) -> tuple[Bins, int]:
    """Injects well-filled bins of ``b`` into ``a``; bins of ``a`` with pieces that came twice go, the rest is best-fitted.

    Also returns how many bins were injected.
    """
    child: Bins = {}
    used = np.zeros(capacity + 1, np.int64)
    total = content_counts(a, capacity)
    injected = 0
    for content, n in b.items():
        if sum(content) >= WELL_FILLED * capacity and rng.random() < 0.6:
            child[content] = n
            injected += n
            for length, k in Counter(content).items():
                used[length] += n * k
    for content, n in sorted(a.items(), key=lambda x: (-sum(x[0]), x[0])):
        need = Counter(content)
        keep = min(n, min(int(total[length] - used[length]) // k for length, k in need.items()))
        if keep > 0 and sum(content) >= WELL_FILLED * capacity:
            child[content] = child.get(content, 0) + keep
            for length, k in need.items():
                used[length] += keep * k
    return best_fit(total - used, capacity, child, rng if rng.random() < 0.5 else None), injected


def mutate(bins: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """Breaks up all bins that are not full and a random share of the others, and best-fits their pieces."""
    share = rng.uniform(0.05, 0.6)
    kept = {}
    loose = np.zeros(capacity + 1, np.int64)
    for content, n in sorted(bins.items()):
        if sum(content) == capacity and rng.random() >= share:
            kept[content] = n
        else:
            for length, k in Counter(content).items():
                loose[length] += n * k
    return best_fit(loose, capacity, kept, rng if rng.random() < 0.5 else None)


@dataclass
class Progress:
    """What an island did in an epoch."""

    crossovers: int = 0
    injected: int = 0  # bins that came from the other parent whole
    migrants: int = 0


def random_fit(counts: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """A first packing: best fit with the lengths in random order."""
    return best_fit(counts, capacity, rng=rng, shake=1.0)


def evolve(counts: np.ndarray, capacity: int, seed: int, arrived: list[Bins], population: list[Bins], generations: int, size: int) -> tuple[list[Bins], Progress]:
    """One island's epoch: its population after ``generations``, the fittest first."""
    rng, done = np.random.default_rng(seed), Progress()
    population = list(population)
    while len(population) < size:
        population.append(random_fit(counts, capacity, rng))
    population.sort(key=lambda x: fitness(x, capacity))
    if arrived:
        population[-len(arrived) :] = arrived
        done.migrants = len(arrived)
    for _ in range(generations):
        population.sort(key=lambda x: fitness(x, capacity))
        parents = population[: max(2, size // 2)]
        children = []
        for k in range(size - len(parents)):
            i, j = (0, 1 + k % (len(parents) - 1)) if k < len(parents) - 1 else rng.choice(len(parents), 2, replace=False)
            child, injected = crossover(parents[i], parents[j], capacity, rng)
            done.crossovers += 1
            done.injected += injected
            children.append(mutate(child, capacity, rng) if rng.random() < 0.5 else child)
        population = parents + children
    return sorted(population, key=lambda x: fitness(x, capacity)), done


def _flat(bins: Bins) -> tuple[list[int], list[int], list[int]]:
    items = sorted(bins.items())
    return [x for c, _ in items for x in c], [len(c) for c, _ in items], [n for _, n in items]


def _bins(flat: list[int], sizes: list[int], times: list[int]) -> Bins:
    out, lo = {}, 0
    for s, n in zip(sizes, times):
        out[tuple(int(x) for x in flat[lo : lo + s])] = int(n)
        lo += s
    return out


def islands(spark, counts: np.ndarray, capacity: int = CAPACITY, n: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, size: int = POPULATION) -> tuple[Bins, list[Progress]]:
    """Evolves n islands as Spark tasks and sends each elite on along the ring after every epoch.

    Between epochs an island's population is its half fittest packings, of at most as many different bins as there
    are lengths times rooms, however many documents there are.
    """
    schema = "island int, flat array<array<int>>, sizes array<array<int>>, times array<array<bigint>>, crossovers bigint, injected bigint, migrants bigint"
    living: list[list[Bins]] = [[] for _ in range(n)]
    progress: list[Progress] = []
    for epoch in range(epochs):
        sent = [([living[i - 1][0]] if epoch and n > 1 else [], living[i]) for i in range(n)]
        shared = spark.sparkContext.broadcast([([_flat(x) for x in a], [_flat(x) for x in b]) for a, b in sent])

        def run(batches, shared=shared, epoch=epoch):
            for pdf in batches:
                for i in pdf["island"]:
                    arrived, own = ([_bins(*x) for x in part] for part in shared.value[int(i)])
                    found, did = evolve(counts, capacity, 1000 * epoch + int(i), arrived, own, generations, size)
                    flat = [_flat(x) for x in found[: max(2, size // 2)]]
                    yield pd.DataFrame({"island": [i], "flat": [[f[0] for f in flat]], "sizes": [[f[1] for f in flat]], "times": [[f[2] for f in flat]], "crossovers": [did.crossovers], "injected": [did.injected], "migrants": [did.migrants]})

        rows = spark.range(0, n, 1, n).selectExpr("cast(id as int) island").mapInPandas(run, schema).collect()
        for r in rows:
            living[r.island] = [_bins(*x) for x in zip(r.flat, r.sizes, r.times)]
            progress.append(Progress(r.crossovers, r.injected, r.migrants))
    best = min((x for own in living for x in own), key=lambda x: fitness(x, capacity))
    greedy = best_fit(counts, capacity)
    return (best if sum(best.values()) <= sum(greedy.values()) else greedy), progress


def slots(bins: Bins) -> pd.DataFrame:
    """For each run of ranks of a length: the first sequence, how many in a row, and the place in the sequence."""
    out, first = [], 0
    taken: Counter = Counter()
    for content, n in sorted(bins.items()):
        offset = 0
        for length in content:
            out.append((length, taken[length], n, first, offset))
            taken[length] += n
            offset += length
        first += n
    return pd.DataFrame(out, columns=["length", "rank", "n", "sequence", "offset"]).sort_values(["length", "rank"]).reset_index(drop=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into as few sequences of ``capacity`` tokens as it can; one row per piece."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer_path, capacity), "pieces")
    # Lengths can be hot (whole pieces, groups of copies): they are counted and ranked by salted parts.
    rows = cut.count()
    parts = int(min(4096, max(64, rows // 20_000)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sums = cut.where(F.col("length") < capacity).groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in sums:
        counts[r["length"]] = r["count"]
    table = slots(islands(spark, counts, capacity)[0]) if counts.any() else slots({})
    keys = table["length"].to_numpy(np.int64) * (1 << 40) + table["rank"].to_numpy(np.int64)
    n_seq, first, offset = (table[c].to_numpy(np.int64) for c in ("n", "sequence", "offset"))
    ranks0 = table["rank"].to_numpy(np.int64)
    base = int((first + n_seq).max()) if len(table) else 0

    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_part = per_part.select("length", "part", before.alias("before"))
    ranked = (
        cut.join(per_part, ["length", "part"])
        .withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
        .select(*PIECES.names, "rank")
    )
    out = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = length == capacity
            if len(keys):
                k = np.clip(np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1, 0, None)
                seq, at = first[k] + rank - ranks0[k], offset[k]
            else:
                seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            seq = np.where(whole, base + rank, seq)
            yield pa.record_batch([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(np.where(whole, 0, at), pa.int64())], names=out.names)

    return ranked.mapInArrow(place, out)
