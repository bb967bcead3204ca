"""Suffix-array dedup on bytes by prefix-free parsing.

Byte strings of ``length`` bytes that start at more than one place of the corpus are removed, all of them.  Which
stretches can match is found by anchors (see ``_repeats``); they come together by fingerprint in shards.  Within a
shard the text is highly repetitive (its stretches share long strings), which is what prefix-free parsing is for:

* a rolling hash triggers phrase ends; each phrase reaches over the trigger string into the next, so no phrase's
  suffix of more than a trigger's length is a prefix of another's;
* the dictionary holds each different phrase once; its suffix array ranks all phrase suffixes;
* the parse, the sequence of phrase ranks, gets a suffix array of its own;
* (rank of the phrase suffix, rank of the parse after it) sorts every place of the text: corpus order.  Places
  whose ``length`` bytes agree are neighbours in it.

Defined results: a null text is empty and keeps the hash of nothing; texts shorter than ``length`` bytes stay whole;
repeated rows remove each other; overlapping matches count; matches never cross documents; an empty table gives
an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.llm import _repeats
from orbloom.llm._arrow import tidy, utf8, window_hash

LENGTH = 200
WIDTH = 64
TRIGGER = 8  # bytes of a trigger string
MODULUS = 32  # one trigger string in so many


def ranks_by_doubling(symbols: np.ndarray, limit: int | None = None, stop: np.ndarray | None = None) -> np.ndarray:
    """Ranks of all suffixes of ``symbols`` (ends count as smallest); equal only if equal for ``limit`` symbols.

    A rank is the number of smaller suffixes.  The first ranks come from as many symbols as fit in a 64-bit number; then
    the compared length doubles, and only suffixes that are still tied are sorted again.
    With ``stop``, the last place of each suffix, what stands behind does not count: equal suffixes get equal ranks.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    last = np.full(n, n - 1) if stop is None else stop
    bits = int(symbols.max() + 1).bit_length()
    width, place = max(1, 63 // bits), np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(n - k, 0)] |= np.where(place[k:] <= last[: max(n - k, 0)], symbols[k:] + 1, 0)
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    tied = order[np.repeat(size > 1, size)]
    while len(tied) and width < (limit or n):
        ahead = tied + width
        after = np.where(ahead <= last[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        old = rank[tied]
        head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        group = np.flatnonzero(np.concatenate([[True], np.diff(old) != 0]))
        size = np.diff(np.append(head, len(tied)))
        # A part's rank is its group's, and the members of the group before it.
        rank[tied] = old + np.repeat(head, size) - np.repeat(group, np.diff(np.append(group, len(tied))))
        tied = tied[np.repeat(size > 1, size)]
        width *= 2
    return rank


def parse(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase starts and ends (with the trigger string they share with the next phrase); pieces end at ``ends``."""
    n = len(text)
    trigger = np.flatnonzero(window_hash(text.astype(np.uint64), TRIGGER) % np.uint64(MODULUS) == 0)
    begin = np.concatenate([[0], ends[:-1]])
    piece = np.searchsorted(ends, trigger, "right")
    inside = (trigger + TRIGGER <= ends[piece]) & (trigger > begin[piece])
    starts = np.union1d(begin, trigger[inside])
    nxt = np.append(starts[1:], n)
    is_end = np.isin(nxt, ends)
    return starts, np.where(is_end, nxt, nxt + TRIGGER)


def corpus_order(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the text in suffix order up to piece ends, and their sort keys (equal for equal suffixes)."""
    starts, stops = parse(text, ends)
    raw, ids = text.tobytes(), {}
    which = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(starts.tolist(), stops.tolist())])
    # The dictionary: every different phrase once, each closed by a symbol smaller than any byte.
    size = np.array([len(p) + 1 for p in ids])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    symbols = np.frombuffer(b"".join(p + b"\0" for p in ids), np.uint8).astype(np.int64) + 1
    symbols[base + size - 1] = 0
    suffix_rank = ranks_by_doubling(symbols, int(size.max()), np.repeat(base + size - 1, size))
    order = np.unique(suffix_rank[base], return_inverse=True)[1]
    last = np.isin(stops, ends)
    # The parse: phrase ranks, with a smallest symbol after each piece, so that order ends there.
    m = len(starts)
    slot = np.arange(m) + np.concatenate([[0], np.cumsum(last)[:-1]])
    seq = np.zeros(m + int(last.sum()), np.int64)
    seq[slot] = order[which] + 1
    parse_rank = ranks_by_doubling(seq)
    after = parse_rank[slot + 1]
    # Every place: the rank of its phrase suffix, then the rank of the parse that follows.
    span = np.append(starts[1:], len(text)) - starts
    owner = np.repeat(np.arange(m), span)
    offset = np.arange(len(text)) - starts[owner]
    key = suffix_rank[base[which[owner]] + offset] * (len(seq) + 1) + after[owner]
    return np.argsort(key, kind="stable"), key


def agree(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each place of an order are those at the place before, by comparing them."""
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    padded = text.tobytes() + bytes(8)
    lanes = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    live = np.arange(1, len(order))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        live = live[lanes[order[live] + at] == lanes[order[live - 1] + at]]
    if length < 8:
        bits = np.uint64((1 << 8 * length) - 1)
        live = live[(lanes[order[live]] & bits) == (lanes[order[live - 1]] & bits)]
    same[live] = True
    return same


def repeated_windows(covers: list[bytes], counts: np.ndarray, windows: np.ndarray, length: int) -> list[np.ndarray]:
    """Which windows of each cover occur twice in the shard; a cover that stands n times counts n times."""
    if not covers:
        return []
    text = np.frombuffer(b"".join(covers), np.uint8)
    size = np.array([len(c) for c in covers])
    ends = np.cumsum(size)
    order, _ = corpus_order(text, ends)
    begin = ends - size
    piece = np.searchsorted(ends, order, "right")
    keep = order - begin[piece] < windows[piece]
    order, piece = order[keep], piece[keep]
    group = np.cumsum(~agree(text, order, length)) - 1
    twice = np.bincount(group, weights=counts[piece])[group] > 1
    mask = np.zeros(len(text), bool)
    mask[order] = twice
    return [mask[b : b + w] for b, w in zip(begin.tolist(), windows.tolist())]


SPEC = _repeats.Spec(LENGTH, WIDTH, False, repeated_windows)


def _marked(docs: DataFrame, length: int) -> DataFrame:
    spec = _repeats.Spec(length, min(WIDTH, length), False, repeated_windows)
    rows, ranges = _repeats.repeated(docs, spec)
    return rows.join(ranges, ["a", "b"], "left")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            cols: list[list] = [[] for _ in range(5)]
            for r in range(b.num_rows):
                part = data[off[r] : off[r + 1]]
                out = _repeats.covered(b.column(2)[r], len(part), length)
                kept = (part[~out] if out.any() else part).tobytes()
                spans = int(out[:1].sum() + np.count_nonzero(out[1:] & ~out[:-1]))
                for c, v in zip(cols, (len(part), int(out.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return _marked(docs, length).select("doc_id", "text", "ranges").mapInArrow(run, schema)


def whole_characters(out: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The mask without the characters that it covers only in part."""
    head = (data & 0xC0) != 0x80
    char = np.cumsum(head)
    partly = np.unique(char[~out])
    return out & ~np.isin(char, partly)


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut out of their texts, at whole characters, and n_chars made to match.

    Documents of which nothing but white space is left go; those that lose nothing stay as they are.  All other columns
    are kept.
    """
    columns, schema = docs.columns, docs.schema
    # Everything but keys and text travels as one struct, so no name of the documents can clash.
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), *[c.alias(n) for c, n in zip(_repeats.key_columns(docs), ("a", "b"))])
    ranges = _repeats.repeated(docs, _repeats.Spec(length, min(WIDTH, length), False, repeated_windows))[1]
    joined = rows.join(ranges, ["a", "b"], "left").select("row", "ranges")
    at = columns.index("text")
    count_at = columns.index("n_chars") if "n_chars" in columns else None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given, ranges = b.column(0).flatten(), b.column(1)
            texts = given[at].to_pylist()
            data, off = utf8(given[at])
            keep = []
            counts = given[count_at].to_pylist() if count_at is not None else []
            for r in range(b.num_rows):
                part = data[off[r] : off[r + 1]]
                out = _repeats.covered(ranges[r], len(part), length)
                if out.any():
                    out = whole_characters(out, part)
                    texts[r] = part[~out].tobytes().decode()
                    if count_at is not None:
                        counts[r] = len(texts[r])
                keep.append(not out.any() or bool(texts[r].strip()))
            cols = list(given)
            cols[at] = pa.array(texts, cols[at].type)
            if count_at is not None:
                cols[count_at] = pa.array(counts, cols[count_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)
