"""Substring dedup on words: suffix automata of reference shards and matching statistics.

Word sequences of ``length`` words that start at more than one place of the corpus are removed, all of them.
Which stretches of text can match is found by anchors (see ``_repeats``); those stretches, each only once, are the
reference.  It is cut into shards by fingerprint, each small enough for one task.  A shard's suffix automaton
is built there and its stretches stream through it: the state of the last ``length`` words counts how often that
sequence was met, and windows whose state was met twice form the maximal spans to remove.  Anchors only say which
stretches meet: every removed word comes from matching statistics.

An automaton of the whole corpus has no proven size, so shards go to the stretches that can match them instead of
to every task.  A reference of bounded size (a benchmark) does go to every task: see ``remove_reference``.

Defined results: a null or blank text has no words, nothing is removed and the kept text is empty; documents of
fewer than ``length`` words stay whole; repeated rows remove each other; an empty table gives an empty result;
further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.llm import _repeats
from orbloom.llm._arrow import tidy, utf8

LENGTH = 35
WIDTH = 8
REFERENCE_LIMIT = 20_000_000  # bytes of a reference that may go to every task
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """Of several word sequences; words are any hashable values."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, sequence, limit: int) -> tuple[list[int], list[int]]:
        """Matching statistics: for each end, the length of the longest match (``limit`` at most) and its state."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        sizes, states = [], []
        for c in sequence:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
                if n >= limit:
                    n = limit
                    while length[link[v]] >= limit:
                        v = link[v]
            sizes.append(n)
            states.append(v)
        return sizes, states


def repeated_windows(covers: list[bytes], counts: np.ndarray, windows: np.ndarray, length: int) -> list[np.ndarray]:
    """Which windows of each cover were met twice in the shard; a cover that stands n times counts n times."""
    ids: dict[bytes, int] = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in c.split()] for c in covers]
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    met = np.zeros(len(automaton.len), np.int64)
    ends = []
    for s, n, w in zip(sequences, counts, windows):
        states = np.array(automaton.matches(s, length)[1][length - 1 :])[:w]
        np.add.at(met, states, n)
        ends.append(states)
    return [met[e] > 1 for e in ends]


SPEC = _repeats.Spec(LENGTH, WIDTH, True, repeated_windows)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every document."""
    spec = _repeats.Spec(length, min(WIDTH, length), True, repeated_windows)
    rows, ranges = _repeats.repeated(docs, spec)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            n_words, n_removed, texts = [], [], []
            for r in range(b.num_rows):
                part = data[off[r] : off[r + 1]]
                ws = part.tobytes().split()
                out = _repeats.covered(b.column(2)[r], len(ws), length)
                n_words.append(len(ws))
                n_removed.append(int(out.sum()))
                texts.append(b" ".join([w for w, o in zip(ws, out.tolist()) if not o] if out.any() else ws))
            yield pa.record_batch(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return rows.join(ranges, ["a", "b"], "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def remove_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept text after removing spans of ``length`` words or more that the reference has.

    The reference's size is checked; its shards' automata are built once in each task from the broadcast texts.
    """
    spark = docs.sparkSession
    size = reference.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > REFERENCE_LIMIT:
        raise ValueError(f"a reference of {size} bytes is too large to broadcast; the limit is {REFERENCE_LIMIT}")
    texts = spark.sparkContext.broadcast([(r.text or "").encode() for r in reference.select("text").collect()])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held = [SuffixAutomaton()], 0
        for t in texts.value:
            ws = t.split()
            if held + len(ws) > SHARD_WORDS and held:
                shards.append(SuffixAutomaton())
                held = 0
            shards[-1].add(ws)
            held += len(ws)
        for b in batches:
            data, off = utf8(b.column(1))
            cols: list[list] = [[], [], []]
            for r in range(b.num_rows):
                ws = data[off[r] : off[r + 1]].tobytes().split()
                mark = np.zeros(len(ws) + 1, np.int32)
                for a in shards:
                    for end in np.flatnonzero(np.array(a.matches(ws, length)[0]) >= length):
                        mark[end + 1 - length] += 1
                        mark[end + 1] -= 1
                out = np.cumsum(mark[:-1]) > 0
                for c, v in zip(cols, (len(ws), int(out.sum()), b" ".join([w for w, o in zip(ws, out) if not o]).decode("utf-8", "replace"))):
                    c.append(v)
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
