"""SentencePiece encoding and decoding: batched numpy Viterbi over the pieces and scores of a public model.

Words that are new to a worker are segmented together: words of equal length advance one end position at a time,
hashes of their substrings, grown by one character at each step, probe the sorted piece keys, and a vectorised
maximum over the starts stores the backpointers.  The pieces found are compared with the text.  Very long words, of
which there are not enough of one length to fill a batch, go through the same recursion one position at a time.
The segmentation with the largest sum of scores wins; equal sums go to the longer last piece.
No piece of the vocabulary continues over a space after a letter, so words are independent of each other.
Characters without a piece become byte pieces.  The model's pieces and scores are used as they are; for a file of
merge ranks this is the best segmentation by rank, not the merge order of its own encoder.

Defined results: a null or empty text has no ids; all other texts get one leading space, as the model asks;
U+2581 in a text reads as a space; equal texts get equal ids; decoding ids of a text gives the text back; repeated
rows stay repeated; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbloom.llm._arrow import BASE, joined, mix, tidy

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the file format
UNKNOWN_PENALTY = 10.0
CACHE = 24_000_000  # bytes of words and their ids that a worker keeps
LONG, FEW = 2000, 8  # letters of a long word, and how many such words are too few for a batch
CELLS = 1 << 18
TEXTS = 1000


def _varint(b: bytes, p: int) -> tuple[int, int]:
    x = s = 0
    while True:
        x |= (b[p] & 127) << s
        p, s = p + 1, s + 7
        if b[p - 1] < 128:
            return x, p


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and raw values of a serialized message."""
    p = 0
    while p < len(b):
        key, p = _varint(b, p)
        kind = key & 7
        if kind == 0:
            v, p = _varint(b, p)
        elif kind == 2:
            n, p = _varint(b, p)
            v, p = b[p : p + n], p + n
        else:
            n = 4 if kind == 5 else 8
            v, p = b[p : p + n], p + n
        yield key >> 3, v


@dataclass
class Pieces:
    text: list[str]
    score: np.ndarray
    kind: np.ndarray

    @classmethod
    def read(cls, path: str) -> Pieces:
        text, score, kind = [], [], []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    m = dict(_fields(value))
                    text.append(m.get(1, b"").decode())
                    score.append(struct.unpack("<f", m[2])[0] if 2 in m else 0.0)
                    kind.append(m.get(3, NORMAL))
        return cls(text, np.array(score, np.float64), np.array(kind))


class Codec:
    def __init__(self, pieces: Pieces):
        usable = np.flatnonzero((pieces.kind == NORMAL) | (pieces.kind == USER))
        score = pieces.score.copy()
        normal = pieces.kind == NORMAL
        self.unknown_score = float(score[normal].min() if normal.any() else 0.0) - UNKNOWN_PENALTY
        lengths = np.array([len(pieces.text[i]) for i in usable])
        top = float(score[normal].max() if normal.any() else 0.0)
        user = pieces.kind[usable] == USER
        score[usable[user]] = lengths[user] * top - 0.1
        self.longest = int(lengths.max(initial=1))
        keys = np.array([self._key(pieces.text[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], usable[order], score[usable[order]]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.texts = pieces.text
        self.by_text = {pieces.text[i]: (i, float(score[i])) for i in usable.tolist()}
        self.byte_id = np.zeros(256, np.uint32)
        table: list[bytes] = []
        for i, (t, k) in enumerate(zip(pieces.text, pieces.kind)):
            if k == BYTE:
                self.byte_id[int(t[3:5], 16)] = i
                table.append(bytes([int(t[3:5], 16)]))
            else:
                table.append(b"" if k in (CONTROL, UNUSED) else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode())
        self.table = table
        inner = any(SPACE in t.lstrip(SPACE) for t in pieces.text)
        self.split = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = np.full(1, BASE)
        for c in np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64):
            h = joined(h, np.full(1, c))
        return mix(h)[0]

    def _batch(self, words: list[str], length: int) -> list[bytes]:
        """Viterbi for words of one length, all at once."""
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length)
        codes = codes.astype(np.uint64)
        grown = np.empty((n, 0), np.uint64)  # hashes of the substrings that end here, the longest first
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        start = np.zeros((n, length + 1), np.int32)
        piece = np.zeros((n, length + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, length + 1):
            lo = max(0, end - self.longest)
            starts = np.arange(lo, end)
            grown = np.column_stack([grown[:, max(0, grown.shape[1] + 1 - self.longest) :], np.full(n, BASE)])
            grown = joined(grown, codes[:, end - 1 : end])
            h = mix(grown)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            s = np.where(hit, self.scores[at], -np.inf)
            missing = ~hit[:, -1]
            s[missing, -1] = self.unknown_score
            total = best[:, lo:end] + s
            k = total.argmax(axis=1)
            best[:, end] = total[rows, k]
            start[:, end] = starts[k]
            piece[:, end] = np.where(missing & (k == end - 1 - lo), -1, self.ids[at[rows, k]])
        out = []
        start_l, piece_l = start.tolist(), piece.tolist()
        for r, w in enumerate(words):
            e, ids = length, []
            while e:
                p = piece_l[r][e]
                s = start_l[r][e]
                if p >= 0 and self.texts[p] != w[s:e]:
                    ids = self._single(w)[::-1]
                    break
                ids.extend([p] if p >= 0 else self.byte_id[list(w[s:e].encode("utf-8", "replace"))][::-1].tolist())
                e = s
            out.append(struct.pack(f"<{len(ids)}I", *reversed(ids)))
        return out

    def _single(self, word: str) -> list[int]:
        """Viterbi for one word by the pieces' texts."""
        get, best, back = self.by_text.get, [0.0], [(0, -1)]
        for end in range(1, len(word) + 1):
            top = (-np.inf, 0, -1)
            for s in range(max(0, end - self.longest), end):
                p, score = get(word[s:end]) or (-1, self.unknown_score if end - s == 1 else -np.inf)
                if best[s] + score > top[0]:
                    top = (best[s] + score, s, p)
            best.append(top[0])
            back.append(top[1:])
        ids, e = [], len(word)
        while e:
            s, p = back[e]
            ids.extend([p] if p >= 0 else self.byte_id[list(word[s:e].encode("utf-8", "replace"))][::-1].tolist())
            e = s
        return ids[::-1]

    def learn(self, words: set[str]) -> None:
        by_length = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for length, ws in by_length.items():
            if length > LONG and len(ws) < FEW:
                self.known.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w in ws for ids in [self._single(w)])
                continue
            step = max(1, CELLS // (length * min(length, self.longest)))
            for lo in range(0, len(ws), step):
                part = ws[lo : lo + step]
                self.known.update(zip(part, self._batch(part, length)))
        self.held += sum(160 + 2 * len(w) + len(self.known[w]) for w in words)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of many texts; their new words are learned together."""
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        known = self.known
        split = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*split).difference(known))
        return [np.frombuffer(b"".join([known[w] for w in ws]), "<u4") for ws in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process, so that words stay known from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(Pieces.read(path))
    return _codecs[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of its whole text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                found = c.encode_all([t or "" for t in b.column(1).to_pylist()])
                yield pa.record_batch([b.column(0), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give the empty text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes and decodes every whole text: count and CRC-32 of the ids, hash of the decoded text, and whether it is the text."""
    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in (w.slice(lo, TEXTS) for w in batches for lo in range(0, w.num_rows, TEXTS)):
            cols: list[list] = [[], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for text, ids in zip(texts, c.encode_all(texts)):
                back = c.decode(ids)
                for col, v in zip(cols, (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text)):
                    col.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_())))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
