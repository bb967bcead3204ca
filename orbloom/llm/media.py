"""Media columns: signature sniffing, validation, carving, and lossless sample storage.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass.  A format's validator then
confirms structure and lengths and gives the object's end; only confirmed objects correct a declared type or are
carved out.  ``store`` writes a payload as 8-bit samples (mono WAV) and reads it back through the same sniffer.

Defined results: null content sniffs as ``empty``; content without a confirmed object at its start keeps its
declared type only if that type has no validator, else becomes ``unknown``; of objects found at one place the
longest counts, and objects inside a carved one are not carved again; equal contents get equal values; repeated
rows stay repeated; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbloom.llm._arrow import tidy, utf8

UNIT = 64
SAMPLE_RATE = 8000


# --- validators: (content, start) -> end of the object, or -1 -----------------------------------------------------


class Content(bytes):
    """Bytes with what several validators ask for, each looked up once.

    Formats that are chains of sized parts (boxes, pages, blocks, segments) are walked through ``walk``: what stands
    behind a place is the same for all objects that reach it, so no place is walked twice.
    """

    @cached_property
    def walked(self) -> dict:
        return {}

    def walk(self, name: str, p: int, step: Callable[[int], tuple], join: Callable):
        """The result of place p: ``step`` gives (value, None) at an end, else (own part, next place); ``join`` adds a part to the result behind it."""
        memo, way = self.walked.setdefault(name, {}), []
        while p not in memo:
            value, following = step(p)
            if following is None:
                memo[p] = value
                break
            way.append((p, value))
            p = following
        out = memo[p]
        for place, value in reversed(way):
            out = memo[place] = join(value, out)
        return out

    @cached_property
    def riff_chunks(self) -> dict[int, tuple[int, int, int, int]]:
        """By place of a chunk that follows a RIFF head, directly or later: the span of its numbers in a depth-first walk, and where the next fmt and data chunks are."""
        nxt: dict[int, int] = {}
        for m in re.finditer(b"RIFF", self):
            p = m.start() + 12
            while p not in nxt and p + 8 <= len(self):
                size = struct.unpack_from("<I", self, p + 4)[0]
                nxt[p] = p = p + 8 + size + (size & 1)
        before: dict[int, list[int]] = {}
        for q, p in nxt.items():
            before.setdefault(p, []).append(q)
        out: dict[int, tuple[int, int, int, int]] = {}
        far, number = len(self) + 1, 0
        for end in [p for p in before if p not in nxt]:
            stack = [(end, far, far, False)]
            first: dict[int, tuple[int, int, int]] = {}
            while stack:
                p, fmt, data, done = stack.pop()
                if done:
                    out[p] = (first[p][0], number, *first[p][1:])
                    continue
                kind = self[p : p + 4] if p in nxt else b""
                fmt, data = (p if kind == b"fmt " else fmt), (p if kind == b"data" else data)
                number += 1
                first[p] = (number, fmt, data)
                stack.append((p, fmt, data, True))
                stack.extend((q, fmt, data, False) for q in before.get(p, ()))
        return out

    @cached_property
    def jpeg_marks(self) -> list[int]:
        """Places of markers that end coded data."""
        return [m.start() for m in re.finditer(rb"\xff(?=[^\x00\xd0-\xd7])", self, re.DOTALL)]

    @cached_property
    def pdf_ends(self) -> list[tuple[int, int, int]]:
        """Place of each ``startxref``, the offset that it gives, and the end of the %%EOF behind it."""
        return [(m.start(), int(m[1]), m.end()) for m in _STARTXREF.finditer(self)]

    @cached_property
    def pdf_heads(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-\d", self)]

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start of an archive, as its end record tells it, and its end."""
        out: dict[int, int] = {}
        at = self.find(b"PK\x05\x06")
        while at >= 0 and at + 22 <= len(self):
            size, first, note = struct.unpack_from("<IIH", self, at + 12)
            directory = at - size
            if directory - first >= 0 and self[directory : directory + 4] in (b"PK\x01\x02", b"PK\x05\x06") and at + 22 + note <= len(self):
                out.setdefault(directory - first, at + 22 + note)
            at = self.find(b"PK\x05\x06", at + 1)
        return out


def _wav(b: Content, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return -1
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return -1
    head, tail = b.riff_chunks.get(at + 12), b.riff_chunks.get(end)
    # The chunks lead to the end if its numbers hold that of the first one; both kinds stand before it.
    return end if head and tail and tail[0] <= head[0] <= tail[1] and max(head[2:]) < end else -1


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size = struct.unpack_from(">I", b, p)[0]
        kind = b[p + 4 : p + 8]
        if p + 12 + size > len(b) or first and (kind != b"IHDR" or size != 13):
            return -1
        if zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return -1
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p
    return -1


def _gif(b: Content, at: int) -> int:
    if len(b) < at + 13:
        return -1

    def block(p: int) -> tuple:
        if p >= len(b) or p < 0:
            return -1, None
        return (p + 1, None) if not b[p] else (0, p + 1 + b[p])

    def blocks(p: int) -> int:
        return b.walk("gif blocks", p, block, lambda _, end: end)

    def part(p: int) -> tuple:
        if not 0 <= p < len(b):
            return (-1, False), None
        if b[p] == 0x3B:
            return (p + 1, False), None
        if b[p] == 0x21:
            return False, blocks(p + 2)
        if b[p] == 0x2C and p + 10 < len(b):
            return True, blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0))
        return (-1, False), None

    flags = b[at + 10]
    end, image = b.walk("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), part, lambda own, rest: (rest[0], own or rest[1]))
    return end if image else -1


def _jpeg(b: Content, at: int) -> int:
    def segment(p: int) -> tuple:
        if p + 4 > len(b) or b[p] != 0xFF:
            return (-1, False), None
        m = b[p + 1]
        if m == 0xFF:
            return False, p + 1
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or p + 2 + size > len(b):
            return (-1, False), None
        q = p + 2 + size
        if m == 0xDA:
            k = bisect_left(b.jpeg_marks, q)
            if k == len(b.jpeg_marks):
                return (-1, False), None
            q = b.jpeg_marks[k]
            if b[q + 1] == 0xD9:
                return (q + 2, False), None
        return 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC), q

    end, frame = b.walk("jpeg", at + 2, segment, lambda own, rest: (rest[0], own or rest[1]))
    return end if frame else -1


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return -1
    size, reserved, data, header = struct.unpack_from("<IIII", b, at + 2)
    ok = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= data <= size and at + size <= len(b)
    return at + size if ok else -1


_STARTXREF = re.compile(rb"startxref\s{1,8}(\d{1,18})\s{1,8}%%EOF")
_XREF = re.compile(rb"\s{0,8}(?:xref\b|\d{1,10}\s{1,8}\d{1,5}\s{1,8}obj\b)")


def _pdf(b: Content, at: int) -> int:
    """Ends at the first %%EOF whose cross-reference table is where it says, or at that of a later update."""
    if not b[at + 5 : at + 6].isdigit():
        return -1
    following = bisect_right(b.pdf_heads, at)
    limit = b.pdf_heads[following] if following < len(b.pdf_heads) else len(b)
    end = -1
    for k in range(bisect_left(b.pdf_ends, (at,)), len(b.pdf_ends)):
        place, offset, stop = b.pdf_ends[k]
        if place >= limit:
            break
        fits = at + offset < place and _XREF.match(b, at + offset)
        if end < 0 and fits or end >= 0 and fits and at + offset >= end:
            end = stop
        elif end >= 0:
            break
    return end


def _gzip(b: bytes, at: int) -> int:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return -1
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return -1
    return min(p, len(b)) - len(d.unused_data) if d.eof else -1


def _zip(b: Content, at: int) -> int:
    return b.zip_ends.get(at, -1) if len(b) >= at + 30 else -1


@lru_cache(maxsize=2)
def _crc_table(bits: int, polynomial: int) -> list[int]:
    top, out = 1 << (bits - 1), []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial) if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return out


def _flac_frame(b: bytes, p: int) -> tuple[int, int]:
    """Bytes of the frame header at p and samples of its block; 0, 0 if its checksum or a field is wrong."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return 0, 0
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    if not size or rate == 15:
        return 0, 0
    first, q = b[p + 4], p + 5
    while first & 0x80 and first & 0x40:  # the number is coded as in UTF-8
        first, q = first << 1, q + 1
    n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << max(0, size - 8)
    if size in (6, 7):
        wide = size - 5
        n, q = int.from_bytes(b[q : q + wide], "big") + 1, q + wide
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if q >= len(b):
        return 0, 0
    crc, table = 0, _crc_table(8, 0x07)
    for x in b[p:q]:
        crc = table[crc ^ x]
    return (q + 1 - p, n) if crc == b[q] else (0, 0)


def _flac(b: Content, at: int) -> int:
    """Ends behind the last frame whose checksum holds, once all samples that the stream promises are there."""
    p = at + 4
    if len(b) < p + 38 or b[p] & 0x7F or int.from_bytes(b[p + 1 : p + 4], "big") != 34:
        return -1
    promised = int.from_bytes(b[p + 17 : p + 22], "big") & ((1 << 36) - 1)

    def block(p: int) -> tuple:
        if p + 4 > len(b):
            return -1, None
        following = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
        return (following, None) if b[p] >> 7 else (0, following)

    p = b.walk("flac", p, block, lambda _, end: end)
    if p < 0:
        return -1
    samples, table = 0, _crc_table(16, 0x8005)
    head, n = _flac_frame(b, p)
    while head:
        samples += n
        crc, q, following = 0, p, (0, 0)
        for x in memoryview(b)[p:]:
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ x]
            q += 1
            if not crc and q - p > head:
                following = _flac_frame(b, q)
                if following[0] or samples >= promised:
                    break
        else:
            return -1
        p, (head, n) = q, following
    return p if samples else -1


def _ogg(b: Content, at: int) -> int:
    def page(p: int) -> tuple:
        if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4]:
            return p, None
        size = 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        if p + size > len(b):
            return -1, None
        return (p + size, None) if b[p + 5] & 4 else (0, p + size)

    end = b.walk("ogg", at, page, lambda _, end: end)
    return end if end > at else -1


def _mp4(b: Content, at: int) -> int:
    if at < 4:
        return -1

    def box(p: int) -> tuple:
        size, kind = (struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]) if p + 8 <= len(b) else (0, b"")
        if size < 8 or p + size > len(b) or not kind.isalnum():
            return (p, False, False), None
        return (kind == b"ftyp", kind in (b"moov", b"mdat", b"meta")), p + size

    end, typed, filled = b.walk("mp4", at - 4, box, lambda own, rest: (rest[0], own[0] or rest[1], own[1] or rest[2]))
    return end if typed and filled else -1


# Magic bytes, where in the object they stand, and media types.
SIGNATURES: dict[bytes, tuple[str, int, Callable[[bytes, int], int]]] = {
    b"RIFF": ("audio/wav", 0, _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", 0, _png),
    b"GIF87a": ("image/gif", 0, _gif),
    b"GIF89a": ("image/gif", 0, _gif),
    b"\xff\xd8\xff": ("image/jpeg", 0, _jpeg),
    b"BM": ("image/bmp", 0, _bmp),
    b"%PDF-": ("application/pdf", 0, _pdf),
    b"\x1f\x8b\x08": ("application/gzip", 0, _gzip),
    b"PK\x03\x04": ("application/zip", 0, _zip),
    b"fLaC": ("audio/flac", 0, _flac),
    b"OggS": ("audio/ogg", 0, _ogg),
    b"ftyp": ("video/mp4", 4, _mp4),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in SIGNATURES:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def confirmed(content: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of all objects whose validators agree, outermost only, in order."""
    content = Content(content)
    places = sorted((last + 1 - len(magic) - SIGNATURES[magic][1], magic) for last, magic in _automaton().iter(content.decode("latin-1")))
    out: list[tuple[int, int, str]] = []
    for start, magic in places:
        if start < 0 or out and out[-1][0] < start < out[-1][1]:
            continue
        kind, shift, check = SIGNATURES[magic]
        end = check(content, start + shift)
        if end <= start:
            continue
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
        elif (end, out[-1][2]) > (out[-1][1], kind):
            out[-1] = (start, end, kind)
    return out


def sniff(content: bytes | None, declared: str | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The corrected type, and the objects embedded behind the first byte or after the first object."""
    if not content:
        return "empty", []
    found = confirmed(content)
    if found and found[0][0] == 0:
        return found[0][2], found[1:]
    if declared and declared not in {k for k, _, _ in SIGNATURES.values()}:
        return declared, found
    return "unknown", found


def carve(df: DataFrame, key: str, content: str, declared: str | None = None) -> DataFrame:
    """One row per confirmed object: key, declared and corrected type of the whole, and the object with its place."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, declared string, sniffed string, object int, start bigint, length bigint, media_type string, media binary"
    cols = [df[key].alias(key), df[content].cast("binary").alias("content"), (df[declared] if declared else df[key].cast("string")).alias("declared")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                d = d if declared else None
                kind, inner = sniff(c, d)
                whole = [x for x in confirmed(c) if x[0] == 0] if c else []
                for i, (lo, hi, t) in enumerate(whole[:1] + inner):
                    rows.append({key: k, "declared": d, "sniffed": kind, "object": i, "start": lo, "length": hi - lo, "media_type": t, "media": c[lo:hi]})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([b.schema.field(0).with_name(key), ("declared", pa.string()), ("sniffed", pa.string()), ("object", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("media", pa.binary())])).to_batches()

    return df.select(*cols).mapInArrow(run, schema)


# --- lossless storage as 8-bit samples -----------------------------------------------------------------------------


def to_samples(payload: bytes) -> bytes:
    """Mono 8-bit WAV; the payload's bytes are the samples."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def from_samples(stored: bytes) -> bytes:
    """The samples of a WAV that the sniffer confirms."""
    end = _wav(Content(stored), 0) if stored[:4] == b"RIFF" else -1
    if end < 0:
        raise ValueError("not a complete WAV")
    p = 12
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", stored, p)
        if kind == b"data":
            return stored[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(content: bytes) -> bytes:
    return content + b"\0" * (max(1, math.ceil(len(content) / UNIT)) * UNIT - len(content))


def describe(stored: bytes, declared: str) -> tuple[bytes, str]:
    """Reads a stored form back: its payload, and its features as text."""
    kind, _ = sniff(stored, declared)
    payload = from_samples(stored)
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.float32) - 128
    rms = math.sqrt(float(np.square(level).sum(dtype=np.float64)) / len(x))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    inner = confirmed(payload)
    carved = ",".join(f"{t}@{lo}+{hi - lo}" for lo, hi, t in inner) or "none"
    return payload, f"type={kind};samples={len(x)};min={x.min()};max={x.max()};mean={x.mean():.4f};rms={rms:.4f};crossings={crossings};embedded={carved}"


def store(docs: DataFrame, declared: str = "text/plain") -> DataFrame:
    """Every whole text as padded UTF-8, stored as 8-bit samples, read back and described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            cols: list[list] = [[] for _ in names]
            for i, doc in enumerate(b.column(0).to_pylist()):
                content = data[off[i] : off[i + 1]].tobytes()
                media = to_samples(padded(content))
                payload, feature = describe(media, declared)
                for c, v in zip(cols, (doc, len(content), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
