"""WARC archives of pages: one gzip member per record, written by Spark and read back one member after the other.

Writing: pages with equal payloads (SHA-256 and length) of at least ``LEAST_REVISIT`` bytes share one response record,
that of the largest page_id; the others become revisit records, which name it and hold no payload.  Which pages are
revisits is decided on narrow rows; the html is shuffled once, to meet the decision.  Tasks gather records into
archives of about ``ARCHIVE_BYTES`` compressed bytes, and Spark's own writer stores each archive as one file: its
commit protocol holds for lost executors, and any store that Spark can write to will do.  Every archive ends with an
empty gzip member, so a file that was cut short shows.

Reading: an archive is read front to back by incremental zlib decompression, a piece at a time.  The record's head
says how long its block is (Content-Length); block and trailing line breaks must fill the member exactly; the
SHA-1 of block and payload must be those of the head.  What fails is reported in ``fault``, not dropped: a damaged
member costs its own record, and reading goes on at the next member that starts with a WARC version.

Defined results: a null html is an empty payload; a null url leaves WARC-Target-URI out; white space, control and
non-ASCII characters of a url are percent-encoded, so none can end a header line; a null page_id is written as an empty
id, read as null, and is smaller than all others; rows that share the largest page_id of a group of equal payloads are
all responses; other repeated rows are records each; an empty table gives archives without records; further columns
of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbloom.llm._arrow import _written, saved, shared_folder, tidied, tidy

LEAST_REVISIT = 1000  # bytes of the smallest payload that a revisit can stand for
ARCHIVE_BYTES = 32 << 20  # compressed bytes, beyond which an archive is closed
PIECE = 1 << 16  # compressed bytes that are inflated at once
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # pages carry no date

# Fixed values of the format: version line, line break, revisit profile, gzip magic, the empty gzip member.
VERSION = b"WARC/1.1"
BREAK = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
END = bytes.fromhex("1f8b08000000000000ff03000000000000000000")

ROW = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("fault", pa.string())]
)
SCHEMA = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, archive string, offset bigint, fault string"


def sha1(data) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, compressed to a member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: {sha1(payload)}", f"WARC-Block-Digest: {sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([pack.compress("\r\n".join(head).encode() + BREAK + BREAK), pack.compress(block), pack.compress(BREAK + BREAK), pack.flush()])


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


class _Block:
    """Checks a record as its bytes come: head, block of the stated length, digests."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.block, self.tail = bytearray(), None, 0, bytearray(), bytearray()

    def add(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if (at := self.head.find(BREAK + BREAK)) < 0:
                return
            data = bytes(self.head[at + 4 :])
            lines = bytes(self.head[:at]).split(BREAK)
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("no WARC version")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
            if not re.fullmatch(r"\d+", self.fields.get("content-length", "")):
                raise ValueError("no Content-Length")
            self.left = int(self.fields["content-length"])
        self.block += data[: self.left]
        self.tail += data[self.left :]
        self.left -= min(self.left, len(data))
        if len(self.tail) > 4:
            raise ValueError("more than Content-Length")

    def row(self, archive: str, offset: int) -> dict:
        if self.fields is None or self.left:
            raise ValueError("less than Content-Length")
        if bytes(self.tail) != BREAK + BREAK:
            raise ValueError("no end of record")
        f, kind = self.fields, self.fields.get("warc-type")
        at = self.block.find(BREAK + BREAK) if f.get("content-type", "").startswith("application/http") else -4
        http, payload = self.block[: max(at, 0)], bytes(memoryview(self.block)[max(at + 4, 0) :])
        fault = None
        if (stated := f.get("warc-block-digest")) and stated != sha1(self.block):
            fault = "block digest"
        elif (stated := f.get("warc-payload-digest")) and kind == "response" and stated != sha1(payload):
            fault = "payload digest"
        size = len(payload)
        if kind == "revisit":
            m = re.search(rb"(?i)^content-length:\s*(\d+)\s*$", http, re.MULTILINE)
            size, payload = (int(m[1]) if m else None), None
        stated = f.get("warc-payload-digest", "")
        digest = base64.b32decode(stated[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", stated) else None
        found = {"record_id": f.get("warc-record-id"), "page_id": _number(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": kind, "refers_to": _number(f.get("warc-refers-to"))}
        return found | {"payload_bytes": size, "payload_digest": digest, "payload": payload, "archive": archive, "offset": offset, "fault": fault}


def read_members(data, archive: str = "") -> Iterator[dict]:
    """The records of one archive in order, each inflated ``PIECE`` bytes at a time; see the module on faults."""
    data, at, ended = memoryview(data), 0, False
    while at < len(data):
        begin, inflate, block, size = at, zlib.decompressobj(31), _Block(), 0
        try:
            while not inflate.eof:
                piece = data[at : at + PIECE]
                if not len(piece):
                    raise ValueError("archive cut short")
                out = inflate.decompress(piece)
                at += len(piece) - len(inflate.unused_data)
                size += len(out)
                block.add(out)
            ended = size == 0
            if size:
                yield block.row(archive, begin)
        except (ValueError, zlib.error) as e:
            yield dict.fromkeys(ROW.names) | {"archive": archive, "offset": begin, "fault": str(e)[:200]}
            at = _next_member(data, begin + 1)
    if len(data) and not ended:
        yield dict.fromkeys(ROW.names) | {"archive": archive, "offset": len(data), "fault": "no end member"}


def _next_member(data: memoryview, at: int) -> int:
    """Where the next member that holds a WARC record or nothing starts, or the end."""
    for m in re.compile(re.escape(MAGIC)).finditer(data, at):
        piece = bytes(data[m.start() : m.start() + PIECE])
        try:
            first = zlib.decompressobj(31).decompress(piece, 8)
        except zlib.error:
            continue
        if first.startswith(b"WARC/") or piece.startswith(END):
            return m.start()
    return len(data)


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("same"), F.octet_length(html).alias("size"))


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id and payload hash of the revisits, once each, and the response that they refer to."""
    narrow = _keyed(pages).where(F.col("size") >= least).select("page_id", "same", "size")
    # One row for each task and payload is shuffled, so a group of copies of any size is no hot key here.
    groups = narrow.groupBy("same", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    # Written first, so that the join deals out both sides anew and can split a hot payload over tasks.
    groups = saved(groups.select("same", "size", "top"), "equal-payloads")
    others = narrow.distinct().join(groups, ["same", "size"])
    return others.where("not (page_id <=> top)").select(F.col("page_id").alias("of_page"), F.col("same").alias("of_same"), "top")


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives of all pages to a new folder."""
    rows = _keyed(pages)
    others = _revisits(pages, least)
    met = rows.join(others, (rows["same"] == others["of_same"]) & rows["page_id"].eqNullSafe(others["of_page"]), "left")
    revisit = F.col("of_same").isNotNull()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            ids, urls, texts, again, tops = batch.columns
            for k in range(batch.num_rows):
                payload = texts[k].as_buffer()
                held.append(record(ids[k].as_py(), urls[k].as_py(), payload.to_pybytes() if payload is not None else b"", tops[k].as_py(), again[k].as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    archives = met.select("page_id", "url", F.col("html").cast("binary"), revisit.alias("revisit"), "top").mapInArrow(run, "value binary")
    # The text writer stores bytes as they are; its line end is the empty member that closes an archive.
    out = archives.select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, with payloads of responses, place and fault."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for row in read_members(batch.column(1)[k].as_buffer(), batch.column(0)[k].as_py()):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 1 << 22 or len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, ROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def new_folder(spark: SparkSession) -> str:
    """A folder for archives in the shared folder; ``_arrow.discard`` deletes it."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Every page through the archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to, fault."""
    spark = pages.sparkSession
    path = new_folder(spark)
    write(pages, path, least)
    tidied(spark)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")
