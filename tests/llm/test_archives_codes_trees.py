"""WARC archives, vector codes and Merkle manifests against brute force, with damaged and awkward inputs."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.llm import _arrow, jaccard_join, media, merkle, substring_dedup, vector_codes, warc

PAGES = "page_id long, url string, html string, record string, top long, same string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def test_warc_round_trip_and_revisits(spark):
    long = "é" * 700
    rows = [(1, "http://a/", long), (2, None, long), (5, "http://a/b c\r\nWARC-Type: x", long), (3, "", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 2_000_000), (9, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", long)]
    got = {r.page_id: r for r in warc.archived(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        b = (html or "").encode()
        copy = html == long and key != 5
        assert (got[key].payload_bytes, got[key].payload_digest, got[key].record_type, got[key].refers_to, got[key].fault) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if copy else "response", 5 if copy else None, None)


def test_warc_repeated_rows_and_empty_table(spark):
    long = "z" * 1000
    got = warc.archived(pages(spark, [(1, "u", long), (3, "u", long), (3, "u", long), (1, "u", long)])).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 3), (1, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert warc.archived(pages(spark, []).where("false")).count() == 0


def test_warc_archives_are_gzip_members_of_one_record(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    warc.write(pages(spark, [(k, f"http://h/{k}", f"page {k} " * 500) for k in range(40)]), folder, archive_bytes=2000)
    files = [b for (b,) in spark.read.format("binaryFile").load(folder).select("content").collect()]
    assert len(files) > 3 and all(bytes(f).endswith(warc.END) for f in files)
    plain = b"".join(gzip.decompress(bytes(f)) for f in files)
    assert plain.count(b"WARC/1.1\r\n") == 40
    rows = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert {k: bytes(r.payload) for k, r in rows.items()} == {k: (f"page {k} " * 500).encode() for k in range(40)}
    assert all(r.url == f"http://h/{k}" for k, r in rows.items())


def test_warc_reader_reports_damage_and_goes_on():
    members = [warc.record(k, "u", f"payload {k}".encode() * 50) for k in range(4)]
    plain = gzip.decompress(members[1])
    whole = list(warc.read_members(b"".join(members) + warc.END))
    assert [r["page_id"] for r in whole] == [0, 1, 2, 3] and not any(r["fault"] for r in whole)

    def faults(second, end=warc.END):
        return [(r["page_id"], r["fault"]) for r in warc.read_members(members[0] + second + members[2] + members[3] + end)]

    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    got = faults(bytes(broken))
    assert [g for g in got if g[0] is not None] == [(0, None), (2, None), (3, None)] and got[1][1]
    assert faults(gzip.compress(plain.replace(b"payload 1payload 1", b"payload 1payload 2", 1)))[1] == (1, "block digest")
    wrong = plain.replace(warc.sha1(b"payload 1" * 50).encode(), warc.sha1(b"other").encode(), 1)
    assert faults(gzip.compress(wrong))[1] == (1, "payload digest")
    assert faults(gzip.compress(plain + b"more bytes"))[1] == (None, "more than Content-Length")
    assert faults(gzip.compress(plain[:-30]))[1][1] == "less than Content-Length"
    assert faults(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))[1][1] == "no WARC version"
    assert faults(members[1], b"")[-1] == (None, "no end member")
    assert list(warc.read_members(members[0][:-9]))[0]["fault"] == "archive cut short"


def codes_by_hand(q, parts=4, entries=256, rounds=4):
    cut = vector_codes.cuts(q.shape[1], parts)
    books = [q[:entries, a:b].copy() for a, b in cut]

    def nearest(x, c):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            w = nearest(q[:, a:b], books[p])[0]
            for j in range(len(books[p])):
                if (w == j).any():
                    books[p][j] = q[w == j, a:b].sum(axis=0) // (w == j).sum()
    found = [nearest(q[:, a:b], books[p]) for p, (a, b) in enumerate(cut)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found), books


VECTORS = "vec_id long, embedding array<float>, label int, code string, q int"


@pytest.mark.parametrize("n", [5, 700])
def test_vector_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 12)), 1)  # coarse, so that distances tie
    x[n // 2] = x[0]
    rows = [(k * 3, [float(v) for v in r], None if k % 7 == 0 else k % 3, "c", 1) for k, r in enumerate(x)]
    bad = [(10_000, None, 1, "", 0), (10_001, [], 1, "", 0), (10_002, [1.0] * 11 + [None], 1, "", 0), (10_003, [float("nan")] * 12, 1, "", 0), (10_004, [float("inf")] + [0.0] * 11, 1, "", 0), (10_005, [1.0] * 8, 1, "", 0)]
    got = {r.vec_id: r for r in vector_codes.report(spark.createDataFrame(rows + bad, VECTORS)).collect()}
    q = np.floor(1024 * np.float32(x).astype(float)).astype(np.int64)
    which, error, books = codes_by_hand(q)
    labels = [r[2] for r in rows]
    sums = {v: int(sum(e for e, w in zip(error, labels) if w == v)) for v in set(labels)}
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    assert {k: (r.code, r.error, r.label_error, r.codebooks_sha256) for k, r in got.items()} == {3 * k: ("".join(f"{v:02x}" for v in which[k]), int(error[k]), sums[labels[k]], sha) for k in range(n)}


def test_vector_codes_odd_tables(spark):
    assert vector_codes.report(spark.createDataFrame([], VECTORS)).count() == 0
    huge = [(k, [3e38 if k % 2 else -3e38, 1.0, 2.0, 3.0, 4.0], 1, "", 0) for k in range(6)]
    got = vector_codes.report(spark.createDataFrame([*huge, huge[0], (None, *huge[1][1:])], VECTORS)).collect()
    assert len(got) == 8 and all(r.error == 0 and len(r.code) == 8 for r in got)


@pytest.mark.parametrize("scale", [1, 40, 2**20, 2**26])
def test_screen_never_loses_the_nearest_entry(scale):
    rng = np.random.default_rng(scale)
    for length in (1, 7, 16):
        c = rng.integers(-scale, scale + 1, (256, length))
        c[100:110] = c[5]  # ties
        x = np.concatenate([rng.integers(-scale, scale + 1, (500, length)), c[:40], (c[:100] + c[100:200]) // 2])
        book = vector_codes.Codebook(c)
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        near, slack = vector_codes.screen(x, book)
        square = (x * x).sum(axis=1, keepdims=True)
        assert all(abs(int(e) - int(s) - int(v)) <= h + 1 for e, s, v, h in zip(exact.ravel().tolist(), np.broadcast_to(square, exact.shape).ravel().tolist(), near.ravel().tolist(), slack.ravel().tolist()))
        which, error, measured = vector_codes.assign(x, book)
        assert (which == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all() and measured >= len(x)


def test_vector_codes_come_back_near(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=8)], 1, "", 0) for k in range(300)], VECTORS)
    codes, books = vector_codes.compress(df)
    back = {r.vec_id: r for r in vector_codes.decompress(codes, books).collect()}
    for r in df.collect():
        q = np.floor(1024 * np.float32(r.embedding).astype(float))
        assert abs(((np.array(back[r.vec_id].vector) * 1024 - q) ** 2).sum() - back[r.vec_id].error) < 1e-6


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree long, place long, digest string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def trees_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)

    def tree(level):
        paths, own, level = [[] for _ in level], list(range(len(level))), list(level)
        while len(level) > 1:
            for k, p in enumerate(paths):
                run = level[own[k] // 8 * 8 : own[k] // 8 * 8 + 8]
                p.append((run[: own[k] % 8], run[own[k] % 8 + 1 :]))
                own[k] //= 8
            level = [H(level[k : k + 8]) for k in range(0, len(level), 8)]
        return level[0], paths

    made = [(rs, *tree([leaf(r, r[1]) for r in rs])) for rs in by.values()]
    root, above = tree([m[1] for m in made])
    out = []
    for (rs, subroot, paths), top in zip(made, above):
        for r, path in zip(rs, paths):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            own = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if bent else r[1])
            for before, after in path + top:
                own = H([*before, own, *after])
            out.append((r[0], leaf(r, r[1]), subroot, root, H(x for b, a in path + top for x in b + a), own, own == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["mixed", "one language", "one row", "many languages"])
def test_merkle_manifest_equals_brute_force(spark, case):
    random.seed(4)
    if case == "mixed":
        rows = [(k, random.choice(["Abc É", "xyz", "", None, "Q" * 5000]), random.choice(["de", "en", "Ünd", None]), random.choice(["s", None]), random.choice([k, None])) for k in range(300)]
        rows += [(400 + k, "Lone", f"l{k}", "s", 1) for k in range(3)] + [(None, "NULL", "de", None, None)] + [rows[7]] * 12 + [(500, "A", "de", "s", 1), (500, "B", "de", "s", 1)]
    elif case == "one language":
        rows = [(k * 7, f"Text {k}", "en", "s", 5) for k in range(65)]
    elif case == "one row":
        rows = [(9, "Text", None, None, None)]
    else:
        rows = [(k, f"T{k}", f"lang-{k % 70}", "s", k) for k in range(150)]
    got = merkle.manifest(spark.createDataFrame([(*r, 1, 2, "d") for r in rows], DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == trees_by_hand(rows)


def test_merkle_paths_and_empty_table(spark):
    docs = spark.createDataFrame([(k, f"Text {k}", "en", "s", 5, 1, 2, "d") for k in range(30)], DOCS)
    for r in merkle.manifest(docs, keep_path=True).collect():
        assert merkle.fold(r.leaf, r.path) == r.root and merkle.proof(r.path) == r.proof_sha256
        assert merkle.fold("0" * 64, r.path) != r.root
    assert merkle.manifest(docs.where("false")).count() == 0


def test_all_validators_are_linear():
    import struct
    import time

    n = 1 << 20
    jpeg = b"\xff\xd8\xff\xe0\x00\x05\xff\xd8\xff"
    kinds = {
        "mp4": b"\0\0\0\x08ftyp", "gif": b"GIF89a" + bytes(7) + b"\x21\x00\x0dGIF89a" + bytes(7) + b"\0", "ogg": b"OggS" + bytes(23), "flac": b"fLaC\0\0\0\x22" + bytes(34) + b"\0\0\0\x04",
        "wav": b"data\x0c\0\0\0RIFF\x10\x20\x30\0WAVE", "jpeg": jpeg, "bmp": b"BM" + bytes(30), "pdf": b"%PDF-1 startxref\n5\n%%EOF ", "zip": b"PK\x03\x04" + bytes(30) + b"PK\x05\x06" + bytes(18),
    }
    for kind, junk in kinds.items():
        began = time.time()
        media.confirmed(junk * (n // len(junk)))
        assert time.time() - began < 10, kind
    riff = b"".join(b"data\x0c\0\0\0RIFF" + struct.pack("<I", n - 20 * k - 16) + b"WAVE" for k in range(n // 20))
    began = time.time()
    media.confirmed(riff)
    assert time.time() - began < 10


def test_wav_chunks_may_hold_a_wav():
    inner = media.to_samples(b"abcd" * 16)
    chunk = b"note" + len(inner).to_bytes(4, "little") + inner
    outer = bytearray(media.to_samples(b"x" * 64) + chunk)
    outer[4:8] = (len(outer) - 8).to_bytes(4, "little")
    assert media.confirmed(b"--" + bytes(outer) + b"--") == [(2, 2 + len(outer), "audio/wav")]
    outer[4:8] = (len(outer) - 7).to_bytes(4, "little")
    at = 2 + outer.index(inner, 20)
    assert media.confirmed(b"--" + bytes(outer)) == [(at, at + len(inner), "audio/wav")]
    assert media.confirmed(inner[:-1]) == []


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    schema = "doc_id long, text string, __doc long, __text string, __d int, __t int, row string, d int, t int, best int"
    rows = [(k, t, 1, "x", 2, 3, "r", 4, 5, 6) for k, t in [(1, text), (2, text), (2, text), (7, text + " z"), (8, "other words entirely"), (9, None), (9, None)]]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, schema))
    assert got.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((r.doc_id, r.row, r["__doc"], r["__t"]) for r in got.collect()) == [(1, "r", 1, 3), (8, "r", 1, 3), (9, "r", 1, 3), (9, "r", 1, 3)]


def test_repeated_rows_are_read_once(spark):
    from orbloom.llm import _repeats

    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text)] * 50 + [(2, text + " tail")], "doc_id long, text string")
    spec = substring_dedup.SPEC
    items = _repeats.keyed(docs).withColumn("n", F.lit(1).cast("long"))
    found = _repeats._anchor_rows(items, spec)
    wanted = _arrow.saved(found.groupBy("fp", "cover").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "p0", "p1")).alias("at")).select("fp", "cover", "n", "at.*", F.lit(False).alias("many")), "wanted")
    assert _repeats._covers(items, wanted, spec).count() == wanted.count()
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect()}
    assert got == {(1, 200, 200), (2, 201, 200)}
