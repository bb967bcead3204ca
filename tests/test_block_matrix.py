"""The binary block matrix source against a writer of its own."""

import struct

import numpy as np
import pytest

from orbloom.operators import filters
from orbloom.sources import block_matrix as B


def written(path, lmax, lmin=2, version="2.4", order="<", kind=b"BDFULLV0", spoil=None):
    """The published layout, written field by field; gives the blocks in file order."""
    rng = np.random.default_rng(lmax)
    v = float(version)
    names = [(0, 0)] + [(m, cs) for m in range(1, lmax + 1) for cs in (0, 1)]
    blocks = [(m, cs, max(lmin, m), rng.normal(size=(lmax - max(lmin, m) + 1,) * 2)) for m, cs in names]
    ends = np.cumsum([len(b[3]) for b in blocks])
    side = int(ends[-1])
    pack = np.concatenate([b[3].ravel(order="F") for b in blocks])
    out = struct.pack(f"{order}H", 18754) + f"NV{version:<4}".encode() + kind.ljust(8) + b"a filter".ljust(80)
    out += struct.pack(f"{order}4I", 2, 1, side, side)
    out += struct.pack(f"{order}2{'I' if v < 2.4 else 'Q'}", len(pack), 0)
    if v > 2.1:
        out += struct.pack(f"{order}2i", 1, 2)
    out += struct.pack(f"{order}i", len(blocks))
    if v > 2.1:
        out += b"note one".ljust(80) + b"note two".ljust(80)
    out += b"Lmax".ljust(24) + b"Lmin".ljust(24) + struct.pack(f"{order}2{'i' if v <= 2.4 else 'q'}", lmax, lmin)
    out += b"scale".ljust(24) + struct.pack(f"{order}d", 1.5)
    out += b"".join(f"C {k}".encode().ljust(24) for k in range(side))
    out += struct.pack(f"{order}{len(ends)}i", *(int(e) for e in ends))
    if kind in (b"BDFULLV0", b"BDFULLVN") and v > 2.2:
        out += b"".join(f"D {k}".encode().ljust(24) for k in range(side))
    if v > 2.1:
        out += struct.pack(f"{order}{side}d", *range(side))
    out += pack.astype(f"{order}f8").tobytes()
    path.write_bytes(spoil(out) if spoil else out)
    return blocks


def expected(blocks, nmax=99):
    return {(m, cs, n + i, n + j): w[i, j] for m, cs, n, w in blocks for i in range(len(w)) for j in range(len(w)) if n + max(i, j) <= nmax}


def rows(df):
    return {(r.m, r.cs, r.n_row, r.n_col): r.w for r in df.collect()}


@pytest.mark.parametrize("version, order, kind", [("2.1", "<", b"BDFULLV0"), ("2.2", "<", b"BDFULLV0"), ("2.3", ">", b"BDFULLVN"), ("2.4", "<", b"BDFULLV0"), ("2.5", ">", b"BDSYMV0")])
def test_every_known_version_is_read(spark, tmp_path, version, order, kind):
    blocks = written(tmp_path / "w", 6, version=version, order=order, kind=kind)
    df = B.read_block_matrix(spark, str(tmp_path / "w"))
    assert df.rdd.getNumPartitions() == 13
    assert rows(df) == expected(blocks)
    assert rows(B.read_block_matrix(spark, f"file://{tmp_path}/w", 4)) == expected(blocks, 4)


def test_filters_reach_the_file(spark, tmp_path):
    blocks = written(tmp_path / "w", 8)
    df = B.read_block_matrix(spark, str(tmp_path / "w"))
    part = df.where("m <= 3 AND cs = 1 AND n_row <= 5 AND n_col < 6")
    assert part.rdd.getNumPartitions() == 3  # S of orders 1 to 3
    assert rows(part) == {k: v for k, v in expected(blocks, 5).items() if k[0] <= 3 and k[1] == 1}

    class Counted:
        def __init__(self, source):
            self.source, self.bytes, self.size = source, 0, source.size

        def read_at(self, n, at):
            self.bytes += n
            return self.source.read_at(n, at)

    reader = B.BlockMatrixReader(str(tmp_path / "w"), {"nmax": "5"})
    with B.opened(str(tmp_path / "w")) as source:
        for b in reader.partitions():
            seen = Counted(source)
            k = 5 - b.first + 1
            assert B.read_block(seen, b).shape == (k, k) and seen.bytes == 8 * k * b.size


def test_what_cannot_be_right_is_refused(tmp_path):
    def head(**kw):
        written(tmp_path / "x", 5, **kw)
        with B.opened(str(tmp_path / "x")) as source:
            return B.read_head(source)

    assert head()[0] == 5
    for spoil, word in [(lambda b: b"XX" + b[2:], "byte-order"), (lambda b: b[:4] + b"9.9 " + b[8:], "version"), (lambda b: b[:-8], "cut short"), (lambda b: b[:100], "head ends"), (lambda b: b.replace(b"Lmax", b"Lxxx"), "largest degree")]:
        with pytest.raises(ValueError, match=word):
            head(spoil=spoil)
    with pytest.raises(ValueError, match="block-diagonal"):
        head(kind=b"FULLSQV0")
    with pytest.raises(ValueError, match="rows"):
        head(spoil=lambda b: b.replace(struct.pack("<2i", 5, 2), struct.pack("<2i", 6, 2)))


def test_blocks_filter_coefficients(spark, tmp_path):
    blocks = written(tmp_path / "w", 4)
    rng = np.random.default_rng(0)
    coef = [(0, n, m, cs, float(rng.normal()), 0.1) for n in range(5) for m in range(n + 1) for cs in ((0, 1) if m else (0,))]
    df = spark.createDataFrame(coef, "set_id long, n int, m int, cs int, v double, s double")
    got = {(r.n, r.m, r.cs): r.v for r in filters.block_filter(df, B.read_block_matrix(spark, str(tmp_path / "w")), ["set_id"]).collect()}
    old = {(n, m, cs): v for _, n, m, cs, v, _ in coef}
    for m, cs, first, w in blocks:
        new = w @ np.array([old[n, m, cs] for n in range(first, 5)])
        assert all(abs(got[first + i, m, cs] - v) < 1e-12 for i, v in enumerate(new))
    assert got[1, 0, 0] == old[1, 0, 0]


def test_filters_by_name(spark, tmp_path):
    blocks = written(tmp_path / filters.DDK_FILES[2], 4)
    rng = np.random.default_rng(0)
    coef = [(0, n, m, cs, float(rng.normal()), 0.1) for n in range(5) for m in range(n + 1) for cs in ((0, 1) if m else (0,))]
    df = spark.createDataFrame(coef, "set_id long, n int, m int, cs int, v double, s double")
    old = {(n, m, cs): v for _, n, m, cs, v, _ in coef}
    got = {(r.n, r.m, r.cs): r.v for r in filters.filtered(df, "DDK3", 4, ["set_id"], str(tmp_path)).collect()}
    m, cs, first, w = blocks[0]
    assert np.allclose([got[n, 0, 0] for n in range(first, 5)], w @ [old[n, 0, 0] for n in range(first, 5)])
    assert {(r.n, r.m, r.cs): r.v for r in filters.filtered(df, "none", 4, ["set_id"]).collect()} == old
    g = filters.gaussian_weights(4, 300.0)
    assert all(abs(r.v - old[r.n, r.m, r.cs] * g[r.n]) < 1e-15 for r in filters.filtered(df, "gauss300", 4, ["set_id"]).collect())
    for bad in ("DDK9", "DDK12", "gauss", "gauss-3", "box"):
        with pytest.raises(ValueError, match="unknown"):
            filters.filtered(df, bad, 4, ["set_id"], str(tmp_path))
    with pytest.raises(ValueError, match="folder"):
        filters.filtered(df, "DDK1", 4, ["set_id"])
