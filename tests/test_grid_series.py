"""The netCDF grid source against a writer of its own: records, packing, fill values, bytes read."""

import struct

import numpy as np
import pytest

from orbloom.sources import grid_series as G


def written(path, t=12, lat=4, lon=6, version=1, record=True, packed=True, order=("time", "lat", "lon"), units="days since 2002-01-01T00:00:00Z", alone=False, name="lwe_thickness"):
    """Variables time, lat, lon, the grid and a second record variable, as the format's description lays them out."""
    rng = np.random.default_rng(t)
    n4 = lambda n: struct.pack(">Q" if version == 5 else ">I", n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: n4(len(s)) + pad(s.encode())
    codes = {"c": 2, "h": 3, "f": 5, "d": 6}

    def attributes(**kw):
        out = struct.pack(">I", 12 if kw else 0) + n4(len(kw))
        for k, (code, v) in kw.items():
            raw = v.encode() if code == "c" else struct.pack(f">{len(v)}{code}", *v)
            out += text(k) + struct.pack(">I", codes[code]) + n4(len(v)) + pad(raw)
        return out

    sizes = {"time": t, "lat": lat, "lon": lon}
    days = np.array([15.5 + 30 * k for k in range(t)])
    raw = rng.integers(-1000, 1000, [sizes[d] for d in order]).astype(">i2" if packed else ">f4")
    raw[2, 1, 1] = -32768 if packed else -999.0
    grid_att = {"scale_factor": ("d", [0.01]), "add_offset": ("d", [5.0]), "_FillValue": ("h", [-32768])} if packed else {"missing_value": ("f", [-999.0])}
    variables = [("lat", ["lat"], "d", attributes(units=("c", "degrees_north")), np.linspace(-60, 60, lat).astype(">f8")), ("lon", ["lon"], "d", attributes(), np.linspace(-90, 210, lon).astype(">f8")), (name, list(order), "h" if packed else "f", attributes(**grid_att), raw)]
    if not alone:
        variables.insert(0, ("time", ["time"], "d", attributes(units=("c", units)), days.astype(">f8")))
        variables.append(("flag", ["time", "lon"], "h", attributes(), np.ones((t, lon), ">i2")))
    dims = ["time", "lat", "lon"]

    def head(begins):
        out = b"CDF" + bytes([version]) + n4(t if record else 0) + struct.pack(">I", 10) + n4(3)
        out += b"".join(text(d) + n4(0 if record and d == "time" else sizes[d]) for d in dims) + attributes(title=("c", "x" * 20_000)) + struct.pack(">I", 11) + n4(len(variables))
        for (label, axes, code, att, data), begin in zip(variables, begins):
            size = data[0].nbytes if record and axes[0] == "time" else data.nbytes
            out += text(label) + n4(len(axes)) + b"".join(n4(dims.index(a)) for a in axes) + att + struct.pack(">I", codes[code]) + n4(-(-size // 4) * 4) + struct.pack(">I" if version == 1 else ">Q", begin)
        return out

    at, begins, body, rec = len(head([0] * len(variables))), [], b"", []
    for label, axes, code, att, data in variables:
        if record and axes[0] == "time":
            rec.append(data)
            begins.append(None)
        else:
            begins.append(at + len(body))
            body += pad(data.tobytes())
    start = at + len(body)
    # Places of the record variables within a record.
    k = 0
    for i, (label, axes, code, att, data) in enumerate(variables):
        if record and axes[0] == "time":
            begins[i] = start + k
            k += -(-data[0].nbytes // 4) * 4
    body += b"".join(pad(d[step : step + 1].tobytes()) if len(rec) > 1 else d[step : step + 1].tobytes() for step in range(t if record else 0) for d in rec)
    path.write_bytes(head(begins) + body)
    x = raw.astype(float)
    x = np.where(raw == raw[2, 1, 1], np.nan, x * 0.01 + 5.0 if packed else x)
    return days, (x if order[1] == "lat" else x.transpose(0, 2, 1))


def expected(days, x, lat=4, lon=6):
    e = G.years(days, "days since 2002-01-01")
    la, lo = np.linspace(-60, 60, lat), np.mod(np.linspace(-90, 210, lon), 360)
    return {(round(float(e[k]), 9), float(la[i]), float(lo[j])): (None if np.isnan(x[k, i, j]) else round(float(x[k, i, j]), 6)) for k in range(len(days)) for i in range(lat) for j in range(lon)}


def rows(df):
    return {(round(r.epoch, 9), r.lat, r.lon): (None if r.value is None else round(r.value, 6)) for r in df.collect()}


@pytest.mark.parametrize("version, record, packed, order", [(1, True, True, ("time", "lat", "lon")), (2, True, False, ("time", "lon", "lat")), (5, False, True, ("time", "lat", "lon")), (1, False, False, ("time", "lon", "lat"))])
def test_layouts(spark, tmp_path, version, record, packed, order):
    days, x = written(tmp_path / "g.nc", version=version, record=record, packed=packed, order=order)
    df = G.read_grid_series(spark, str(tmp_path / "g.nc"))
    assert df.rdd.getNumPartitions() == 2 and rows(df) == expected(days, x)
    assert rows(G.read_grid_series(spark, f"file://{tmp_path}/g.nc", "lwe_thickness")) == expected(days, x)


def test_an_epoch_costs_its_own_bytes(spark, tmp_path):
    days, x = written(tmp_path / "g.nc", t=200, lat=30, lon=40)
    e = G.years(days, "days since 2002-01-01")
    df = G.read_grid_series(spark, str(tmp_path / "g.nc")).where(f"epoch >= {e[50]} AND epoch < {e[53]}")
    assert df.rdd.getNumPartitions() == 1
    assert rows(df) == {k: v for k, v in expected(days, x, 30, 40).items() if round(e[50], 9) <= k[0] < round(e[53], 9)}

    class Counted:
        def __init__(self, source):
            self.source, self.bytes, self.size = source, 0, source.size

        def read_at(self, n, at):
            self.bytes += n
            return self.source.read_at(n, at)

    with G.opened(str(tmp_path / "g.nc")) as source:
        seen = Counted(source)
        g = G.layout(seen)
        head = seen.bytes
        assert head < source.size() / 3  # head, places and times
        assert np.array_equal(G.read_steps(seen, g.height, 50, 1)[0], x[50]) and seen.bytes - head == 2 * 30 * 40


def test_unknown_layouts_are_refused(tmp_path):
    def read(**kw):
        written(tmp_path / "x.nc", **kw)
        with G.opened(str(tmp_path / "x.nc")) as source:
            return G.layout(source)

    for kw, word in [({"units": "months since 2002-01-01"}, "time units"), ({"alone": True}, "none of time"), ({"name": "height"}, "none of lwe"), ({"order": ("lat", "time", "lon"), "record": False, "lat": 12}, "slowest")]:
        with pytest.raises(ValueError, match=word):
            read(**kw)
    (tmp_path / "y.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with G.opened(str(tmp_path / "y.nc")) as source, pytest.raises(ValueError, match="netCDF"):
        G.layout(source)
    written(tmp_path / "z.nc")
    (tmp_path / "z.nc").write_bytes((tmp_path / "z.nc").read_bytes()[:-400])
    with G.opened(str(tmp_path / "z.nc")) as source, pytest.raises(ValueError, match="ends"):
        g = G.layout(source)
        G.read_steps(source, g.height, 11, 1)
