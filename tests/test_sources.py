import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.functions.index import index_arrays
from orbloom.operators.nearest import evaluate_terms
from orbloom.sources import files as S


def test_gfc_writer_and_reader_round_trip(spark, tmp_path):
    n, m, cs = index_arrays(3, 0)
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([(int(a), int(b), int(c), float(v), 0.5) for a, b, c, v in zip(n, m, cs, rng.standard_normal(len(n)))], "n int, m int, cs int, v double, s double")
    S.write_gfc(x, f"{tmp_path}/GSM-2_2010001-2010031.gfc", 3, "demo")
    back = S.read_gfc(spark, f"{tmp_path}/GSM-2_2010001-2010031.gfc", "part-*")
    c = back.where("kind = 'gfc'")
    assert c.count() == 10
    j = x.where("cs = 0").join(c.select("n", "m", "c"), ["n", "m"])
    assert j.count() == 10 and j.agg(F.max(F.abs(F.col("v") - F.col("c")))).first()[0] < 1e-13
    assert S.gfc_headers(back).first()["header"]["modelname"] == "demo"


def test_gfc_time_terms_bad_lines_and_gzip(spark, tmp_path):
    text = "modelname x\nearth_gravity_constant 3.986D14\nend_of_head\ngfct 2 0 1.0D0 0 0.1 0.1 20100101 20200101\ntrnd 2 0 0.5 0 0 0 20100101 20200101\nacos 2 0 2.0 0 0 0 20100101 20200101 1.0\ngfc 3 x 1 2\ngfc 2 1 3.0 4.0\n"
    (tmp_path / "a_2010-01.gfc.gz").write_bytes(gzip.compress(text.encode()))
    r = S.read_gfc(spark, str(tmp_path))
    assert {x.kind: x["count"] for x in r.groupBy("kind").count().collect()} == {"header": 2, "gfct": 1, "trnd": 1, "acos": 1, "bad": 1, "gfc": 1}
    assert S.gfc_headers(r).first().gm == pytest.approx(3.986e14)
    v = evaluate_terms(spark.createDataFrame([(2011.0,)], "epoch double"), S.gfc_terms(r).where("key LIKE '%/2/0/0'")).first().value
    assert v == pytest.approx(1.0 + 0.5 + 2.0, abs=1e-6)


def test_shm_refuses_mixed_kinds(spark, tmp_path):
    (tmp_path / "x.shm").write_text("header:\n# End of YAML header\nGRCOF2 2 0 1.0 0.0 0.1 0.0 20100101.0 20100131.0\nGRCOF2 5 0 1.0 0.0 0.1 0.0 20100101.0 20100131.0\n")
    assert S.read_shm(spark, str(tmp_path), nmax=3).count() == 1
    (tmp_path / "x.shm").write_text("# End of YAML header\nGRCOF2 2 0 1 0 0 0\nGRDOTA 2 0 1 0\n")
    with pytest.raises(Exception, match="mixes"):
        S.read_shm(spark, str(tmp_path)).count()


def test_correction_tables(spark, tmp_path):
    (tmp_path / "tn13").write_text("title\nGRCOF2 1 0 1E-10 0 1E-12 0 20100101.0000 20100131.2359\nGRCOF2 1 1 2E-10 3E-10 2E-12 3E-12 20100101.0000 20100131.2359\n")
    g = S.read_geocentre(spark, f"{tmp_path}/tn13").first()
    assert (g.c10, g.c11, g.s11) == (1e-10, 2e-10, 3e-10) and 2010.0 < g.epoch < 2010.1
    (tmp_path / "tn14").write_text("head\n55197.0 2010.0 -4.8D-04 1.0 0.5 NaN NaN NaN 55228.0 2010.08\n")
    t = S.read_low_degrees(spark, f"{tmp_path}/tn14").first()
    assert t.c30 is None and t.c20 == pytest.approx(-4.8e-4) and t.sigma_c20 == pytest.approx(0.5e-10)
    (tmp_path / "love").write_text("# n k\n0 0.0\n1 0.027\n2 -0.3054\n2 9\n")
    assert S.read_love_numbers(spark, f"{tmp_path}/love").count() == 3


def test_sinex_mirror_and_projection(spark, tmp_path):
    (tmp_path / "a.snx").write_text(
        "+SOLUTION/ESTIMATE\n* c\n 1 CN 2 -- 0 10:001:00000 x 2 1.5 0.1\n 2 SN 2 -- 1 10:001:00000 x 2 2.5 0.2\n-SOLUTION/ESTIMATE\n+SOLUTION/MATRIX_ESTIMATE L COVA\n 1 1 4.0\n 2 1 0.5 9.0\n-SOLUTION/MATRIX_ESTIMATE L COVA\n"
    )
    x = S.read_sinex(spark, str(tmp_path)).toPandas()
    assert len(x[x.block == "estimate"]) == 2 and len(x[x.block == "covariance"]) == 4
    assert S.read_sinex(spark, str(tmp_path), only="ESTIMATE").where("block = 'estimate'").count() == 2
    assert S.sinex_year("10:001:43200") == pytest.approx(2010 + 0.5 / 365)


def test_block_filters_in_both_forms(spark, tmp_path):
    w = np.arange(4.0).reshape(2, 2)
    (tmp_path / "a.txt").write_text("block 2 0 2 3\n0 1\n2 3\n")
    (tmp_path / "a.bin").write_bytes(S.pack_blocks([(2, 0, 2, 3, w)]))
    a, b = (S.read_blocks(spark, str(tmp_path), p).select("m", "cs", "n_row", "n_col", "w").orderBy("n_row", "n_col").collect() for p in ("*.txt", "*.bin"))
    assert a == b and len(a) == 4
    assert S.read_blocks(spark, str(tmp_path), "*.txt", nmax=2).count() == 1


def test_polygons_grid_and_interpolation(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"b"},"geometry":{"type":"Polygon","coordinates":[[[10,1],[20,2],[10,1]]]}}]}')
    r = S.read_polygons(spark, f"{tmp_path}/p.json").first()
    assert r.name == "b" and (r.ring[1].lat, r.ring[1].lon) == (2.0, 20.0)
    g = spark.createDataFrame([(2010.5, 1.0, -10.0, 3.0)], "epoch double, lat double, lon double, value double")
    S.write_grid(g, f"{tmp_path}/grid", "m")
    assert tuple(S.read_grid(spark, f"{tmp_path}/grid").select("epoch", "lon", "value").first()) == (2010.5, 350.0, 3.0)
    y = S.interpolate_love(np.array([0, 2, 10]), np.array([0.0, -0.3, -0.1]), 10)
    assert y[2] == pytest.approx(-0.3) and y[10] == pytest.approx(-0.1) and np.all(np.diff(y[2:]) > 0)


def test_classic_netcdf(spark, tmp_path):
    def s(t):
        b = t.encode()
        return struct.pack(">I", len(b)) + b + b"\0" * (-len(b) % 4)

    dims = [("time", 1), ("lat", 2), ("lon", 2)]
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 3) + b"".join(s(n) + struct.pack(">I", k) for n, k in dims) + struct.pack(">II", 0, 0)
    unit = struct.pack(">II", 12, 1) + s("units") + struct.pack(">I", 2) + s("days since 2002-01-01")
    vs = [("time", [0], unit, np.array([365.0])), ("lat", [1], struct.pack(">II", 0, 0), np.array([-1.0, 1.0])), ("lon", [2], struct.pack(">II", 0, 0), np.array([0.0, 5.0])), ("lwe_thickness", [0, 1, 2], struct.pack(">II", 0, 0), np.arange(4.0))]
    size = len(head) + 8 + sum(len(s(n)) + 4 + 4 * len(d) + len(a) + 12 for n, d, a, _ in vs)
    body, defs, at = b"", b"", size
    for n, d, a, x in vs:
        raw = x.astype(">f8").tobytes()
        defs += s(n) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", k) for k in d) + a + struct.pack(">III", 6, len(raw), at)
        body, at = body + raw, at + len(raw)
    (tmp_path / "m.nc").write_bytes(head + struct.pack(">II", 11, len(vs)) + defs + body)
    x = S.read_netcdf_grid(spark, f"{tmp_path}/m.nc").orderBy("lat", "lon").collect()
    assert [r.value for r in x] == [0.0, 1.0, 2.0, 3.0] and x[0].epoch == pytest.approx(2003.0)


def test_static_files_in_bulk_and_line_by_line(spark, tmp_path):
    head = "modelname x\nradius 6.4E+06\nend_of_head ===\n"
    rows = [(n, m, 1e-6 * n, -1e-7 * m, 1e-12, 2e-12) for n in range(30) for m in range(n + 1)]
    body = "".join("gfc %d %d %.12e %.12e %.3e %.3e\n" % r for r in rows)
    (tmp_path / "bulk.gfc").write_text(head + body.replace("e-06", "D-06"))
    (tmp_path / "mixed.gfc").write_text(head + body + "trnd 2 0 1.0e-11 0.0 0 0\n")
    (tmp_path / "bare.gfc").write_text(head + "gfc 2 0 1.0 0.0\ngfc 2 1 2.0 3.0\n")
    (tmp_path / "nan.gfc").write_text(head + "gfc 2 0 1.0 0.0 NaN NaN\ngfc 2 1 2.0 3.0 0.1 0.2\n")
    x = S.read_gfc(spark, str(tmp_path)).toPandas()
    x["file"] = x.path.str.split("/").str[-1]
    cols = ["n", "m", "c", "s", "sigma_c", "sigma_s"]
    bulk, mixed = (x[(x.file == f) & (x.kind == "gfc")].sort_values(["n", "m"])[cols].to_numpy(float) for f in ("bulk.gfc", "mixed.gfc"))
    assert np.array_equal(bulk, mixed) and len(bulk) == len(rows) and (x[x.file == "mixed.gfc"].kind == "trnd").sum() == 1
    assert (x[x.file == "bulk.gfc"].kind == "header").sum() == 2
    bare = x[(x.file == "bare.gfc") & (x.kind == "gfc")].sort_values("m")
    assert bare.sigma_c.isna().all() and bare.s.tolist() == [0.0, 3.0]
    nan = x[(x.file == "nan.gfc") & (x.kind == "gfc")].sort_values("m")
    assert np.isnan(nan.sigma_c.iloc[0]) and nan.sigma_s.iloc[1] == 0.2


def test_load_columns(spark, tmp_path):
    (tmp_path / "a.txt").write_text("groops matrix version=1\nMatrix( 3 x 1 )\n 0.0\n -0.021\n-3.0D-01\n")
    assert [(r.n, r.value) for r in S.read_load_column(spark, f"{tmp_path}/a.txt").orderBy("n").collect()] == [(0, 0.0), (1, -0.021), (2, -0.3)]
    assert [r["value"] for r in S.parse_load_column("b", "\n".join(str(k / 10) for k in range(120)).encode())] == [k / 10 for k in range(120)]
    for bad in (b"groops matrix version=1\nMatrix( 3 x 2 )\n1 2\n3 4\n5 6\n", b"1\n2\n3\n", b"groops matrix version=1\nMatrix( 4 x 1 )\n1\n2\n3\n", b"\n".join([b"1"] * 150 + [b"x"])):
        with pytest.raises(ValueError):
            list(S.parse_load_column("x", bad))


def test_epochs_of_two_sides(spark):
    from orbloom.operators import coefficients as C

    a = spark.createDataFrame([(1, 2005.0), (2, 2006.0), (3, None)], "set_id long, epoch double")
    C.assert_same_epochs(a, a.withColumn("epoch", F.col("epoch") + 0.01), ["set_id"], 0.02)
    C.assert_same_epochs(a, a.where("set_id = 3").withColumn("epoch", F.lit(1999.0)), ["set_id"], 0.02)
    with pytest.raises(ValueError, match="minus: epochs 2005.0000 and 2005.1000"):
        C.assert_same_epochs(a, a.withColumn("epoch", F.col("epoch") + 0.1).where("set_id = 1"), ["set_id"], 0.02, "minus")
    assert [r.set_id for r in C.by_epoch(a.union(spark.createDataFrame([(4, 2001.0)], a.schema))).collect()] == [4, 1, 2, 3]
