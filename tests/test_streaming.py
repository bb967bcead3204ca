import numpy as np
import pandas as pd

from orbloom.operators.geocentre import estimate_degree1
from orbloom.operators.sequential import kalman_series
from orbloom.streaming.kalman import stream_filter


def test_stream_and_batch_agree(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"key": ["a", "b"] * 10, "epoch": np.repeat(np.arange(10.0), 2), "v": rng.standard_normal(20)})
    batch = kalman_series(spark.createDataFrame(df), ["key"], 0.8, 0.3, 0.5, 1.0, smoother=False).toPandas().sort_values(["key", "epoch"])
    for k, part in enumerate((df[df.epoch < 5], df[df.epoch >= 5])):
        part.to_parquet(tmp_path / f"{k}.parquet")
    s = spark.readStream.schema("key string, epoch double, v double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path))
    q = stream_filter(s, 0.8, 0.3, 0.5, 1.0).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM filtered").toPandas().sort_values(["key", "epoch"])
    assert np.allclose(got["filtered"], batch["filtered"]) and np.allclose(got["filtered_var"], batch["filtered_var"])


def test_geocentre_recovers_truth(spark):
    lat, lon = (x.ravel() for x in np.meshgrid(np.arange(-80, 81, 10.0), np.arange(0, 200, 10.0)))
    k = 6378136.3 * 5.517 / 1.021 * 3**0.5
    p, q = np.radians(lat), np.radians(lon)
    value = k * (1e-10 * np.sin(p) + 2e-10 * np.cos(p) * np.cos(q) - 1e-10 * np.cos(p) * np.sin(q)) + 0.01
    r = estimate_degree1(spark.createDataFrame(pd.DataFrame({"epoch": 2010.0, "lat": lat, "lon": lon, "value": value})), 0.021).first()
    assert np.allclose([r.c10, r.c11, r.s11], [1e-10, 2e-10, -1e-10], atol=1e-14) and abs(r.mass - 0.01) < 1e-8
