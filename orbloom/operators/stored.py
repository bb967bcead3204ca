"""Tables between the rounds of an iteration, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only in local mode without that setting."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _private:
        _private.append("file://" + tempfile.mkdtemp(prefix="orbloom-"))
    return _private[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written out and read back: later steps neither recompute them nor need the executors that made them."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(epochs: DataFrame, name: str = "t") -> DataFrame:
    """The rows of a one-column frame with their rank from 0: a range-partitioned sort, counted partition by partition."""
    c = epochs.columns[0]
    rows = epochs.distinct().orderBy(c).rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    return epochs.sparkSession.createDataFrame(rows, f"`{c}` {epochs.schema[c].dataType.simpleString()}, {name} bigint", verifySchema=False)
