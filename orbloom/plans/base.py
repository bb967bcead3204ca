"""Driver tables seen as coefficient sets and series, in Spark and in SQL, and helpers to state results alike.

Each embedding of 64 numbers is the canonical vector of a set of degree 7; its epoch is 2002 + vec_id / 12.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbloom.functions.index import sh_index, sql_values
from orbloom.functions.scalars import month_epoch
from orbloom.operators.coefficients import unpack

NMAX = 7
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that states its result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("set_id"), (2002 + F.col("vec_id") / 12.0).alias("epoch"), "label", "embedding")
    return unpack(e, "embedding", NMAX).withColumn("s", 0.01 * F.abs("v") + 1e-6)


def monthly(spark: SparkSession, sf_dir: str, key: str = "c_nationkey") -> DataFrame:
    """Order value by month and nation (or segment): (key, epoch, v)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", month_epoch(F.col("o_orderdate")).alias("epoch"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col(key).alias("key"))
    return o.join(c, "o_custkey").groupBy("key", "epoch").agg(F.sum("o_totalprice").alias("v"))


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[(F.round(F.col(c), other.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


IDX = f"idx(pos, n, m, cs) AS (VALUES {sql_values(sh_index(NMAX, 0))})"
COEF = f"""{IDX}, coef AS MATERIALIZED (
  SELECT vec_id AS set_id, 2002 + vec_id / 12.0::DOUBLE AS epoch, label, n, m, cs,
         CAST(embedding[pos + 1] AS DOUBLE) AS v,
         0.01::DOUBLE * abs(CAST(embedding[pos + 1] AS DOUBLE)) + 0.000001::DOUBLE AS s
  FROM embeddings, idx)"""


def monthly_sql(key: str = "c_nationkey") -> str:
    return f"""monthly AS (
  SELECT {key} AS key, year(o_orderdate) + (month(o_orderdate) - 0.5::DOUBLE) / 12 AS epoch, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
