"""Every registered query with SQL: Spark and DuckDB give the same rows."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from orbloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_clusters_keep_fractions_of_a_second(spark, tmp_path):
    """Gaps of 12 hours and a part of a second, and an event without a time."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT * FROM (VALUES (1, TIMESTAMP '2020-01-01 00:00:00.1'), (1, TIMESTAMP '2020-01-01 12:00:00.2'), (1, TIMESTAMP '2020-01-02 00:00:00.2'),
        (2, TIMESTAMP '2020-01-01 00:00:00.9'), (2, TIMESTAMP '2020-01-01 12:00:01.0'), (2, TIMESTAMP '2020-01-03'), (2, NULL)) t(user_id, ts)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert canonical(QUERIES["epoch_clusters"](spark, str(tmp_path)).toPandas()) == canonical(con.execute(ORACLE["epoch_clusters"]).df())
