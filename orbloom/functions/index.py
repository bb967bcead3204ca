"""Canonical coefficient index: order by order, then degree by degree, C before S."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=32)
def sh_index(nmax: int, min_degree: int = 2) -> tuple[tuple[int, int, int, int], ...]:
    """(pos, n, m, cs) of the (nmax + 1)**2 - min_degree**2 coefficients."""
    if nmax < 1 or min_degree < 0:
        raise ValueError("nmax must be positive and min_degree not negative")
    rows = [(n, m, cs) for m in range(nmax + 1) for n in range(max(m, min_degree), nmax + 1) for cs in ((0, 1) if m else (0,))]
    return tuple((k, *r) for k, r in enumerate(rows))


def index_arrays(nmax: int, min_degree: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.array(sh_index(nmax, min_degree))
    return a[:, 1], a[:, 2], a[:, 3]


def index_table(spark: SparkSession, nmax: int, min_degree: int = 2) -> DataFrame:
    """The index as a dimension table, made on the JVM side from literals; (nmax + 1)**2 rows."""
    return literal_table(spark, ["pos", "n", "m", "cs"], sh_index(nmax, min_degree))


def sql_values(rows) -> str:
    """Rows as the text of a VALUES list; floats keep all digits and are doubles in both dialects."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, (float, np.floating)):
            return f"CAST({float(x)!r} AS DOUBLE)"
        return str(int(x))

    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def literal_table(spark: SparkSession, names: list[str], rows) -> DataFrame:
    """A small constant table without a Python or RDD scan."""
    return spark.sql(f"SELECT * FROM VALUES {sql_values(rows)} AS t({', '.join(names)})")
