"""Groups of rows in Arrow batches: each group whole, many groups at once.

Rows are dealt and sorted by their keys in Spark; a task then reads its partition from front to back and works on a
batch of whole groups at a time, so its memory is that of a batch (or of the largest group), not of the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 1 << 16


def types(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in names)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin in sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = pd.factorize(table.column(k).to_pandas(), use_na_sentinel=False)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of about ``rows`` rows, with their starts."""
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = starts(t, keys)
        if at[-1]:
            yield t.slice(0, at[-1]).combine_chunks(), at[:-1]
        # The last group may go on; a group larger than a batch is met again only when as many rows have come.
        held, count = t.slice(at[-1]).combine_chunks().to_batches(), 0
    if any(b.num_rows for b in held):
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t, keys)


def map_groups(df: DataFrame, keys: list[str], then: list[str], run: Callable, schema: str, rows: int = ROWS) -> DataFrame:
    """``run(table, starts)`` on batches of whole groups, rows sorted by keys and ``then``; it yields Arrow batches of ``schema``."""

    def task(batches):
        for t, at in whole(batches, keys, rows):
            yield from run(t, at)

    return df.repartition(*keys).sortWithinPartitions(*keys, *then).mapInArrow(task, schema)


def floats(table: pa.Table, name: str) -> np.ndarray:
    """A column of numbers; null is NaN."""
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)


def repeated(table: pa.Table, keys: list[str], rows: np.ndarray, columns: dict) -> pa.RecordBatch:
    """The keys at ``rows`` with new columns beside them."""
    head = table.select(keys).take(pa.array(rows)).combine_chunks()
    data = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in head.columns]
    return pa.RecordBatch.from_arrays([*data, *(pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values())], names=[*keys, *columns])
