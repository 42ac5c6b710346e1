"""Many small groups in one task: rows sorted by group, whole groups at a time, and groups of one size as one numpy array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task on average at most, so that what it sorts does not grow with the table.
ROWS = 500_000
#: Numbers of an array over several groups: little enough for a processor's cache, enough to make numpy's calls cheap.
AT_ONCE = 1 << 18


def sizes(df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    """``(keys, _n)``, the number of all rows and that of the largest group."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    return counts, total or 0, most or 0


def dealt(df: DataFrame, keys: tuple[str, ...], total: int, *order: str) -> DataFrame:
    """``df`` by key in as many partitions as a shuffle has (little data, but much work for each group), or more if ``total`` rows need them; sorted by key, then ``order``."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def starts(table: pa.Table | pa.RecordBatch, n: int) -> np.ndarray:
    """Where groups of the first ``n`` columns begin in sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(n):
        column = table.column(i)
        codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the first ``n`` columns, with the places where groups begin and the last one ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]), n).size == 1:
            first = starts(b, n)
            if len(first) == 1:  # all of it belongs to the group that is open
                held.append(b)
                continue
        cut = int(starts(b, n)[-1])
        done = [*held, b.slice(0, cut)]
        held = [b.slice(cut)]
        t = pa.Table.from_batches(done).combine_chunks()
        if t.num_rows:
            yield t, np.append(starts(t, n), t.num_rows)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(starts(t, n), t.num_rows)


def by_size(bounds: np.ndarray, numbers) -> Iterator[np.ndarray]:
    """Rows of groups of one size, a line for each group; as many groups at once as make ``AT_ONCE`` numbers, of which a group of ``n`` rows has ``numbers(n)``."""
    n = np.diff(bounds)
    for size in np.unique(n).tolist():
        first = bounds[:-1][n == size]
        step = max(1, AT_ONCE // max(1, numbers(size)))
        for i in range(0, len(first), step):
            yield first[i : i + step, None] + np.arange(size)
