"""Streaming over the key groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys. Only the rows of one group are held besides the current batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(max(n - 1, 0), dtype=bool)
        for k in keys:
            a = batch.column(k)
            if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
                a = a.dictionary_encode().indices
            a = a.fill_null(-1).to_numpy(zero_copy_only=False)
            change |= a[1:] != a[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        if held:
            first, last = batch.slice(0, 1), held[-1].slice(held[-1].num_rows - 1, 1)
            if any(first.column(k)[0].as_py() != last.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < n:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over each group of ``keys`` (strings or integers), its rows sorted by ``order``.

    One shuffle and one JVM sort; groups then stream through Python with no cost per group beyond the function's own.
    """

    def run(batches):
        for group in _groups(batches, keys):
            out = function(group)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
