"""Recursive exponential means.

y starts at the first value; on a value x after g missing ones, y = (w y + a x) / (w + a) with w = (1 - a)^(g + 1); on a
missing value y stays. ``ewm`` streams sorted groups through Arrow. ``ewm_long`` is for series too long for one task: the recurrence
is affine in y, so blocks are folded on their own, the few block results are chained, and each row is completed from its
block's start. Both give the same numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.segments import map_sorted_groups


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def wilder_alpha(period: int) -> float:
    return 1.0 / period


def smooth(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy()


def with_columns(table: pa.Table, made: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows of a group with double columns added, NaN as null."""
    arrays = [c.combine_chunks() for c in table.columns] + [pa.array(v, pa.float64(), from_pandas=True) for v in made.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*table.column_names, *made])


def series_map(df: DataFrame, keys: list[str], order: list[str], function, names: list[str]) -> DataFrame:
    """Adds double columns ``names`` that ``function(get)`` makes of each key's ordered columns; get(name) is an array with NaN for null."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` double" for n in names])

    def run(group: pa.Table) -> pa.RecordBatch:
        made = function(lambda c: group[c].to_numpy().astype("float64"))
        return with_columns(group, {n: made[n] for n in names})

    return map_sorted_groups(df, keys, order, run, schema)


def ewm(df: DataFrame, column: str, alpha: float, out: str, keys: list[str], order: list[str], mask: int = 0) -> DataFrame:
    """``out``: the recursive mean of ``column`` per key, null in the first ``mask`` rows."""

    def run(get):
        y = smooth(get(column), alpha)
        y[:mask] = np.nan
        return {out: y}

    return series_map(df, keys, order, run, [out])


def ewm_long(df: DataFrame, column: str, alpha: float, out: str, keys: list[str], order: list[str], block: str) -> DataFrame:
    """The same by an affine scan over blocks of a key; ``column`` without nulls.

    ``block`` names a column that splits a key into parts that fit a task and lie in order (a day, a month). Every block is
    folded from zero in one pass, which gives y = b + (1 - a)^(i + 1) y_start for its i-th row; the block ends, one row a block,
    are chained, and each row is completed from its block's start. Work is linear in the rows and in the blocks.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["__fold double", "__i double"])

    def fold(group: pa.Table) -> pa.RecordBatch:
        x = group[column].to_numpy().astype("float64")
        return with_columns(group, {"__fold": smooth(np.r_[0.0, x], alpha)[1:], "__i": np.arange(1.0, len(x) + 1)})

    rows = map_sorted_groups(df.withColumn("__part", F.col(block).cast("string")), [*keys, "__part"], order, fold, schema.replace("__fold double", "__part string, __fold double"))
    ends = rows.groupBy(*keys, block).agg(F.max("__i").alias("n"), F.max_by("__fold", "__i").alias("b"), F.min_by(F.col(column).cast("double"), "__i").alias("first"))

    def chain(group: pa.Table) -> pa.RecordBatch:
        y, starts = group["first"][0].as_py(), []
        for n, b in zip(group["n"].to_pylist(), group["b"].to_pylist()):
            starts.append(y)
            y = y * (1 - alpha) ** n + b
        return pa.RecordBatch.from_arrays([*[group[c].combine_chunks() for c in (*keys, block)], pa.array(starts, pa.float64())], names=[*keys, block, "__start"])

    kept = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kept[c]}" for c in (*keys, block))
    starts = map_sorted_groups(ends, keys, [block], chain, schema + ", __start double")
    done = rows.drop("__part").join(starts, [*keys, block])
    return done.withColumn(out, F.col("__fold") + F.pow(F.lit(1 - alpha), F.col("__i")) * F.col("__start")).select(*df.columns, out)
