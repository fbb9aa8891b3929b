"""Row numbers, running counts and neighbours of long keys, in two levels.

A window over a whole key is one task. Here a key is cut into blocks in order; windows run within blocks, and what a block
needs from those before it (or after it) travels through a table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_of(ts: str) -> Column:
    return F.date_trunc("month", F.col(ts))


def block_of(df: DataFrame, name: str) -> Column:
    """Blocks along an ordering column: months of a time, stretches of 65,536 of a number."""
    kind = dict(df.dtypes)[name]
    return month_of(name) if kind.startswith(("timestamp", "date")) else F.floor(F.col(name) / 65_536)


def before(keys: list[str]):
    """The blocks of a key before the present one; without keys there is one row per block in all."""
    return Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def after(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)


def places(df: DataFrame, keys: list[str], order: list, block: Column, out: str = "__n", total: str | None = None) -> DataFrame:
    """Adds the row number from 1 in ``order`` and, if asked for, the number of rows of the key. ``block`` must not fall along the order."""
    b = df.withColumn("__b", block)
    sizes = b.groupBy(*keys, "__b").agg(F.count("*").alias("__k"))
    made = [F.coalesce(F.sum("__k").over(before(keys)), F.lit(0)).alias("__o")] + ([F.sum("__k").over(Window.partitionBy(*keys)).alias(total)] if total else [])
    sizes = sizes.select(*keys, F.col("__b").alias("__c"), *made)
    on = F.col("__b").eqNullSafe(F.col("__c"))
    for k in keys:
        sizes = sizes.withColumnRenamed(k, f"__{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    numbered = b.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    return numbered.join(sizes, on).withColumn(out, F.col(out) + F.col("__o")).drop("__b", "__c", "__o", *[f"__{k}" for k in keys])
