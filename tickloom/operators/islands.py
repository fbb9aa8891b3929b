"""Gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ranks import before, block_of


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows: a row where ``starts`` holds opens the next one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def minute_runs(df: DataFrame, keys: list[str], ts: str = "timestamp_utc", minutes: int = 1) -> DataFrame:
    """Runs of instants exactly ``minutes`` apart: (keys, run_start, run_end, n)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    base = F.unix_seconds(ts) - F.row_number().over(w) * 60 * minutes
    return df.withColumn("__k", base).groupBy(*keys, "__k").agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("n")).drop("__k")


def streaks(df: DataFrame, keys: list[str], order: list, what: Column, block: Column | None = None) -> DataFrame:
    """Runs of equal values of ``what``: (keys, island, value, length).

    Runs are found within blocks of the order (its first column's months by default) and joined where one goes on over a border.
    """
    block = block if block is not None else block_of(df, order[0])
    df = df.withColumns({"__v": what, "__b": block})
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    df = islands(df, [*keys, "__b"], order, F.lag("__v").over(w).isNull() | (F.col("__v") != F.lag("__v").over(w)), "__i")
    part = df.groupBy(*keys, "__b", "__i").agg(F.first("__v").alias("__value"), F.count("*").alias("__n"))
    blocks = part.groupBy(*keys, "__b").agg(F.max("__i").alias("__k"), F.min_by("__value", "__i").alias("__head"), F.max_by("__value", "__i").alias("__tail"))
    goes_on = F.coalesce(F.lag("__tail").over(Window.partitionBy(*keys).orderBy("__b")) == F.col("__head"), F.lit(False)).cast("int")
    blocks = blocks.withColumn("__m", goes_on)
    offset = F.coalesce(F.sum(F.col("__k") - F.col("__m")).over(before(keys)), F.lit(0)) - F.col("__m")
    part = part.join(blocks.select(*keys, "__b", offset.alias("__o")), [*keys, "__b"])
    return part.groupBy(*keys, (F.col("__i") + F.col("__o")).alias("island")).agg(F.first("__value").alias("value"), F.sum("__n").alias("length"))


def largest_gaps(df: DataFrame, keys: list[str], ts: str = "timestamp_utc", over_seconds: int = 60, k: int = 5) -> DataFrame:
    """The k longest pauses above ``over_seconds`` of each key."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gaps = df.withColumn("gap_start", F.lag(ts).over(w)).withColumn("gap_seconds", F.unix_seconds(ts) - F.unix_seconds("gap_start")).where(F.col("gap_seconds") > over_seconds)
    top = Window.partitionBy(*keys).orderBy(F.col("gap_seconds").desc(), ts)
    return gaps.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(*keys, "gap_start", F.col(ts).alias("gap_end"), "gap_seconds", "rank")
