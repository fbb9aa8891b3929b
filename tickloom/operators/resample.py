"""Time bucketing of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.grid import trade_date
from tickloom.schema import ORDER_FLOW


def _ohlcv(df: DataFrame) -> list[Column]:
    flow = [F.sum(c).alias(c) for c in ORDER_FLOW if c in df.columns]
    return [F.min_by("open", "timestamp_utc").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp_utc").alias("close"), F.sum("volume").alias("volume"), *flow]


def bucket(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned UTC bucket: closed and labelled on the left."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / (minutes * 60)) * (minutes * 60))


def resample(bars: DataFrame, minutes: int, keys: list[str] | None = None) -> DataFrame:
    """Bars of ``minutes``: first open, highest high, lowest low, last close, summed volume and order flow; empty buckets make no bar.

    Order flow that is null throughout a bucket stays null. The aggregation is partial before its only shuffle.
    """
    keys = keys or ["symbol"]
    out = bars.groupBy(*keys, bucket(F.col("timestamp_utc"), minutes).alias("bucket")).agg(*_ohlcv(bars))
    return out.withColumnRenamed("bucket", "timestamp_utc").withColumn("timeframe", F.lit(f"{minutes}m"))


def resample_many(bars: DataFrame, minutes: list[int], keys: list[str] | None = None) -> DataFrame:
    """Several frequencies in one job: rows fan out to their buckets before one partial aggregation."""
    keys = keys or ["symbol"]
    fan = bars.withColumn("__m", F.explode(F.array(*map(F.lit, minutes)))).withColumn("__b", F.timestamp_seconds(F.floor(F.unix_seconds("timestamp_utc") / (F.col("__m") * 60)) * (F.col("__m") * 60)))
    out = fan.groupBy(*keys, "__m", "__b").agg(*_ohlcv(bars))
    return out.withColumn("timeframe", F.concat(F.col("__m"), F.lit("m"))).withColumnRenamed("__b", "timestamp_utc").drop("__m")


def resample_daily(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One bar per trade date (New York date of the instant plus six hours), stamped with its first bar."""
    keys = keys or ["symbol"]
    out = bars.groupBy(*keys, trade_date(F.col("timestamp_utc")).alias("trade_date")).agg(F.min("timestamp_utc").alias("timestamp_utc"), *_ohlcv(bars))
    return out.withColumn("timeframe", F.lit("1D"))


def resample_close(bars: DataFrame, minutes: int) -> DataFrame:
    return bars.groupBy("symbol", bucket(F.col("timestamp_utc"), minutes).alias("timestamp_utc")).agg(F.max_by("close", "timestamp_utc").alias("close"))
