"""What a backtest leaves behind, and windows of layers for looking at it again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.operators import metrics, resample


def write_run(trades: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """trades, equity (both Parquet) and summary (JSON lines, one object per key); returns the summary as read back."""
    trades.write.mode("overwrite").parquet(f"{folder}/trades")
    kept = trades.sparkSession.read.parquet(f"{folder}/trades")
    metrics.equity(kept, keys).select(*keys, "exit_ts", "equity", "drawdown").write.mode("overwrite").parquet(f"{folder}/equity")
    s = metrics.summary(kept, keys)
    clean = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes]
    s.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/summary")
    return trades.sparkSession.read.schema(s.schema).json(f"{folder}/summary")


def write_walkforward(trades: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Trades by fold and one row of measures per fold, both Parquet; returns the latter as read back."""
    trades.write.mode("overwrite").partitionBy("fold").parquet(f"{folder}/trades")
    kept = trades.sparkSession.read.parquet(f"{folder}/trades")
    metrics.summary(kept, [*keys, "fold"]).write.mode("overwrite").parquet(f"{folder}/folds")
    return trades.sparkSession.read.parquet(f"{folder}/folds")


def head_sample(df: DataFrame, folder: str, order: list[str], n: int = 100) -> dict:
    """The first ``n`` rows as a Parquet sample with a manifest of what it was taken from."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").parquet(f"{folder}/head")
    doc = {"rows": df.count(), "sampled": df.sparkSession.read.parquet(f"{folder}/head").count(), "columns": [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]}
    df.sparkSession.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return doc


def replay_window(bars: DataFrame, start: str, end: str, *, sma: int = 200, minutes: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    """Bars of several timeframes and days between two instants, with their moving average, for replay.

    The average is taken over the whole history before the window is cut, so the first rows of the window have it. The cut cannot move
    below the average, which is a window function over the series.
    """
    daily = resample.resample_daily(bars).withColumn("timeframe", F.lit("1D"))
    names = ["symbol", "timeframe", "timestamp_utc", "open", "high", "low", "close", "volume"]
    every = resample.resample_many(bars, list(minutes)).select(*names).unionByName(daily.select(*names))
    return ind.sma(every, sma).where(F.col("timestamp_utc").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def first_of(df: DataFrame, prefix: str) -> str | None:
    """The first column whose name begins with ``prefix``, as figures look for an order-flow column under any length."""
    return next((c for c in df.columns if c.startswith(prefix)), None)


def status(bars: DataFrame, trades: DataFrame, now: str, *, recent: int = 5, bar_bytes: int = 96) -> tuple[DataFrame, DataFrame]:
    """(data, runs): per symbol the age of its newest bar in days and a bucket of its size; the runs that ended last."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date(F.max("timestamp_utc")))
    mb = F.count("*") * bar_bytes / 1e6
    data = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("timestamp_utc").alias("newest"), age.alias("age_days"), F.when(mb < 0.1, "small").when(mb < 100, "medium").otherwise("large").alias("storage"))
    runs = trades.groupBy("run_id").agg(F.max("exit_ts").alias("last_exit"), F.count("*").alias("trades")).orderBy(F.col("last_exit").desc_nulls_last(), "run_id").limit(recent)
    return data.withColumn("stale", F.col("age_days") > 7), runs


def save_logs(events: DataFrame, folder: str) -> str:
    """Events (with a ``day``) as JSON lines, one folder per day."""
    events.write.mode("overwrite").partitionBy("day").json(folder)
    return folder
