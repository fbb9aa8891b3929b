"""Bars, session VWAPs and trades from streams of bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.schema import REASONS

_VALUES = ["open", "high", "low", "close", "volume"]


def stream_clean(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Deliveries to bars as ``schema.clean_bars`` does: what is no bar is dropped, of several at one instant the first delivered stays.

    An instant is decided once the watermark has passed it, so a redelivery must come within ``late``.
    """
    ok = " and ".join(f"not coalesce({c}, false)" for _, c in REASONS)
    first = F.min_by(F.struct(*_VALUES), "bar_id").alias("b")
    return bars.where(ok).withWatermark("timestamp_utc", late).groupBy(F.col("contract").alias("symbol"), "timestamp_utc").agg(first).select("symbol", "timestamp_utc", "b.*")


def stream_resample(bars: DataFrame, minutes: int, late: str | None = "10 minutes") -> DataFrame:
    """Tumbling bars; a bucket is emitted once the watermark has passed it, later rows are dropped. ``late`` None: the bars have a watermark."""
    w = F.window("timestamp_utc", f"{minutes} minutes")
    bars = bars.withWatermark("timestamp_utc", late) if late else bars
    out = bars.groupBy("symbol", w).agg(F.min_by("open", "timestamp_utc").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp_utc").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("window.start").alias("timestamp_utc"), "open", "high", "low", "close", "volume")


def with_end(bars: DataFrame, folder: str, after: str = "9999-01-01 00:00:00") -> DataFrame:
    """The stream and, from a file written to ``folder``, one row of no contract at the end of time.

    A backfill that ends with it moves the watermark past all that is there, so every bucket is emitted and none stays open.
    """
    spark = bars.sparkSession
    row = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("timestamp_utc", "contract", *_VALUES) else F.lit({"timestamp_utc": after, "contract": ""}.get(f.name, "0")).cast(f.dataType).alias(f.name) for f in bars.schema]
    spark.range(1).select(*row).coalesce(1).write.mode("overwrite").parquet(folder)
    return bars.unionByName(spark.readStream.schema(bars.schema).parquet(folder))


def stream_session_vwap(bars: DataFrame, gap: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per session (a pause longer than ``gap`` ends it): its span, volume and VWAP."""
    out = bars.withWatermark("timestamp_utc", late).groupBy("symbol", F.session_window("timestamp_utc", gap)).agg(F.sum("volume").alias("volume"), F.sum(F.col("close") * F.col("volume")).alias("__cv"), F.min("timestamp_utc").alias("first_ts"), F.max("timestamp_utc").alias("last_ts"))
    return out.select("symbol", "first_ts", "last_ts", "volume", (F.col("__cv") / F.nullif(F.col("volume").cast("double"), F.lit(0.0))).alias("vwap"))


def stream_stops(signals: DataFrame) -> DataFrame:
    """Positions held across micro-batches: entries at the signal bar's close, exits at the stop or target level.

    State per symbol is one position, (side, entry, stop, target, time); rows are taken in order of time within a batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, entry, stop, target, since = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("us")
        for r in rows.itertuples():
            if side:
                hit_stop = r.low <= stop if side > 0 else r.high >= stop
                hit_target = r.high >= target if side > 0 else r.low <= target
                if hit_stop or hit_target:
                    price = stop if hit_stop else target
                    out.append((key[0], side, since, r.us, entry, price, side * (price - entry), "stop" if hit_stop else "target"))
                    side = 0
                    continue
            if not side and r.signal and r.stop == r.stop and r.target == r.target:
                side, entry, stop, target, since = int(r.signal), float(r.close), float(r.stop), float(r.target), int(r.us)
        state.update((side, entry, stop, target, since))
        yield pd.DataFrame(out, columns=["symbol", "side", "entry_us", "exit_us", "entry_price", "exit_price", "pnl_points", "exit_reason"])

    s = signals.select("symbol", F.unix_micros("timestamp_utc").alias("us"), "high", "low", "close", "signal", "stop", "target")
    return s.groupBy("symbol").applyInPandasWithState(step, "symbol string, side int, entry_us long, exit_us long, entry_price double, exit_price double, pnl_points double, exit_reason string", "side int, entry double, stop double, target double, since long", "append", GroupStateTimeout.NoTimeout)


def run_once(query: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into Parquet files below ``folder``, which all executors share, and returns its rows.

    Appended rows go to files that are written exactly once. Other modes emit a row again as it changes, so every batch goes to a folder of
    its own, replaced if it is repeated, and carries its number as ``batch``.
    """
    w = query.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{folder}/rows")
    else:
        q = w.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    q.awaitTermination()
    return query.sparkSession.read.schema(query.schema if mode == "append" else query.schema.add("batch", "long")).parquet(f"{folder}/rows")
