"""Schemas of the engine's tables and the clean views every operator starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType([T.StructField(n, t, null) for n, t, null in (
    ("symbol", T.StringType(), False), ("timestamp_utc", T.TimestampType(), False), ("open", T.DoubleType(), False), ("high", T.DoubleType(), False),
    ("low", T.DoubleType(), False), ("close", T.DoubleType(), False), ("volume", T.LongType(), False), ("buy_volume", T.LongType(), True),
    ("sell_volume", T.LongType(), True), ("up_ticks", T.LongType(), True), ("down_ticks", T.LongType(), True), ("total_ticks", T.LongType(), True),
)])
TRADE = T.StructType([T.StructField(n, t) for n, t in (
    ("trade_id", T.StringType()), ("run_id", T.StringType()), ("symbol", T.StringType()), ("direction", T.StringType()), ("quantity", T.LongType()),
    ("entry_trigger_ts", T.TimestampType()), ("entry_ts", T.TimestampType()), ("entry_price", T.DoubleType()), ("exit_trigger_ts", T.TimestampType()),
    ("exit_ts", T.TimestampType()), ("exit_price", T.DoubleType()), ("exit_reason", T.StringType()), ("initial_stop", T.DoubleType()), ("initial_target", T.DoubleType()),
    ("pnl_points", T.DoubleType()), ("pnl_usd", T.DoubleType()), ("slippage_usd", T.DoubleType()), ("commission_usd", T.DoubleType()), ("net_pnl_usd", T.DoubleType()),
    ("mae_points", T.DoubleType()), ("mfe_points", T.DoubleType()),
)])
ORDER_FLOW = ["buy_volume", "sell_volume", "up_ticks", "down_ticks", "total_ticks"]


def keep_one(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the first by ``order``. Unlike dropDuplicates it says which."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: Why a delivered bar is no bar: it lacks its close, a price or volume contradicts what such a number is. The first that holds.
REASONS = [("null_close", "close is null"), ("crossed", "high is null or low is null or high < low"), ("no_volume", "volume is null or volume < 0")]
USABLE = " and ".join(f"not coalesce({c}, false)" for _, c in REASONS)


def left_out(bars: DataFrame) -> DataFrame:
    """Delivered bars with ``left_out``, the reason why clean_bars drops them: one of REASONS, redelivered, or null for those it keeps."""
    reason = F.coalesce(*[F.when(F.expr(c), F.lit(r)) for r, c in REASONS])
    b = bars.withColumn("left_out", reason)
    first = F.row_number().over(Window.partitionBy("contract", "timestamp_utc", F.col("left_out").isNull()).orderBy("bar_id")) > 1
    return b.withColumn("left_out", F.coalesce("left_out", F.when(first, F.lit("redelivered"))))


def clean_bars(bars: DataFrame) -> DataFrame:
    """Deliveries to bars: a close, ordered high and low, a volume, and one per (symbol, instant), the first delivered. A contract is a symbol.

    However large or negative a price, it stays; what is false for its contract is found by ``spikes.false_readings``. ``left_out`` says what is dropped.
    """
    return keep_one(bars.where(USABLE), ["contract", "timestamp_utc"], "bar_id").select(F.col("contract").alias("symbol"), "timeframe", "timestamp_utc", "open", "high", "low", "close", "volume", *ORDER_FLOW)


def clean_trades(trades: DataFrame) -> DataFrame:
    """Exports to trades: one per trade_id, the last exported; codes and reasons spelled one way."""
    one = keep_one(trades, ["trade_id"], F.col("exported_at").desc(), F.col("net_pnl_usd"))
    names = [f for f in TRADE.fieldNames() if f in one.columns and f not in ("symbol", "exit_reason")]
    return one.select(F.col("strategy_id").alias("run_id"), F.upper(F.trim("contract")).alias("symbol"), F.col("symbol").alias("root"), F.lower(F.trim("exit_reason")).alias("exit_reason"), *names)
