"""Broker payloads to bars, fetch windows, and the layered Parquet store."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "Open string, High string, Low string, Close string, TotalVolume string, Volume string, UpVolume string, DownVolume string, UpTicks string, DownTicks string, TotalTicks string, TimeStamp string"



def normalise_payload(records: DataFrame, payload: str = "payload", strict: bool = False) -> DataFrame:
    """Adds open, high, low, close, volume and order flow from JSON texts whose numbers may be text.

    TotalVolume counts before Volume; absent order flow is null, never zero. ``strict`` fails on a missing price or volume,
    otherwise such rows have ``valid`` false.
    """
    p = F.from_json(payload, PAYLOAD)
    r = records.withColumn("__p", p)
    num = lambda k: F.col(f"__p.{k}").try_cast("double")
    whole = lambda k: F.col(f"__p.{k}").try_cast("double").cast("bigint")
    r = r.withColumns({"open": num("Open"), "high": num("High"), "low": num("Low"), "close": num("Close"), "volume": F.coalesce(whole("TotalVolume"), whole("Volume")), "buy_volume": whole("UpVolume"), "sell_volume": whole("DownVolume"), "up_ticks": whole("UpTicks"), "down_ticks": whole("DownTicks"), "total_ticks": whole("TotalTicks")})
    valid = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & F.col("volume").isNotNull()
    r = r.withColumn("valid", valid).drop("__p")
    if strict:
        r = r.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.lit("a bar lacks a price or its volume")).cast("boolean")))
    return r


def fetch_windows(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """Windows of ``days`` covering [start, end], each starting a second after the one before ended."""
    step = days * 86_400 + 1
    s, e = (int(datetime.fromisoformat(x).replace(tzinfo=timezone.utc).timestamp()) for x in (start, end))
    return spark.range((e - s) // step + 1).select((F.lit(s) + F.col("id") * step).alias("first"), F.least(F.lit(s) + F.col("id") * step + days * 86_400, F.lit(e)).alias("last"))


def window_key(symbol: str, first: int, last: int) -> str:
    """Name of a window's checkpoint, so that a download resumes where it broke off."""
    return hashlib.sha256(f"{symbol}|{first}|{last}".encode()).hexdigest()[:16]


def write_layer(df: DataFrame, root: str, layer: str, parameters: dict, sources: list[dict] | None = None, partitions: tuple[str, ...] = ("symbol",)) -> str:
    """Writes a layer as Parquet, replacing only the partitions at hand, with a manifest beside it."""
    path = f"{root}/{layer}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    stats = footer_stats(df.sparkSession, path)
    doc = {"layer": layer, "path": path, "parameters": {k: str(v) for k, v in parameters.items()}, "sources": sources or [], "built_at": datetime.now(timezone.utc).isoformat(), **stats}
    df.sparkSession.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return path


def footer_stats(spark: SparkSession, path: str, ts: str = "timestamp_utc") -> dict:
    """Row count and span of a Parquet table; only one column is read."""
    r = spark.read.parquet(path).agg(F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("z")).first()
    return {"row_count": r["n"], "date_range": {"start": str(r["a"]), "end": str(r["z"])}}


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    from tickloom.operators.registry import MANIFEST

    return spark.read.text(pattern).select(F.from_json("value", MANIFEST + ", path string").alias("m")).select("m.*")


def read_logs(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """JSON lines under day=YYYY-MM-DD folders; malformed lines are dropped, other days are not opened."""
    schema = "timestamp string, level string, event string, run_id string, symbol string, stage string, action string, outcome string, _bad string"
    logs = spark.read.schema(schema + ", day string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(root)
    if days:
        logs = logs.where(F.col("day").isin(*days))
    return logs.where(F.col("_bad").isNull() & F.col("event").isNotNull()).drop("_bad")
