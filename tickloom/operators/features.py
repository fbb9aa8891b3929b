"""The feature table of a declared feature set: bars of a timeframe with indicators, VWAPs and daily values."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.operators import asof, resample
from tickloom.operators.grid import trade_date

#: Feature sets as data: a list of (name, kind, parameters) and what they extend. Further sets are added by the caller.
BASE_V1 = {"name": "base-v1", "features": [{"kind": "atr", "n": 14}, {"kind": "rsi", "n": 14}, {"kind": "adx", "n": 14}, {"kind": "bollinger", "n": 20}, {"kind": "macd"}, {"kind": "donchian", "n": 20}, {"kind": "sma", "n": 200}, {"kind": "ofi", "n": 14}, {"kind": "vwap"}], "daily": [{"kind": "ema", "n": 20}, {"kind": "ema", "n": 50}, {"kind": "ema", "n": 200}, {"kind": "atr", "n": 14}, {"kind": "adx", "n": 14}, {"kind": "macd"}]}
BASE_V2 = {"name": "base-v2", "extends": "base-v1", "features": [{"kind": "ema", "n": 9}, {"kind": "ema", "n": 20}, {"kind": "cci", "n": 14}], "daily": []}


def resolve(spec: dict, known: dict[str, dict]) -> dict:
    """A set with what it extends, the parent's features first."""
    if "extends" not in spec:
        return spec
    parent = resolve(known[spec["extends"]], known)
    return {"name": spec["name"], "features": parent["features"] + spec["features"], "daily": parent["daily"] + spec["daily"]}


def feature_hash(spec: dict, code_version: str = "") -> str:
    """Sixteen hexadecimal digits of a set's canonical form; the order of its features does not matter."""
    form = {k: sorted(spec[k], key=lambda f: json.dumps(f, sort_keys=True)) for k in ("features", "daily")} | {"name": spec["name"], "code": code_version}
    return hashlib.blake2b(json.dumps(form, sort_keys=True, separators=(",", ":")).encode(), digest_size=8).hexdigest()


def _apply(df: DataFrame, features: list[dict]) -> DataFrame:
    of = lambda kind: [f for f in features if f["kind"] == kind]
    one = lambda kind: (of(kind) or [{}])[0].get("n")
    if of("ema") or of("atr") or of("rsi") or of("adx") or of("macd"):
        df = ind.recursive(df, ema=tuple(dict.fromkeys(f["n"] for f in of("ema"))), atr=one("atr"), rsi=one("rsi"), adx=one("adx"), state=bool(of("macd")))
    for f in of("sma"):
        df = ind.sma(df, f["n"])
    for f in of("bollinger"):
        df = ind.bollinger(df, f["n"])
    for f in of("donchian"):
        df = ind.donchian(df, f["n"])
    for f in of("ofi"):
        df = ind.order_flow_imbalance(df, f["n"])
    for f in of("cci"):
        df = ind.cci(df, f["n"])
    return df


def at_open(rows: DataFrame, minutes: int, names: list[str]) -> DataFrame:
    """(symbol, timestamp_utc, names): the values at each bar's open, of the last base bar whose minute has begun by then.

    That is one of the bar's first minute, or else the last of the bar before: an aggregate per bar and a look back, no join with the rows.
    """
    value, first = F.struct(*names), F.floor(F.unix_seconds("timestamp_utc") / 60) * 60 == F.unix_seconds("__s")
    b = rows.withColumn("__s", resample.bucket(F.col("timestamp_utc"), minutes))
    per = b.groupBy("symbol", "__s").agg(F.max_by(value, F.when(first, F.col("timestamp_utc"))).alias("__at"), F.max_by(value, "timestamp_utc").alias("__last"))
    per = per.withColumn("__v", F.coalesce("__at", F.lag("__last").over(Window.partitionBy("symbol").orderBy("__s"))))
    return per.select("symbol", F.col("__s").alias("timestamp_utc"), "__v.*")


def build(base: DataFrame, minutes: int, spec: dict, known: dict[str, dict] | None = None) -> DataFrame:
    """Features of all symbols at once. VWAPs run on the base bars and are taken at each bar's open; daily values are of the day before."""
    spec = resolve(spec, known or {"base-v1": BASE_V1, "base-v2": BASE_V2})
    bars = _apply(resample.resample(base, minutes), spec["features"])
    if any(f["kind"] == "vwap" for f in spec["features"]):
        v = ind.vwaps(base)
        names = ["vwap_session", "vwap_session_band_1_0", "vwap_session_band_2_0", "vwap_weekly", "vwap_monthly"]
        bars = bars.join(at_open(v, minutes, names), ["symbol", "timestamp_utc"], "left")
    if spec["daily"]:
        d = _apply(resample.resample_daily(base), spec["daily"])
        made = [c for c in d.columns if c not in ("symbol", "trade_date", "timeframe", "timestamp_utc", "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "up_ticks", "down_ticks", "total_ticks")]
        bars = asof.daily_projection(bars.withColumn("trade_date", trade_date(F.col("timestamp_utc"))), d, made)
    return bars
