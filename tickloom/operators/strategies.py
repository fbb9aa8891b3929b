"""Signals from declared rules and coded templates.

A signal frame is bars with ``signal`` (-1, 0, 1), ``stop`` and ``target`` (null = none). Rules compile to columns, so Catalyst
sees them whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.expressions import Compiler
from tickloom.functions.nulls import holds

TEMPLATES: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def template(name: str):
    def register(f):
        if name in TEMPLATES:
            raise ValueError(f"template {name!r} exists")
        TEMPLATES[name] = f
        return f

    return register


def _minutes(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 60 + int(m)


def in_window(start: str, end: str) -> Column:
    """UTC time of day in [start, end); windows over midnight are not wrapped."""
    t = F.hour("timestamp_utc") * 60 + F.minute("timestamp_utc")
    return (t >= _minutes(start)) & (t < _minutes(end))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < math.inf), c)


def _side(rules: dict | None, compiler: Compiler) -> Column:
    """all: every rule; any: one of them, and all those of ``all``; neither: never."""
    every, some = (rules or {}).get("all") or [], (rules or {}).get("any") or []
    if not every and not some:
        return F.lit(False)
    out = F.lit(True)
    for text in every:
        out = out & compiler.condition(text)
    if some:
        one = F.lit(False)
        for text in some:
            one = one | compiler.condition(text)
        out = out & one
    return out


def combine(df: DataFrame, long: Column, short: Column, stop: tuple[Column, Column], target: tuple[Column | None, Column | None], allowed: Column | None = None) -> DataFrame:
    """Signals from both sides: both at once is none, an entry without a finite stop is none."""
    allowed = F.lit(True) if allowed is None else holds(allowed)
    df = df.withColumns({"__l": holds(long) & allowed, "__s": holds(short) & allowed})
    raw = F.when(F.col("__l") & ~F.col("__s"), 1).when(F.col("__s") & ~F.col("__l"), -1).otherwise(0)
    df = df.withColumn("__d", raw)
    none = F.lit(None).cast("double")
    pick = lambda pair: F.when(F.col("__d") == 1, none if pair[0] is None else finite(pair[0])).when(F.col("__d") == -1, none if pair[1] is None else finite(pair[1]))
    df = df.withColumns({"stop": pick(stop), "target": pick(target)})
    kept = F.when((F.col("__d") != 0) & F.col("stop").isNotNull(), F.col("__d")).otherwise(0)
    df = df.withColumn("signal", kept.cast("int")).drop("__l", "__s", "__d")
    return df.withColumns({"stop": F.when(F.col("signal") != 0, F.col("stop")), "target": F.when(F.col("signal") != 0, F.col("target"))})


def from_rules(bars: DataFrame, config: dict, regimes: list[Column] | None = None) -> DataFrame:
    """Signals of a declared strategy: {knobs, entry: {long, short, time_window}, exits: {stop, target}}."""
    compiler = Compiler(bars.columns, config.get("knobs") or {}, ind.series())
    entry, exits = config["entry"], config["exits"]
    window = entry.get("time_window")
    allowed = in_window(window["start_utc"], window["end_utc"]) if window else F.lit(True)
    for r in regimes or []:
        allowed = allowed & holds(r)
    level = lambda kind, side: compiler.column(exits[kind][side]) if (exits.get(kind) or {}).get(side) else None
    stops = (level("stop", "long"), level("stop", "short"))
    return combine(bars, _side(entry.get("long"), compiler), _side(entry.get("short"), compiler), stops, (level("target", "long"), level("target", "short")), allowed)


def dispatch(bars: DataFrame, config: dict) -> DataFrame:
    """A configuration names exactly one of ``entry`` and ``template``."""
    kinds = [k for k in ("entry", "template") if config.get(k)]
    if len(kinds) != 1:
        raise ValueError(f"exactly one of entry and template, not {kinds}")
    if kinds == ["entry"]:
        return from_rules(bars, config)
    if config["template"] not in TEMPLATES:
        raise ValueError(f"unknown template {config['template']!r}")
    return TEMPLATES[config["template"]](bars, config.get("knobs") or {})


def need(bars: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def volatility_regime(bars: DataFrame, percentile: float, keys: list[str], column: str = "atr_14") -> DataFrame:
    """Adds ``calm``: 0 < ATR <= its percentile over the rows flagged ``train``. The thresholds are one row per key."""
    if not 50 <= percentile <= 95:
        raise ValueError("percentile must be from 50 to 95")
    limits = bars.where(F.col("train")).groupBy(*keys).agg(F.percentile(column, F.lit(percentile / 100)).alias("__limit"))
    out = bars.join(limits, keys, "left")
    return out.withColumn("calm", holds((F.col(column) > 0) & (F.col(column) <= F.col("__limit")))).drop("__limit")


@template("always-flat")
def always_flat(bars: DataFrame, knobs: dict) -> DataFrame:
    none = F.lit(None).cast("double")
    return bars.withColumns({"signal": F.lit(0), "stop": none, "target": none})


@template("vwap-reversion")
def vwap_reversion(bars: DataFrame, knobs: dict) -> DataFrame:
    """Fades closes far from the session VWAP in ATRs, 12-17 UTC, not in the first hour of the session."""
    need(bars, "close", "vwap_session", "atr_14")
    k = {"threshold": 2.2, "stop": 2.5, "target": 0.3, "blackout": 60, "open_et": "18:00"} | knobs
    z = (F.col("close") - F.col("vwap_session")) / F.nullif(F.col("atr_14"), F.lit(0.0))
    local = F.from_utc_timestamp("timestamp_utc", "America/New_York")
    since = F.pmod(F.hour(local) * 60 + F.minute(local) - _minutes(k["open_et"]), F.lit(1440))
    atr = F.col("atr_14")
    return combine(bars, z < -k["threshold"], z > k["threshold"], (F.col("close") - k["stop"] * atr, F.col("close") + k["stop"] * atr), (F.col("vwap_session") - k["target"] * atr, F.col("vwap_session") + k["target"] * atr), in_window("12:00", "17:00") & (since >= k["blackout"]))


@template("vwap-reversion-adx")
def vwap_reversion_adx(bars: DataFrame, knobs: dict) -> DataFrame:
    need(bars, "close", "vwap_session", "atr_14", "adx_14")
    k = {"entry": 1.5, "stop": 1.5, "adx_max": 22.0} | knobs
    atr, c, v = F.col("atr_14"), F.col("close"), F.col("vwap_session")
    quiet = F.col("adx_14") < k["adx_max"]
    return combine(bars, (c < v - k["entry"] * atr) & quiet, (c > v + k["entry"] * atr) & quiet, (c - k["stop"] * atr, c + k["stop"] * atr), (v, v), in_window("12:00", "17:00"))


@template("donchian-breakout")
def donchian_breakout(bars: DataFrame, knobs: dict) -> DataFrame:
    """Closes beyond the channel before, with the daily trend; an ATR bracket."""
    need(bars, "close", "donchian_upper", "donchian_lower", "atr_14", "daily_ema_50", "daily_ema_200")
    k = {"stop": 2.0, "target": 3.0} | knobs
    c, atr = F.col("close"), F.col("atr_14")
    up, down = F.lag("donchian_upper").over(ind.series()), F.lag("donchian_lower").over(ind.series())
    bull = F.col("daily_ema_50") > F.col("daily_ema_200")
    return combine(bars, (c > up) & bull, (c < down) & (F.col("daily_ema_50") < F.col("daily_ema_200")), (c - k["stop"] * atr, c + k["stop"] * atr), (c + k["target"] * atr, c - k["target"] * atr))


@template("band-reversion")
def band_reversion(bars: DataFrame, knobs: dict) -> DataFrame:
    """Closes beyond a VWAP band in regular hours with the daily bias; a crossing of the VWAP exits by an opposing signal."""
    need(bars, "close", "vwap_session", "vwap_session_band_1_0", "atr_14", "daily_macd_hist")
    k = {"sigma": 2.0, "stop": 2.0} | knobs
    c, v, atr = F.col("close"), F.col("vwap_session"), F.col("atr_14")
    width = k["sigma"] * F.col("vwap_session_band_1_0")
    return combine(bars, (c < v - width) & (F.col("daily_macd_hist") > 0), (c > v + width) & (F.col("daily_macd_hist") < 0), (c - k["stop"] * atr, c + k["stop"] * atr), (v, v), in_window("13:20", "20:00"))


@template("macd-pullback")
def macd_pullback(bars: DataFrame, knobs: dict) -> DataFrame:
    """With the daily and hourly MACD, after a falling streak of the own histogram; entries are suppressed where ``blackout`` holds."""
    need(bars, "close", "atr_14", "macd_hist", "decline_streak", "daily_macd_hist", "tf60m_macd_hist", "tf60m_macd_hist_slope")
    k = {"streak": 3, "stop": 2.0} | knobs
    c, atr, h = F.col("close"), F.col("atr_14"), F.col("macd_hist")
    tired = F.col("decline_streak") <= -k["streak"]
    long = (F.col("daily_macd_hist") > 0) & (F.col("tf60m_macd_hist") > 0) & (F.col("tf60m_macd_hist_slope") >= 0) & (h < 0) & tired
    short = (F.col("daily_macd_hist") < 0) & (F.col("tf60m_macd_hist") < 0) & (F.col("tf60m_macd_hist_slope") <= 0) & (h > 0) & tired
    clear = ~holds(F.col("blackout")) if "blackout" in bars.columns else None
    return combine(bars, long, short, (c - k["stop"] * atr, c + k["stop"] * atr), (None, None), clear)


def position_size(equity: float, risk_share: float, risk_points: Column, point_value: Column | float) -> Column:
    """Contracts whose risk is a share of the equity, at least one; none without equity."""
    if equity <= 0:
        return F.lit(0)
    return F.greatest(F.lit(1), F.floor(F.lit(equity * risk_share) / F.nullif(F.abs(risk_points) * (point_value if isinstance(point_value, Column) else F.lit(point_value)), F.lit(0.0)))).cast("int")


def lint(bars: DataFrame, config: dict) -> list[str]:
    """Warnings about a configuration from the share of bars it signals on."""
    n, hits = dispatch(bars, config).agg(F.count("*"), F.count_if(F.col("signal") != 0)).first()
    if not n or not hits:
        return ["no bar gives a signal"]
    return ["more than four bars in five give a signal"] if hits > 0.8 * n else []
