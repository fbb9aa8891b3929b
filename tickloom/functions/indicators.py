"""Indicators of bar series: rolling and cumulative ones as windows, recursive ones as one pass over sorted groups.

Each function takes bars with (symbol, timeframe, timestamp_utc, open, high, low, close, volume, ...) and returns them with
columns added. Warm-up rows are null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ewm import series_map, smooth, span_alpha, wilder_alpha
from tickloom.functions.nulls import ratio
from tickloom.operators.grid import trade_date

KEYS, ORDER = ["symbol", "timeframe"], ["timestamp_utc"]


def series():
    """The window of one series in order of time."""
    return Window.partitionBy(*KEYS).orderBy(*ORDER)


def rolling(n: int, lag: int = 0):
    return series().rowsBetween(-(n - 1) - lag, -lag)


def full(value: Column, of: Column, n: int, lag: int = 0) -> Column:
    """``value`` where the frame of n rows has n readings of ``of``."""
    return F.when(F.count(of).over(rolling(n, lag)) == n, value)


def sma(df: DataFrame, n: int = 20, column: str = "close", out: str | None = None) -> DataFrame:
    c = F.col(column)
    return df.withColumn(out or f"sma_{n}", full(F.avg(c).over(rolling(n)), c, n))


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    c = F.col("close")
    mid, dev = full(F.avg(c).over(rolling(n)), c, n), full(F.stddev_samp(c).over(rolling(n)), c, n)
    df = df.withColumns({"bb_mid": mid, "__dev": dev})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + width * F.col("__dev"), "bb_lower": F.col("bb_mid") - width * F.col("__dev")})
    span = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_pct_b": ratio(c - F.col("bb_lower"), span), "bb_width": ratio(span, F.col("bb_mid"))}).drop("__dev")


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumns({"donchian_upper": full(F.max("high").over(rolling(n)), F.col("high"), n), "donchian_lower": full(F.min("low").over(rolling(n)), F.col("low"), n)})
    return df.withColumn("donchian_mid", (F.col("donchian_upper") + F.col("donchian_lower")) / 2)


def order_flow_imbalance(df: DataFrame, n: int = 14) -> DataFrame:
    raw = ratio((F.col("buy_volume") - F.col("sell_volume")).cast("double"), (F.col("buy_volume") + F.col("sell_volume")).cast("double"))
    df = df.withColumn("__ofi", raw)
    return df.withColumn(f"ofi_{n}", full(F.avg("__ofi").over(rolling(n)), F.col("__ofi"), n)).drop("__ofi")


def true_range(df: DataFrame, out: str = "true_range") -> DataFrame:
    before = F.lag("close").over(series())
    return df.withColumn(out, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def _ema(x: np.ndarray, n: int) -> np.ndarray:
    y = smooth(x, span_alpha(n))
    y[: n - 1] = np.nan
    return y


def _range(get) -> np.ndarray:
    h, l, c = get("high"), get("low"), get("close")  # noqa: E741
    before = np.r_[np.nan, c[:-1]]
    return np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before)))


def _atr(get, n: int) -> np.ndarray:
    y = smooth(_range(get), wilder_alpha(n))
    y[:n] = np.nan
    return y


def _rsi(get, n: int) -> np.ndarray:
    d = np.diff(get("close"), prepend=np.nan)
    gain, loss = smooth(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), wilder_alpha(n)), smooth(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), wilder_alpha(n))
    with np.errstate(all="ignore"):
        y = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
    y[np.isnan(loss)] = np.nan
    y[:n] = np.nan
    return y


def _adx(get, n: int) -> dict[str, np.ndarray]:
    up, down = np.diff(get("high"), prepend=np.nan), -np.diff(get("low"), prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    a = wilder_alpha(n)
    tr = smooth(_range(get), a)
    with np.errstate(all="ignore"):
        p, m = 100 * smooth(plus, a) / np.where(tr == 0, np.nan, tr), 100 * smooth(minus, a) / np.where(tr == 0, np.nan, tr)
        dx = 100 * np.abs(p - m) / np.where(p + m == 0, np.nan, p + m)
    y = smooth(dx, a)
    y[: 2 * n] = np.nan
    return {"plus_di": p, "minus_di": m, f"adx_{n}": y}


def _macd(get, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, np.ndarray]:
    c = get("close")
    line = smooth(c, span_alpha(fast)) - smooth(c, span_alpha(slow))
    sig = smooth(line, span_alpha(signal))
    out = {"macd": line, "macd_signal": sig, "macd_hist": line - sig}
    for y in out.values():
        y[: slow + signal - 1] = np.nan
    return out


def _macd_state(h: np.ndarray) -> dict[str, np.ndarray]:
    """From a MACD histogram: above zero, slope, bars since its sign changed, and its run towards (negative) or away from zero.

    Zero counts as below in runs; a side of zero starts at +1, rises go up from there, falls down from -1; equal sizes leave the run as it is.
    """
    n = len(h)
    known = ~np.isnan(h)
    before = np.r_[np.nan, h[:-1]]
    first = np.maximum.accumulate(np.where(known & ~np.r_[False, known[:-1]] | known & (np.sign(h) != np.sign(before)), np.arange(n), -1)) if n else np.zeros(0, int)
    since = np.where(known, np.arange(n) - first, np.nan)
    streak = np.full(n, np.nan)
    run, above, size = 0, None, 0.0
    for i in np.flatnonzero(known).tolist():
        v = h[i]
        if above is None or (v > 0) != above:
            run = 1
        elif abs(v) > size:
            run = run + 1 if run > 0 else 1
        elif abs(v) < size:
            run = run - 1 if run < 0 else -1
        above, size = v > 0, abs(v)
        streak[i] = run
    return {"macd_hist_slope": h - before, "bars_since_zero_cross": since, "decline_streak": streak}


def recursive(df: DataFrame, *, ema: tuple[int, ...] = (), atr: int | None = None, rsi: int | None = None, adx: int | None = None, macd: bool = False, state: bool = False) -> DataFrame:
    """All recursive indicators asked for in one pass over each series; ``state`` adds what the MACD histogram has been doing."""
    names = [f"ema_{n}" for n in ema] + ([f"atr_{atr}"] if atr else []) + ([f"rsi_{rsi}"] if rsi else []) + (["plus_di", "minus_di", f"adx_{adx}"] if adx else []) + (["macd", "macd_signal", "macd_hist"] if macd or state else [])
    names += ["macd_hist_slope", "bars_since_zero_cross", "decline_streak"] if state else []

    def run(get):
        out = {f"ema_{n}": _ema(get("close"), n) for n in ema}
        if atr:
            out[f"atr_{atr}"] = _atr(get, atr)
        if rsi:
            out[f"rsi_{rsi}"] = _rsi(get, rsi)
        if adx:
            out |= _adx(get, adx)
        if macd or state:
            out |= _macd(get)
        if state:
            out |= _macd_state(out["macd_hist"])
        return out

    out = series_map(df, KEYS, ORDER, run, names)
    return out.withColumn("macd_hist_above_zero", F.coalesce(F.col("macd_hist") > 0, F.lit(False))) if state else out


def vwaps(df: DataFrame, gap_minutes: int = 60, widths: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Session, weekly and monthly VWAP (and the session's deviations) in one pass over each series, as the functions below give them one by one."""
    day = trade_date(F.col("timestamp_utc"))
    df = df.withColumns({"__us": F.unix_micros("timestamp_utc"), "__week": F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day), "__month": F.year(day) * 100 + F.month(day)})
    bands = [f"vwap_session_band_{str(w).replace('.', '_')}" for w in widths]

    def parts(x, v, starts):
        edge = [*np.flatnonzero(starts).tolist(), len(x)]
        mean, sd = np.empty(len(x)), np.empty(len(x))
        with np.errstate(all="ignore"):
            for a, b in zip(edge, edge[1:]):
                y, w = x[a:b] - x[a], v[a:b]
                total = np.cumsum(w)
                total[total == 0] = np.nan
                m = np.cumsum(y * w) / total
                mean[a:b] = x[a] + m
                sd[a:b] = np.sqrt(np.maximum(np.cumsum(y * y * w) / total - m * m, 0.0))
        return mean, sd

    def run(get):
        x, v = get("close"), get("volume")
        change = lambda a: np.r_[True, a[1:] != a[:-1]]
        session, sd = parts(x, v, np.r_[True, np.diff(get("__us")) > gap_minutes * 60e6])
        return {"vwap_session": session, **{b: sd * w for b, w in zip(bands, widths)}, "vwap_weekly": parts(x, v, change(get("__week")))[0], "vwap_monthly": parts(x, v, change(get("__month")))[0]}

    return series_map(df, KEYS, ORDER, run, ["vwap_session", *bands, "vwap_weekly", "vwap_monthly"]).drop("__us", "__week", "__month")


def session_vwap(df: DataFrame, gap_minutes: int = 60, widths: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0)) -> DataFrame:
    """VWAP of closes since the last pause longer than ``gap_minutes``, with widths of its deviation.

    Sums are taken of closes less the session's first, so the variance does not cancel.
    """
    gap = F.unix_micros("timestamp_utc") - F.lag(F.unix_micros("timestamp_utc")).over(series())
    df = df.withColumn("session_id", F.sum(F.coalesce((gap > gap_minutes * 60_000_000).cast("int"), F.lit(0))).over(series()))
    return _vwap(df, ["session_id"], "vwap_session", widths)


def _vwap(df: DataFrame, group: list[str], out: str, widths: tuple[float, ...] = ()) -> DataFrame:
    run = Window.partitionBy(*KEYS, *group).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__x0", F.first("close").over(run)).withColumn("__x", F.col("close") - F.col("__x0"))
    v = F.sum(F.col("volume").cast("double")).over(run)
    mean = ratio(F.sum(F.col("__x") * F.col("volume")).over(run), v)
    df = df.withColumn("__m", mean).withColumn(out, F.col("__x0") + F.col("__m"))
    if widths:
        var = ratio(F.sum(F.col("__x") * F.col("__x") * F.col("volume")).over(run), v) - F.col("__m") * F.col("__m")
        df = df.withColumn("__sd", F.sqrt(F.greatest(var, F.lit(0.0))))
        df = df.withColumns({f"{out}_band_{str(w).replace('.', '_')}": F.col("__sd") * w for w in widths}).drop("__sd")
    return df.drop("__x0", "__x", "__m")


def weekly_vwap(df: DataFrame) -> DataFrame:
    day = trade_date(F.col("timestamp_utc"))
    df = df.withColumns({"__y": F.extract(F.lit("YEAROFWEEK"), day), "__w": F.weekofyear(day)})
    return _vwap(df, ["__y", "__w"], "vwap_weekly").drop("__y", "__w")


def monthly_vwap(df: DataFrame) -> DataFrame:
    df = df.withColumn("__month", F.trunc(trade_date(F.col("timestamp_utc")), "MM"))
    return _vwap(df, ["__month"], "vwap_monthly").drop("__month")


def cci(df: DataFrame, n: int = 14) -> DataFrame:
    """Commodity channel index: distance of the typical price from its mean in 0.015 mean absolute deviations."""
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    tp, frame = F.col("__tp"), F.collect_list("__tp").over(rolling(n))
    df = df.withColumns({"__mean": full(F.avg(tp).over(rolling(n)), tp, n), "__frame": frame})
    dev = F.expr(f"aggregate(__frame, cast(0 as double), (a, x) -> a + abs(x - __mean)) / {n}")
    return df.withColumn(f"cci_{n}", ratio(tp - F.col("__mean"), 0.015 * dev)).drop("__tp", "__mean", "__frame")


def percentile_rank(df: DataFrame, column: str, window: int = 22_680, least: int = 20, out: str = "percentile_rank") -> DataFrame:
    """Share of the last ``window`` rows (missing ones included) that are below the current value; null under ``least`` readings."""

    def run(get):
        x = get(column)
        y = np.full(len(x), np.nan)
        import bisect

        sorted_, n = [], 0
        for i, v in enumerate(x.tolist()):
            if v == v:
                bisect.insort(sorted_, v)
            if i >= window and x[i - window] == x[i - window]:
                del sorted_[bisect.bisect_left(sorted_, x[i - window])]
            n = min(i + 1, window)
            if v == v and len(sorted_) >= least:
                y[i] = bisect.bisect_left(sorted_, v) / n
        return {out: y}

    return series_map(df, KEYS, ORDER, run, [out])


def day_range_used(df: DataFrame) -> DataFrame:
    """(close - first open) over the range so far, per New York calendar date."""
    day = F.to_date(F.from_utc_timestamp("timestamp_utc", "America/New_York"))
    df = df.withColumn("__day", day)
    run = Window.partitionBy(*KEYS, "__day").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = ratio(F.col("close") - F.first("open").over(run), F.max("high").over(run) - F.min("low").over(run))
    return df.withColumn("daily_range_used", used).drop("__day")
