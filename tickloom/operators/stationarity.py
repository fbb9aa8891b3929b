"""Tests of mean reversion: ADF, Hurst by DFA and by rescaled range, Ornstein-Uhlenbeck half-life, and their verdicts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.special import normal_cdf_array
from tickloom.operators.ranks import before, block_of, places
from tickloom.operators.segments import map_sorted_groups

WINDOWS = [16, 32, 64, 128, 256, 512]
#: Response surfaces of the Dickey-Fuller distribution for one series: p = Phi(polynomial in the statistic). Fixed values.
_TAU = {"c": (-18.83, 2.74, -1.61, (2.1659, 1.4412, 3.8269e-2), (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)), "ct": (-16.18, 0.70, -2.89, (3.2512, 1.6047, 4.9588e-2), (2.5261, 6.1654e-1, -3.7956e-1, -6.0285e-2))}


def adf_p_value(stat: float, regression: str = "c") -> float:
    low, high, star, small, large = _TAU[regression]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    z = sum(b * stat**i for i, b in enumerate(small if stat <= star else large))
    return float(normal_cdf_array(np.array([z]))[0])


def _ols(x: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, float(e @ e)


def _design(y: np.ndarray, lags: int, regression: str, skip: int):
    d = np.diff(y)
    n = len(d) - skip
    cols = [y[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)] + [np.ones(n)]
    if regression == "ct":
        cols.append(np.arange(1.0, n + 1))
    return np.column_stack(cols), d[skip:]


def adf(y: np.ndarray, max_lag: int | None = None, regression: str = "c") -> tuple[float, float, int, int] | None:
    """(statistic, p value, lags, observations); lags by AIC unless given; None under twenty values or for a constant."""
    y = y[np.isfinite(y)]
    n = len(y)
    if n < 20 or np.ptp(y) == 0:
        return None
    terms = 1 if regression == "c" else 2
    if max_lag is None:
        most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - terms - 1))
        best = (math.inf, 0)
        for k in range(most + 1):
            x, d = _design(y, k, regression, most)
            _, ssr = _ols(x, d)
            m = len(d)
            aic = m * math.log(max(ssr, 1e-300) / m) + 2 * x.shape[1]
            best = min(best, (aic, k))
        lags = best[1]
    else:
        lags = max_lag
    x, d = _design(y, lags, regression, lags)
    beta, ssr = _ols(x, d)
    s2 = ssr / (len(d) - x.shape[1])
    se = math.sqrt(s2 * np.linalg.pinv(x.T @ x)[0, 0])
    stat = float(beta[0] / se) if se > 0 else -math.inf
    return stat, adf_p_value(stat, regression), lags, len(d)


def dfa(y: np.ndarray) -> tuple[float, float, int] | None:
    """(exponent, r squared, windows): slope of log fluctuation on log window after linear detrending of the integrated series."""
    y = y[np.isfinite(y)]
    z = np.cumsum(y - y.mean()) if len(y) else y
    got = []
    for w in WINDOWS:
        if 10 <= w <= len(z) // 2:
            seg = z[: len(z) // w * w].reshape(-1, w)
            t = np.arange(w) - (w - 1) / 2
            slope = seg @ t / (t @ t)
            res = seg - seg.mean(axis=1, keepdims=True) - slope[:, None] * t
            f = math.sqrt(float((res**2).mean()))
            if f > 0:
                got.append((math.log(w), math.log(f)))
    return _slope(got)


def rescaled_range(y: np.ndarray) -> tuple[float, float, int] | None:
    y = y[np.isfinite(y)]
    got = []
    for w in [8, *WINDOWS]:
        if w <= len(y):
            seg = y[: len(y) // w * w].reshape(-1, w)
            dev = np.cumsum(seg - seg.mean(axis=1, keepdims=True), axis=1)
            s = seg.std(axis=1, ddof=1)
            rs = (np.ptp(dev, axis=1)[s > 0] / s[s > 0])
            if len(rs) and rs.mean() > 0:
                got.append((math.log(w), math.log(rs.mean())))
    return _slope(got)


def _slope(points):
    if len(points) < 2:
        return None
    x, y = np.array(points).T
    x, y = x - x.mean(), y - y.mean()
    b = float(x @ y / (x @ x))
    return b, float((x @ y) ** 2 / ((x @ x) * (y @ y))) if y @ y > 0 else 1.0, len(points)


def tests(df: DataFrame, keys: list[str], order: list[str], value: str, regression: str = "c", max_lag: int | None = None) -> DataFrame:
    """ADF, DFA and rescaled range of each series, long: (keys, test, statistic, p_value, r_squared, n). Keys are text."""

    def run(t: pa.Table) -> pa.RecordBatch:
        y = t[value].to_numpy().astype("float64")
        a, d, r = adf(y, max_lag, regression), dfa(y), rescaled_range(y)
        rows = [("adf", a and a[0], a and a[1], None, a and a[3]), ("dfa", d and d[0], None, d and d[1], d and d[2]), ("rescaled_range", r and r[0], None, r and r[1], r and r[2])]
        cols = {k: [t[k][0].as_py()] * 3 for k in keys} | {n: [x[i] for x in rows] for i, n in enumerate(("test", "statistic", "p_value", "r_squared", "n"))}
        return pa.RecordBatch.from_pydict(cols, schema=pa.schema([(k, pa.string()) for k in keys] + [("test", pa.string()), ("statistic", pa.float64()), ("p_value", pa.float64()), ("r_squared", pa.float64()), ("n", pa.int64())]))

    return map_sorted_groups(df, keys, order, run, ", ".join(f"{k} string" for k in keys) + ", test string, statistic double, p_value double, r_squared double, n long")


def half_life(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Ornstein-Uhlenbeck half-life ln 2 / -beta from the regression of the change on the level before; built-in aggregates over a lag."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__p", F.lag(value).over(w)).withColumn("__d", F.col(value) - F.col("__p"))
    d = d.groupBy(*keys).agg(F.regr_slope("__d", "__p").alias("beta"), F.regr_r2("__d", "__p").alias("r_squared"), F.count("__d").alias("n"))
    return d.withColumn("half_life", F.when(F.col("beta") < -1e-10, F.lit(math.log(2)) / -F.col("beta"))).withColumn("kind", F.when(F.abs("beta") < 1e-10, "RANDOM_WALK").when(F.col("beta") >= 0, "TRENDING").otherwise("MEAN_REVERTING"))


def dfa_relational(df: DataFrame, keys: list[str], order: list[str], value: str, windows: list[int] | None = None) -> DataFrame:
    """DFA as joins and aggregates alone: rows fan out to their segment per window, residuals come from regression sums."""
    block = block_of(df, order[0])
    x = places(df, keys, order, block, "__i", "__n").withColumns({"__i": F.col("__i") - 1, "__b": block})
    part = x.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"), F.count(value).alias("__k"))
    part = part.withColumn("__m", F.sum("__s").over(Window.partitionBy(*keys)) / F.sum("__k").over(Window.partitionBy(*keys)))
    part = part.select(*keys, "__b", "__m", F.coalesce(F.sum(F.col("__s") - F.col("__k") * F.col("__m")).over(before(keys)), F.lit(0.0)).alias("__o"))
    x = x.join(part, [*keys, "__b"])
    x = x.withColumn("__z", F.col("__o") + F.sum(F.col(value) - F.col("__m")).over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    x = x.withColumn("w", F.explode(F.array(*map(F.lit, windows or WINDOWS)))).where("w >= 10 and w <= floor(__n / 2)").withColumn("seg", F.floor(F.col("__i") / F.col("w"))).where("(seg + 1) * w <= __n")
    x = x.withColumn("__t", (F.col("__i") % F.col("w")).cast("double"))
    s = x.groupBy(*keys, "w", "seg").agg((F.regr_syy("__z", "__t") - F.regr_sxy("__z", "__t") * F.regr_sxy("__z", "__t") / F.regr_sxx("__z", "__t")).alias("ss"))
    f = s.groupBy(*keys, "w").agg(F.sqrt(F.avg(F.greatest(F.col("ss"), F.lit(0.0)) / F.col("w"))).alias("f")).where("f > 0")
    return f.groupBy(*keys).agg(F.regr_slope(F.ln("f"), F.ln(F.col("w").cast("double"))).alias("exponent"), F.count("*").alias("windows"))


def adf_label(p: Column) -> Column:
    return F.when(p < 0.01, "STATIONARY (strong)").when(p < 0.05, "STATIONARY (weak)").when(p.isNotNull(), "NON_STATIONARY")


def hurst_label(h: Column) -> Column:
    return F.when(h.isNull(), "INSUFFICIENT_DATA").when(h < 0.40, "MEAN_REVERTING (strong)").when(h < 0.45, "MEAN_REVERTING (weak)").when(h <= 0.55, "RANDOM_WALK").when(h < 0.60, "TRENDING (weak)").otherwise("TRENDING (strong)")


def half_life_label(h: Column, lo: Column, hi: Column) -> Column:
    return F.when(h.isNull(), "TRENDING").when(lo.isNull() | hi.isNull(), "UNKNOWN_TIMEFRAME").when(h < lo, "TOO_FAST").when(h > hi, "TOO_SLOW").otherwise("TRADEABLE")


def series(bars: DataFrame, kind: str, minutes: int) -> DataFrame:
    """(symbol, timestamp_utc, x) of a timeframe: log returns, the log level of the close, or its spread over the session VWAP.

    The last bar of a period speaks for it; the VWAP is that of the bars themselves, taken with their close.
    """
    from tickloom.operators.resample import bucket

    b = ind.session_vwap(bars) if kind == "vwap_spread" else bars
    x = F.col("close") - F.col("vwap_session") if kind == "vwap_spread" else F.ln("close")
    one = b.withColumn("__x", x).groupBy("symbol", bucket(F.col("timestamp_utc"), minutes).alias("at")).agg(F.max_by("__x", "timestamp_utc").alias("x")).withColumnRenamed("at", "timestamp_utc")
    if kind == "log_return":
        one = one.withColumn("x", F.col("x") - F.lag("x").over(Window.partitionBy("symbol").orderBy("timestamp_utc")))
    elif kind not in ("log_level", "vwap_spread"):
        raise ValueError(f"unknown series {kind!r}")
    return one.where("x is not null")
