"""Irregular bars to a regular series per contract, timeframe and trade date.

Missing periods are predicted by a harmonic seasonal regression with trend, log(close) and log(1+volume) on a constant,
a linear trend and two daily harmonics. Its normal equations are sums, so they are built where the rows are: per trade
date first, then shifted to the contract's own centre of time and added up per contract. Only those sums (27 numbers
per target) travel; the 6x6 systems are solved in Arrow batches. The prediction is then bridged: the residuals at the
observed period before and after a gap are interpolated linearly over it and added.

One shuffle by (contract, timeframe, trade date) serves the collapse to periods, the gap search and the daily sums. A
trade date has at most 1440 periods, so no group grows with the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.timestamps import NEW_YORK
from tickloom.runtime import barrier, table

HARMONICS = 2
DAY_S = 86_400
_Z = ["f"] + [f"{k}{h}" for h in range(1, HARMONICS + 1) for k in "sc"]
_PAIRS = [(a, b) for i, a in enumerate(_Z) for b in _Z[i:]]
#: Readings further than this from the day's median log stay in the series but do not steer fit or bridge.
WILD_LOG = 0.25
_COEF = "contract string, timeframe string, target string, centre double, beta array<double>"


def trade_date(ts: Column, zone: str = NEW_YORK) -> Column:
    """New York date of the instant plus six hours."""
    return F.to_date(F.from_utc_timestamp(ts + F.expr("INTERVAL 6 HOURS"), zone))


def period_seconds(timeframe: Column) -> Column:
    """Seconds of a label such as 1m, 5m or 1h; null for others."""
    n = F.nullif(F.regexp_extract(timeframe, r"^([0-9]+)[mh]$", 1), F.lit("")).try_cast("bigint")
    return F.when(n > 0, n * F.when(timeframe.endswith("h"), 3600).otherwise(60))


def _basis(slot: Column, day: Column) -> dict[str, Column]:
    """f: place within the trade date, in days (its UTC midnight is -0); s, c: daily harmonics."""
    phase = (slot % DAY_S) * (2 * math.pi / DAY_S)
    z = {"f": (slot - day * DAY_S) / DAY_S}
    for h in range(1, HARMONICS + 1):
        z |= {f"s{h}": F.sin(phase * h), f"c{h}": F.cos(phase * h)}
    return z


def observed_periods(bars: DataFrame) -> DataFrame:
    """One row per period with at least one bar with a non-null close; the last such bar by time, then bar_id, speaks for it."""
    col = F.col
    b = bars.select(col("contract").alias("gr_contract"), col("timeframe").alias("gr_tf"), col("timestamp_utc").alias("gr_ts"), F.nanvl(col("close"), F.lit(None).cast("double")).alias("gr_close"), col("volume").alias("gr_volume"), col("bar_id").alias("gr_id"))
    b = b.withColumn("gr_period", period_seconds(col("gr_tf"))).where(col("gr_close").isNotNull() & col("gr_ts").isNotNull() & col("gr_contract").isNotNull() & col("gr_period").isNotNull())
    b = b.withColumn("gr_day", F.unix_date(trade_date(col("gr_ts"))).cast("bigint"))
    b = b.withColumn("gr_slot", F.expr("(unix_seconds(gr_ts) div gr_period) * gr_period - if(unix_seconds(gr_ts) < 0 and unix_seconds(gr_ts) % gr_period <> 0, gr_period, 0)"))
    b = b.repartition("gr_contract", "gr_tf", "gr_day")
    last = F.max(F.struct("gr_ts", "gr_id", "gr_close", "gr_volume")).alias("gr_last")
    # the period is a key, so that every branch needs the same columns of the shuffle and they share one
    b = b.groupBy("gr_contract", "gr_tf", "gr_day", "gr_slot", "gr_period").agg(last)
    return b.select("gr_contract", "gr_tf", "gr_day", "gr_slot", "gr_period", col("gr_last.gr_close").alias("gr_close"), col("gr_last.gr_volume").alias("gr_volume"))


def _solve(batches):
    """Normal equations per (contract, timeframe, target) to coefficients; lightly ridged so flat or short series solve too."""
    for pdf in batches:
        if not len(pdf):
            continue
        g = lambda c: pdf[c].to_numpy(dtype="float64", na_value=0.0)
        names = ["1", "t", *_Z[1:]]
        a = np.zeros((len(pdf), len(names), len(names)))
        y = np.zeros((len(pdf), len(names)))
        for i, p in enumerate(names):
            y[:, i] = g(f"y_{p}")
            for j in range(i, len(names)):
                a[:, i, j] = a[:, j, i] = g(f"{p}_{names[j]}")
        scale = np.maximum(a[:, 0, 0], 1.0)
        a += np.eye(len(names))[None] * (1e-6 * scale)[:, None, None]
        beta = np.linalg.solve(a, y[:, :, None])[:, :, 0]
        yield pd.DataFrame({"contract": pdf["gr_contract"], "timeframe": pdf["gr_tf"], "target": pdf["gr_target"], "centre": pdf["centre"], "beta": list(beta)})


def _coefficients(seen: DataFrame) -> DataFrame:
    """Distributed normal equations. ``seen`` has gr_lc and gr_lv (logs, null where wild)."""
    col = F.col
    keys = ["gr_contract", "gr_tf", "gr_target"]
    long = seen.select("gr_contract", "gr_tf", "gr_day", "gr_slot", F.explode(F.array(F.struct(F.lit("close").alias("n"), col("gr_lc").alias("y")), F.struct(F.lit("volume").alias("n"), col("gr_lv").alias("y")))).alias("gr_x"))
    long = long.select("gr_contract", "gr_tf", "gr_day", col("gr_x.n").alias("gr_target"), col("gr_x.y").alias("y"), *[c.alias(n) for n, c in _basis(col("gr_slot"), col("gr_day")).items()]).where(col("y").isNotNull())
    sums = [F.count("*").cast("double").alias("n"), F.sum("y").alias("y_1")]
    sums += [F.sum(z).alias(f"1_{z}") for z in _Z] + [F.sum(col("y") * col(z)).alias(f"y_{z}") for z in _Z] + [F.sum(col(p) * col(q)).alias(f"{p}_{q}") for p, q in _PAIRS]
    daily = long.groupBy(*keys, "gr_day").agg(*sums)
    # trend t = (day - centre) + f, with the centre of time of the series: sums are shifted, rows are not read again
    of = Window.partitionBy(*keys)
    daily = daily.withColumn("centre", F.sum(col("gr_day") * col("n")).over(of) / F.sum("n").over(of)).withColumn("d", col("gr_day") - col("centre"))
    q = lambda p, r: col(f"{p}_{r}") if f"{p}_{r}" in daily.columns else col(f"{r}_{p}")
    h = _Z[1:]
    shifted = {"1_1": col("n"), "1_t": col("d") * col("n") + col("1_f"), "t_t": col("d") * col("d") * col("n") + 2 * col("d") * col("1_f") + col("f_f"), "y_1": col("y_1"), "y_t": col("d") * col("y_1") + col("y_f")}
    for z in h:
        shifted |= {f"1_{z}": col(f"1_{z}"), f"t_{z}": col("d") * col(f"1_{z}") + q("f", z), f"y_{z}": col(f"y_{z}")}
    for i, p in enumerate(h):
        for r in h[i:]:
            shifted[f"{p}_{r}"] = col(f"{p}_{r}")
    total = daily.select(*keys, "centre", *[c.alias(f"x_{n}") for n, c in shifted.items()]).groupBy(*keys).agg(F.first("centre").alias("centre"), *[F.sum(f"x_{n}").alias(n) for n in shifted])
    return total.mapInPandas(_solve, _COEF)


def _predicted(beta: Column, centre: Column, slot: Column, day: Column) -> Column:
    z = _basis(slot, day)
    terms = [F.lit(1.0), (day - centre) + z["f"], *[z[n] for n in _Z[1:]]]
    out = F.lit(0.0)
    for i, t in enumerate(terms):
        out = out + F.element_at(beta, i + 1) * t
    return out


def regular_series(bars: DataFrame) -> DataFrame:
    """(contract, timeframe, trade_date, slot_start, close, volume, is_missing): every period between a trade date's first and last.

    slot_start is seconds since 1970 UTC. Observed periods keep the close and volume of their last bar. Missing ones get the
    regression's value with bridged residuals; where no fit or bridge is possible (fewer than one usable reading beside
    the gap) the straight line between the closes around the gap. A period whose volume is null stays null when observed.
    Rows with null contract, time or close, or a timeframe that is no number of minutes or hours, are left out. Repeated bars
    fall into one period. An empty table gives an empty result. Columns other than contract, timeframe, timestamp_utc, close, volume
    and bar_id are ignored.
    """
    col = F.col
    day = Window.partitionBy("gr_contract", "gr_tf", "gr_day")
    run = day.orderBy("gr_slot")
    seen = observed_periods(bars)
    seen = seen.withColumns({"gr_lc": F.when(col("gr_close") > 0, F.ln("gr_close")), "gr_lv": F.when(col("gr_volume") >= 0, F.log1p(col("gr_volume").cast("double")))})
    seen = seen.withColumns({"gr_mc": F.median("gr_lc").over(day), "gr_mv": F.median("gr_lv").over(day)})
    seen = seen.withColumns({"gr_lc": F.when(F.abs(col("gr_lc") - col("gr_mc")) <= WILD_LOG, col("gr_lc")), "gr_lv": F.when(F.abs(col("gr_lv") - col("gr_mv")) <= 20 * WILD_LOG, col("gr_lv"))})
    nxt = {f"gr_next_{c}": F.lead(f"gr_{c}").over(run) for c in ("slot", "close", "lc", "lv")}
    gaps = seen.withColumns(nxt).where(col("gr_next_slot") > col("gr_slot") + col("gr_period"))
    fit = _coefficients(seen.select("gr_contract", "gr_tf", "gr_day", "gr_slot", "gr_lc", "gr_lv"))
    by_target = fit.groupBy("contract", "timeframe").agg(*[F.max(F.when(col("target") == t, F.struct("centre", "beta"))).alias(f"gr_fit_{t}") for t in ("close", "volume")])
    gaps = gaps.join(by_target, (gaps.gr_contract == by_target.contract) & (gaps.gr_tf == by_target.timeframe), "left").drop("contract", "timeframe")
    gaps = barrier(gaps.withColumn("gr_at", F.explode(F.expr("sequence(gr_slot + gr_period, gr_next_slot - gr_period, gr_period)"))))
    share = (col("gr_at") - col("gr_slot")) / (col("gr_next_slot") - col("gr_slot"))

    def bridged(name: str, y: str) -> Column:
        p = lambda slot: _predicted(col(f"gr_fit_{name}.beta"), col(f"gr_fit_{name}.centre"), slot, col("gr_day"))
        left, right = col(f"gr_{y}") - p(col("gr_slot")), col(f"gr_next_{y}") - p(col("gr_next_slot"))
        # one usable endpoint carries its residual over the gap
        residual = F.coalesce(left + (right - left) * share, left, right)
        return p(col("gr_at")) + residual

    line = col("gr_close") + (col("gr_next_close") - col("gr_close")) * share
    close = F.coalesce(F.nanvl(F.exp(bridged("close", "lc")), F.lit(None).cast("double")), line)
    volume = F.nanvl(F.round(F.expm1(bridged("volume", "lv"))), F.lit(None).cast("double"))
    names = [col("gr_contract").alias("contract"), col("gr_tf").alias("timeframe"), F.date_from_unix_date(col("gr_day").cast("int")).alias("trade_date")]
    filled = gaps.select(*names, col("gr_at").alias("slot_start"), close.alias("close"), F.greatest(volume, F.lit(0.0)).alias("volume"), F.lit(True).alias("is_missing"))
    kept = seen.select(*names, col("gr_slot").alias("slot_start"), col("gr_close").alias("close"), col("gr_volume").cast("double").alias("volume"), F.lit(False).alias("is_missing"))
    return kept.unionAll(filled)


def p6_found(spark, folder: str) -> DataFrame:
    """The filled periods of the regular series."""
    series = regular_series(table(spark, folder, "bars"))
    return series.where(F.col("is_missing") & F.col("close").isNotNull()).select("contract", "slot_start")


def p6_grid(spark, folder: str) -> DataFrame:
    """The whole regular series, observed and filled."""
    return regular_series(table(spark, folder, "bars"))
