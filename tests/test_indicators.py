import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, walk
from tickloom.functions import indicators as ind
from tickloom.functions.ewm import ewm, ewm_long, smooth, span_alpha
from tickloom.functions.nulls import differs, missing_as_null, ratio

KEY = ["symbol", "timestamp_utc"]


def bars(spark, n=260, seed=4):
    return frame(spark, walk(n, seed)).drop("symbol").withColumnRenamed("contract", "symbol").drop("timestamp_ny", "bar_id")


def table(df):
    return df.toPandas().sort_values(KEY).reset_index(drop=True)


def test_ewm_skips_and_decays_over_missing():
    y = smooth(np.array([np.nan, 1, np.nan, 2, np.nan, np.nan, 4]), 0.5)
    assert np.isnan(y[0]) and np.allclose(y[1:], [1, 1, 5 / 3, 5 / 3, 5 / 3, (0.125 * 5 / 3 + 0.5 * 4) / 0.625])


@pytest.mark.parametrize("minutes", [1, 7, 97, 5000])
def test_long_scan_equals_the_plain_one(spark, minutes):
    b = bars(spark).withColumn("day", F.to_date("timestamp_utc")).withColumn("half", F.minute("timestamp_utc") + 60 * F.hour("timestamp_utc"))
    b = b.withColumn("half", F.floor(F.col("half") / minutes))
    a = table(ewm(b, "close", span_alpha(12), "e", ["symbol"], ["timestamp_utc"]))
    c = table(ewm_long(b, "close", span_alpha(12), "e", ["symbol"], ["timestamp_utc"], block="half"))
    assert np.allclose(a.e, c.e, rtol=0, atol=1e-9) and len(a) == len(c)


def test_adx_against_a_loop(spark):
    p = table(ind.recursive(bars(spark), adx=14))
    h, l, c = (p[k].to_numpy() for k in ("high", "low", "close"))  # noqa: E741
    a, tr, pl, mi, dx = 1 / 14, [], [], [], []
    for i in range(len(p)):
        t = h[i] - l[i] if i == 0 else max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1]))
        u, d = (0, 0) if i == 0 else (h[i] - h[i - 1], l[i - 1] - l[i])
        x = (t, u if u > d and u > 0 else 0.0, d if d > u and d > 0 else 0.0)
        if i == 0:
            s = list(x)
        else:
            s = [(1 - a) * o + a * n for o, n in zip(s, x)]
        tr.append(s[0])
        q, r = 100 * s[1] / s[0], 100 * s[2] / s[0]
        dx.append(100 * abs(q - r) / (q + r) if q + r else np.nan)
    want = smooth(np.array(dx), a)
    assert p.adx_14[:28].isna().all() and np.allclose(p.adx_14[28:], want[28:])


def test_macd_state_against_a_loop(spark):
    p = table(ind.recursive(bars(spark, 400), state=True))
    since, streak, prev = None, None, None
    for i, h in enumerate(p.macd_hist):
        if np.isnan(h):
            assert pd.isna(p.bars_since_zero_cross[i]) and pd.isna(p.decline_streak[i]) and not p.macd_hist_above_zero[i]
            continue
        sign, side = np.sign(h), 1 if h > 0 else -1
        if prev is None or np.sign(prev) != sign:
            since = 0
        else:
            since += 1
        if prev is None or (1 if prev > 0 else -1) != side:
            streak = 1
        elif abs(h) > abs(prev):
            streak = streak + 1 if streak > 0 else 1
        elif abs(h) < abs(prev):
            streak = streak - 1 if streak < 0 else -1
        prev = h
        assert (p.bars_since_zero_cross[i], p.decline_streak[i]) == (since, streak)


@pytest.mark.parametrize("make", [ind.sma, ind.bollinger, ind.donchian, ind.order_flow_imbalance, ind.session_vwap, ind.weekly_vwap, ind.cci, ind.day_range_used, lambda d: ind.recursive(d, ema=(12,), atr=14, rsi=14, adx=14, macd=True)])
def test_nothing_looks_ahead(spark, make):
    b = bars(spark, 150)
    cut = b.where(F.col("timestamp_utc") <= b.agg(F.min("timestamp_utc")).first()[0] + pd.Timedelta(minutes=90))
    full, part = table(make(b)), table(make(cut))
    for c in part.columns:
        if c not in b.columns and part[c].dtype.kind == "f":
            assert np.allclose(full[c][: len(part)], part[c], equal_nan=True, rtol=1e-9), c


def test_nulls_and_empty(spark):
    b = bars(spark, 60)
    holes = b.withColumn("close", F.when(F.minute("timestamp_utc") % 7 != 3, F.col("close"))).withColumn("buy_volume", F.lit(None).cast("long"))
    p = table(ind.order_flow_imbalance(ind.bollinger(ind.sma(holes, 5))))
    assert p.ofi_14.isna().all() and p.sma_5.notna().any() and p.sma_5.isna().sum() > 20
    assert ind.recursive(b.limit(0), ema=(3,), adx=5).count() == 0
    assert ind.recursive(b.limit(0), state=True).count() == 0


def test_missing_value_helpers(spark):
    r = spark.sql("select cast('NaN' as double) as n, 1.0D as x, 0.0D as z, cast(null as double) as u")
    a = r.select(missing_as_null(F.col("n")).alias("a"), ratio(F.col("x"), F.col("z")).alias("b"), differs(F.col("x"), F.col("u")).alias("c")).first()
    assert a["a"] is None and a["b"] is None and a["c"] is True


def test_percentile_rank(spark):
    p = table(ind.percentile_rank(bars(spark, 80), "volume", 30, 5, "r"))
    v = p.volume.to_numpy()
    for i in range(80):
        w = v[max(0, i - 29) : i + 1]
        assert (np.isnan(p.r[i]) and len(w) < 5) or abs(p.r[i] - (w < v[i]).mean()) < 1e-12
