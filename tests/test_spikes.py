from pyspark.sql import functions as F

from tests.helpers import BARS, at, frame, walk
from tickloom.operators.spikes import false_readings, frozen, price_filter

import numpy as np


def found(df):
    return {(r["bar_id"], r["field"]) for r in false_readings(df).collect()}


def test_plain_series_has_none(spark):
    assert found(frame(spark, walk(600))) == set()


def test_spikes_of_each_field(spark):
    rows = walk(600)
    rows[100][9] += 60.0  # close, outside its bar
    rows[200][7] += 60.0  # high
    rows[300][8] -= 60.0  # low
    rows[400][10] = 99_999_999
    rows[450][10] = -5
    rows[500][7], rows[500][8] = rows[500][8] - 0.25, rows[500][7] + 0.25  # crossed
    want = {(101, "close"), (201, "high"), (301, "low"), (401, "volume"), (451, "volume"), (501, "high"), (501, "low")}
    assert found(frame(spark, rows)) == want


def test_scaled_bar_and_zero(spark):
    rows = walk(600)
    for k in (6, 7, 8, 9):
        rows[250][k] /= 100
    rows[350][8] = 0.0
    assert found(frame(spark, rows)) == {(251, "high"), (251, "low"), (251, "close"), (351, "low")}


def test_true_jump_lasts_and_is_none(spark):
    rows = walk(600)
    for r in rows[300:]:
        for k in (6, 7, 8, 9):
            r[k] += 80.0
    assert found(frame(spark, rows)) == set()


def test_burst_of_volume_is_none(spark):
    rows = walk(600)
    for i, f in enumerate((4, 9, 7, 5, 3)):
        rows[300 + i][10] *= f
        rows[300 + i][11] = rows[300 + i][12] = None
    assert found(frame(spark, rows)) == set()


def test_frozen_bars_and_copies(spark):
    rows = walk(600)
    for r in rows[301:330]:
        r[6:10] = rows[300][6:10]
        r[6] = rows[300][9] + 0.25
    for r in rows[300:330]:
        r[6:10] = [rows[300][9] + 0.25, rows[300][9] + 1.0, rows[300][9] - 1.0, rows[300][9]]
    copy = list(rows[310])
    copy[0] = 9001
    hits = found(frame(spark, [*rows, copy]))
    assert {(i, f) for i in range(302, 331) for f in ("high", "low", "close")} <= hits
    assert (9001, "close") in hits and (301, "close") not in hits


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = walk(120)
    rows[10][9] = None
    rows[11][4] = None
    rows[12][2] = None
    rows[13][10] = None
    rows[14][6] = rows[14][7] = rows[14][8] = None
    rows[15][3] = "weekly"
    rows[50][9] += 60
    rows.append(list(rows[50]))
    df = frame(spark, rows).withColumn("sp_us", F.lit(7)).withColumn("field", F.lit("x"))
    assert found(df) == {(51, "close")}
    assert found(spark.createDataFrame([], BARS)) == set()


def test_blocks_do_not_change_verdicts(spark, monkeypatch):
    import tickloom.operators.spikes as s

    rows = walk(900)
    for i in (150, 450, 700):
        rows[i][9] += 60.0
    df = frame(spark, rows)
    whole = found(df)
    monkeypatch.setattr(s, "BLOCK_PERIODS", 256)
    monkeypatch.setattr(s, "OVERLAP_PERIODS", 64)
    assert found(df) == whole == {(151, "close"), (451, "close"), (701, "close")}


def test_filter_on_few_bars():
    us = np.arange(2) * 60_000_000
    assert not any(x.any() for x in price_filter(us, *(np.array([1.0, 1.0]),) * 4, 6e7))
    assert not frozen(np.array([1.0, 1.0]), False).any()
    assert at(1) > at(0)
