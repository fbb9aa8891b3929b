from datetime import timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tests.helpers import BARS, frame, walk
from tickloom.operators.grid import regular_series


def brute(rows):
    seen: dict = {}
    for r in rows:
        if r[9] is not None and r[4] is not None:
            per = 60 if r[3] == "1m" else 300
            day = (r[4] + timedelta(hours=6)).astimezone(ZoneInfo("America/New_York")).date()
            seen.setdefault((r[2], r[3], day), set()).add(int(r[4].timestamp()) // per * per)
    out = set()
    for (c, tf, _), s in seen.items():
        out |= {(c, x) for x in range(min(s), max(s), 60 if tf == "1m" else 300) if x not in s}
    return out


def test_missing_periods_and_fill(spark):
    rows = walk(900, 2, "AAA")
    keep = [r for i, r in enumerate(rows) if not (200 <= i < 230 or i % 37 == 0)]
    keep[5][9] = None
    keep[6][9] = float("nan")
    other = [[5000 + i, "B", "BBB", "5m", r[4], None, *r[6:]] for i, r in enumerate(rows[:300:5]) if i not in (7, 8)]
    data = [*keep, *other, list(keep[3])]
    series = regular_series(frame(spark, data)).toPandas()
    nan = [[*r[:9], None if r[9] is not None and r[9] != r[9] else r[9], *r[10:]] for r in data]
    miss = series[series.is_missing]
    assert set(zip(miss.contract, miss.slot_start)) == brute(nan)
    assert miss.close.notna().all() and miss.volume.notna().all()
    truth = {(r[2], int(r[4].timestamp())): r[9] for r in rows}
    err = [abs(c - truth[("AAA", s)]) for k, s, c in zip(miss.contract, miss.slot_start, miss.close) if ("AAA", s) in truth and k == "AAA" and truth[("AAA", s)] is not None]
    assert len(err) > 40 and sorted(err)[len(err) // 2] < 5
    kept = series[~series.is_missing]
    assert not kept.duplicated(["contract", "slot_start"]).any() and len(kept) + len(miss) == len(series)


def test_wild_values_do_not_steer(spark):
    rows = walk(300, 3)
    gap = [r for i, r in enumerate(rows) if not 100 <= i < 105]
    gap[99][9] *= 100
    s = regular_series(frame(spark, gap)).where("is_missing").toPandas()
    assert len(s) == 5 and ((s.close > 950) & (s.close < 1050)).all()


def test_edges(spark):
    rows = walk(3)
    rows[0][4] = None
    rows[1][2] = None
    rows[2][3] = "odd"
    assert regular_series(frame(spark, rows)).count() == 0
    assert regular_series(spark.createDataFrame([], BARS)).count() == 0
    one = frame(spark, walk(1)).withColumn("gr_day", F.lit(1)).withColumn("beta", F.lit(1))
    assert regular_series(one).count() == 1
    two = walk(10)
    pair = regular_series(frame(spark, [two[0], two[9]])).where("is_missing").toPandas()
    assert len(pair) == 8 and pair.close.notna().all()
