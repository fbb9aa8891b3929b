from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tickloom.operators.timestamps import clock_corrections, normalise_timestamps

RECORDS = "record_id long, time_stamp string, contract string, bar_no int, feed_id long"
FEEDS = [(1, "America/New_York", "MDY"), (2, "Europe/London", "DMY"), (3, "Asia/Kolkata", "DMY"), (4, None, None), (5, "Asia/Tokyo", "YMD")]


def got(spark, rows):
    r = spark.createDataFrame(rows, RECORDS)
    f = spark.createDataFrame(FEEDS, "feed_id long, home_zone string, date_order string")
    return {x["row_id"]: (x["timestamp_utc"], x["timestamp_ny"]) for x in normalise_timestamps(r, f).collect()}


def one(spark, cases):
    out = got(spark, [(i, text, f"c{i}", 1, feed) for i, (text, feed, _) in enumerate(cases)])
    for i, (text, _, want) in enumerate(cases):
        assert out.get(i, (None,))[0] == want, text


def test_forms(spark):
    one(spark, [
        ("2024-03-07T12:43:01", 1, "2024-03-07 17:43:01.000000"), ("  2024-03-07 12:43:01,5 ", 1, "2024-03-07 17:43:01.500000"), ("\t03/07/2024 1:05:02 pm", 1, "2024-03-07 18:05:02.000000"),
        ("07/03/2024 12:05:02 am", 2, "2024-03-07 00:05:02.000000"), ("07/03/24 12:05", 2, "2024-03-07 12:05:00.000000"), ("2024/03/07 23:59:59", 5, "2024-03-07 14:59:59.000000"),
        ("20240307T124301Z", 1, "2024-03-07 12:43:01.000000"), ("20240307124301", 1, "2024-03-07 17:43:01.000000"), ("10-Mar-2024 16:51:02", 3, "2024-03-10 11:21:02.000000"),
        ("Mar 7, 2024 1:17:00 PM", 1, "2024-03-07 18:17:00.000000"), ("Sun, 03 Nov 2024 03:25:00 -0500", 2, "2024-11-03 08:25:00.000000"), ("2024-03-10T08:55:02-04:00[America/New_York]", 2, "2024-03-10 12:55:02.000000"),
        ("1709413800", 1, "2024-03-02 21:10:00.000000"), ("1709413800456", 1, "2024-03-02 21:10:00.456000"), ("1709413800456703", 1, "2024-03-02 21:10:00.456703"), ("1709413800456703855", 1, "2024-03-02 21:10:00.456703"),
        ("/Date(1711037821305-0500)/", 1, "2024-03-21 16:17:01.305000"), ("2024-03-07 07:21:02 EST", 1, "2024-03-07 12:21:02.000000"), ("2024-03-07 07:21:02 IST", 3, "2024-03-07 01:51:02.000000"),
        ("2024-07-07 07:21:02 BST", 2, "2024-07-07 06:21:02.000000"), ("2024-11-03t11:55:00z", 1, "2024-11-03 11:55:00.000000"), ("2024-11-03 18:00:00.620557089 UTC", 1, "2024-11-03 18:00:00.620557"),
        ("1600-02-29 00:00:00Z", 1, "1600-02-29 00:00:00.000000"), ("2024-03-07T12:43:01+05:30", 4, "2024-03-07 07:13:01.000000"),
    ])


def test_no_time(spark):
    bad = ["", " ", "null", "pending", "--:--", "2024-03", "2024-02-30T10:15:00Z", "2024-06-14T25:61:00Z", "0000-00-00 00:00:00", "2023-02-29 00:00:00", "13/13/2024 10:00:00", "03/07/2024 13:05:02 pm", "2024-03-07 07:21:02 QQQ", "x" * 100_000, "2024-03-10 02:30:00"]
    one(spark, [(b, 1, None) for b in bad] + [(None, 1, None), ("2024-03-07 10:00:00", 4, None), ("2024-03-07 10:00:00", None, None)])


def test_every_day_against_the_standard_library(spark):
    rows, want = [], {}
    t = datetime(1971, 1, 1, 0, 30)
    i = 0
    while t.year < 2037:
        rows.append((i, t.strftime("%Y-%m-%d %H:%M:%S"), f"c{i}", 1, 2))
        want[i] = t.replace(tzinfo=ZoneInfo("Europe/London")).astimezone(timezone.utc)
        i, t = i + 1, t + timedelta(days=37, hours=5, minutes=13)
    out = got(spark, rows)
    assert {k: v.strftime("%Y-%m-%d %H:%M:%S.%f") for k, v in want.items()} == {k: v[0] for k, v in out.items()}
    assert all(datetime.fromisoformat(v[0]).replace(tzinfo=timezone.utc).astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%d %H:%M:%S.%f") == v[1] for v in out.values())


def test_doubled_readings_keep_the_order_of_bars(spark):
    zone, start = ZoneInfo("America/New_York"), datetime(2024, 11, 3, 3, 0, tzinfo=timezone.utc)
    rows, want = [], {}
    for n in range(60):
        u = start + timedelta(minutes=5 * n)
        if 30 < n < 36:
            continue
        rows.append((n, u.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), "c", n, 1))
        want[n] = u.strftime("%Y-%m-%d %H:%M:%S.%f")
    assert {k: v[0] for k, v in got(spark, rows).items()} == want
    # a second file repeats bars in a coarser spelling, and nulls do not hurt
    again = [(1000 + r[0], r[1][:16].replace("-", "")[:8] + "T" + r[1][11:13] + r[1][14:16] + "00", "c", r[3], 1) for r in rows]
    out = got(spark, [*rows, *again, (5000, "2024-11-03 01:30:00", None, None, 1), (5001, "2024-11-03 01:30:00", "c", None, 1)])
    assert all(out[1000 + k][0][:16] == v[:16] for k, v in want.items())
    assert out[5000][0] == "2024-11-03 05:30:00.000000"


def test_extra_columns_and_empty(spark):
    f = spark.createDataFrame(FEEDS, "feed_id long, home_zone string, date_order string").withColumn("tsn_zone", F.lit("x"))
    r = spark.createDataFrame([(1, "2024-03-07T12:43:01Z", "c", 1, 1)] * 2, RECORDS).withColumn("tsn_zone", F.lit("y")).withColumn("us", F.lit(3))
    assert normalise_timestamps(r, f).count() == 2
    assert normalise_timestamps(r.limit(0), f.limit(0)).count() == 0


def test_clock_corrections(spark):
    u = datetime(2024, 3, 10, 12, 0, tzinfo=timezone.utc)
    rows = [(1, u, datetime(2024, 3, 10, 8, 0)), (2, u, datetime(2024, 3, 10, 7, 0)), (3, u, None), (4, None, datetime(2024, 3, 10, 8, 0))]
    b = spark.createDataFrame(rows, "bar_id long, timestamp_utc timestamp, timestamp_ny timestamp_ntz")
    out = {r["row_id"]: r["timestamp_ny"] for r in clock_corrections(b).collect()}
    assert out == {2: "2024-03-10 08:00:00.000000", 3: "2024-03-10 08:00:00.000000"}
    assert clock_corrections(b.limit(0)).count() == 0
