"""Continuous series from contracts: calendar of rolls, stitching and additive back-adjustment."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTH_CODES = {3: "H", 6: "M", 9: "U", 12: "Z"}


def last_business_day(year: int, month: int) -> date:
    d = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    while d.weekday() > 4:
        d -= timedelta(days=1)
    return d


def business_days_before(d: date, n: int) -> date:
    while n:
        d -= timedelta(days=1)
        n -= d.weekday() < 5
    return d


def contract_calendar(spark: SparkSession, root: str, start: date, end: date) -> DataFrame:
    """Quarterly contracts: last trading day seven business days before the month's last, roll five before that; (contract, data_start, data_end, roll)."""
    rows, begin = [], start
    year, month = start.year, start.month
    while begin <= end:
        if month in MONTH_CODES:
            ltd = business_days_before(last_business_day(year, month), 7)
            roll = business_days_before(ltd, 5)
            if roll >= start:
                rows.append((f"{root}{MONTH_CODES[month]}{year % 100:02d}", begin, min(roll, end), roll))
                begin = roll
                if roll >= end:
                    break
        month += 1
        if month > 12:
            year, month = year + 1, 1
    return spark.createDataFrame(rows, "contract string, data_start date, data_end date, roll date")


def back_adjust(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """Additive (Panama) adjustment. Segments are (root, contract, seq, start_ts, end_ts), bars (root, contract, timestamp_utc, o/h/l/c).

    The delta of a roll is the next segment's first open from the roll on less this one's last close up to it; segment i gets the sum
    of its own and all later deltas. Keyed by contract, so an empty contract breaks nothing. One partial aggregation over the bars
    and windows over the few segments.
    """
    inside = bars.join(segments, ["root", "contract"]).where("timestamp_utc >= start_ts and timestamp_utc < end_ts")
    ends = inside.groupBy("root", "seq").agg(F.min_by("open", "timestamp_utc").alias("first_open"), F.max_by("close", "timestamp_utc").alias("last_close"))
    w = Window.partitionBy("root").orderBy("seq")
    ends = ends.withColumn("delta", F.coalesce(F.lead("first_open").over(w) - F.col("last_close"), F.lit(0.0)))
    later = Window.partitionBy("root").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("adjustment", F.sum("delta").over(later))
    out = inside.join(ends.select("root", "seq", "adjustment"), ["root", "seq"])
    return out.select("root", "contract", "seq", "timestamp_utc", *[(F.col(c) + F.col("adjustment")).alias(c) for c in ("open", "high", "low", "close")], "volume", "adjustment")


def session_calendar(spark: SparkSession, start: date, end: date, *, holidays: tuple[date, ...] = (), open_et: str = "18:00", close_et: str = "17:00") -> DataFrame:
    """Overnight sessions (trade_date, session_open, session_close) in UTC, without weekends, holidays and observed 19 June from 2022."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval 1 day)) as trade_date")
    return sessions_of(days, holidays=holidays, open_et=open_et, close_et=close_et)


def sessions_of(days: DataFrame, *, holidays: tuple[date, ...] = (), open_et: str = "18:00", close_et: str = "17:00") -> DataFrame:
    """The days (trade_date and other columns) that have an overnight session, with its session_open and session_close in UTC."""
    days = days.where("dayofweek(trade_date) between 2 and 6")
    june = F.make_date(F.year("trade_date"), F.lit(6), F.lit(19))
    observed = F.when(F.dayofweek(june) == 1, F.date_add(june, 1)).when(F.dayofweek(june) == 7, F.date_sub(june, 1)).otherwise(june)
    days = days.where(~((F.year("trade_date") >= 2022) & (F.col("trade_date") == observed)))
    if holidays:
        days = days.where(~F.col("trade_date").isin(*holidays))
    at = lambda d, t: F.to_utc_timestamp(F.to_timestamp(F.concat(d.cast("string"), F.lit(f" {t}:00"))), "America/New_York")
    return days.withColumns({"session_open": at(F.date_sub("trade_date", 1), open_et), "session_close": at(F.col("trade_date"), close_et)})
