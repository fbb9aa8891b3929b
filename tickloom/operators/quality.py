"""Data quality of a bar series against a calendar of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.grid import trade_date
from tickloom.operators.islands import minute_runs
from tickloom.operators.resample import bucket
from tickloom.schema import USABLE

CHICAGO, NEW_YORK = "America/Chicago", "America/New_York"


def minute_of_day(ts: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


BAD = ["duplicates", "negative_volume", "high_below_low", "high_below_open", "high_below_close", "low_above_open", "low_above_close", "null_close"]


def _row_counts() -> list[Column]:
    col = F.col
    return [
        F.count("*").alias("rows"), F.count_if(col("volume") < 0).alias("negative_volume"), F.count_if(col("high") < col("low")).alias("high_below_low"),
        F.count_if(col("high") < col("open")).alias("high_below_open"), F.count_if(col("high") < col("close")).alias("high_below_close"), F.count_if(col("low") > col("open")).alias("low_above_open"),
        F.count_if(col("low") > col("close")).alias("low_above_close"), F.count_if(col("close").isNull()).alias("null_close"), F.count("buy_volume").alias("with_flow"),
    ]


def _judged(counts: DataFrame, *others: str) -> DataFrame:
    """Row counts per symbol with its number of instants to duplicates, order-flow coverage and verdict."""
    col = F.col
    out = counts.withColumn("duplicates", col("rows") - col("instants")).withColumn("order_flow_pct", F.round(100 * col("with_flow") / col("rows"), 2))
    return out.withColumn("passed", sum((col(b) for b in BAD[1:]), col(BAD[0])) == 0).select("symbol", "rows", *BAD, "order_flow_pct", "passed", *others)


def row_checks(bars: DataFrame) -> DataFrame:
    """One row per symbol: rows, duplicate instants, negative volumes, inversions, nulls, order-flow coverage, verdict. One pass."""
    return _judged(bars.groupBy("symbol").agg(*_row_counts(), F.count_distinct("timestamp_utc").alias("instants")))


def expected_minutes(sessions: DataFrame, minutes: int = 1) -> DataFrame:
    """Every instant of sessions (symbol, session_open, session_close): closed left, open right."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return sessions.where("session_close > session_open").select("symbol", F.explode(F.sequence("session_open", F.col("session_close") - step, step)).alias("timestamp_utc"))


def missing_minutes(bars: DataFrame, sessions: DataFrame, minutes: int = 1) -> DataFrame:
    """Left-anti: instants the calendar expects and the series lacks."""
    return expected_minutes(sessions, minutes).join(bars.select("symbol", "timestamp_utc").distinct(), ["symbol", "timestamp_utc"], "left_anti")


def unexpected_minutes(bars: DataFrame, sessions: DataFrame, minutes: int = 1) -> DataFrame:
    return bars.select("symbol", "timestamp_utc").distinct().join(expected_minutes(sessions, minutes), ["symbol", "timestamp_utc"], "left_anti")


def gap_kind(start: Column, n: Column, *, rth_open: int = 8 * 60 + 20, rth_close: int = 15 * 60, minor: int = 5, overnight: int = 60, maintenance: int = 30) -> tuple[Column, Column]:
    """(in_rth, kind) of a run of n missing instants: minor, maintenance (starting 17:00-17:30 Chicago), overnight or large."""
    ct, et = minute_of_day(start, CHICAGO), minute_of_day(start, NEW_YORK)
    in_rth = et.between(rth_open, rth_close)
    kind = (
        F.when(n <= minor, "minor")
        .when((n <= maintenance) & (ct >= 17 * 60) & (ct < 17 * 60 + 30), "maintenance")
        .when(~in_rth & (n <= overnight), "overnight")
        .otherwise("large")
    )
    return in_rth, kind


def classify_gaps(missing: DataFrame, *, minutes: int = 1, **limits: int) -> DataFrame:
    """Runs of missing instants with their ``gap_kind``, of which ``limits`` are the parameters."""
    runs = minute_runs(missing, ["symbol"], minutes=minutes).withColumnRenamed("n", "bars_missing")
    in_rth, kind = gap_kind(F.col("run_start"), F.col("bars_missing"), **limits)
    return runs.withColumns({"in_rth": in_rth, "kind": kind})


def session_coverage(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars per session; sessions without bars have zero. An equi-join on the session's days with a range filter, no nested loop."""
    day = lambda c: F.unix_date(F.to_date(c))
    s = sessions.withColumn("__d", F.explode(F.sequence(day("session_open"), day(F.col("session_close")))))
    b = bars.select("symbol", "timestamp_utc", day("timestamp_utc").alias("__d"))
    hit = s.join(b, ["symbol", "__d"]).where("timestamp_utc >= session_open and timestamp_utc < session_close").groupBy("symbol", "session_open").agg(F.count("*").alias("bars"))
    return sessions.join(hit, ["symbol", "session_open"], "left").fillna(0, ["bars"])


def _days(bars: DataFrame, frames: dict[str, int]) -> DataFrame:
    """One row per symbol and trade date of the delivered bars: instants, the first usable one, usable bars without an instant, and the periods that have bars, by timeframe.

    Of the usable bars of an instant the one with the least bar_id counts; one without bar_id comes last. One shuffle by symbol and trade date.
    """
    col = F.col
    b = bars.select("symbol", trade_date(col("timestamp_utc")).alias("trade_date"), "timestamp_utc", F.when(F.expr(USABLE), F.struct(col("bar_id").isNull().alias("last"), "bar_id", "timeframe")).alias("__bar"))
    b = b.repartition("symbol", "trade_date").groupBy("symbol", "trade_date", "timestamp_utc").agg(F.min("__bar").alias("__bar"))
    tf, ts = col("__bar.timeframe"), col("timestamp_utc")
    slots = [F.collect_set(F.when(tf == f, F.unix_seconds(bucket(ts, m)))).alias(f"slots_{f}") for f, m in frames.items()]
    return b.groupBy("symbol", "trade_date").agg(F.count(ts).alias("instants"), F.min(F.when(col("__bar").isNotNull(), F.unix_seconds(ts))).alias("first"), F.count_if(ts.isNull() & tf.isin(*frames)).alias("undated"), *slots)


def report(bars: DataFrame, sessions: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Per symbol the row checks of the delivered bars, missing and unexpected periods, large gaps, empty sessions, and the verdict: no bad rows, no large gaps in regular hours, no empty sessions.

    ``sessions`` (symbol, timeframe, trade_date, session_open, session_close) is the calendar of every series, ``frames`` has the minutes of the timeframes
    that are held against it period by period. Sessions are apart, so runs of missing periods end with them: they are the differences between the periods
    found on a trade date. The periods of the calendar are counted and never listed, and nothing is broadcast.
    """
    col, o, c = F.col, F.col("__open"), F.col("__close")
    cal = sessions.groupBy("symbol", "trade_date").agg(F.min(F.unix_seconds("session_open")).alias("__open"), F.min(F.unix_seconds("session_close")).alias("__close"), *[F.max(F.coalesce(col("timeframe") == f, F.lit(False))).alias(f"on_{f}") for f in frames])
    d = cal.join(_days(bars, frames), ["symbol", "trade_date"], "full_outer")
    counts = {"instants": col("instants"), "missing_periods": F.lit(0), "unexpected_periods": col("undated"), "large_gaps": F.lit(0), "large_gaps_rth": F.lit(0)}
    for f, minutes in frames.items():
        step, on, slots, hit, large = 60 * minutes, F.coalesce(f"on_{f}", F.lit(False)), col(f"slots_{f}"), col(f"hit_{f}"), col(f"large_{f}")
        n = F.ceil((c - o) / step)
        gaps = F.zip_with(F.concat(F.array(o - step), hit), F.concat(hit, F.array(o + n * step)), lambda a, b: F.struct((a + step).alias("start"), (F.floor((b - a) / step) - 1).alias("n")))  # noqa: B023
        kinds = lambda g: gap_kind(F.timestamp_seconds(g["start"]), g["n"])
        d = d.withColumn(f"slots_{f}", F.coalesce(slots, F.array().cast("array<bigint>")))
        d = d.withColumn(f"hit_{f}", F.when(on, F.sort_array(F.filter(slots, lambda s: (s >= o) & (s < c) & ((s - o) % step == 0)))).otherwise(F.array().cast("array<bigint>")))  # noqa: B023
        d = d.withColumn(f"large_{f}", F.when(on, F.filter(gaps, lambda g: kinds(g)[1] == "large")))  # noqa: B023
        counts["missing_periods"] += F.when(on, n - F.size(hit)).otherwise(0)
        counts["unexpected_periods"] = F.coalesce(counts["unexpected_periods"], F.lit(0)) + F.size(slots) - F.size(hit)
        counts["large_gaps"] += F.when(on, F.size(large)).otherwise(0)
        counts["large_gaps_rth"] += F.when(on, F.size(F.filter(large, lambda g: kinds(g)[0]))).otherwise(0)  # noqa: B023
    counts["unexpected_periods"] = F.when(col("symbol").isNotNull(), counts["unexpected_periods"])
    counts["empty_sessions"] = (o.isNotNull() & ~F.coalesce((col("first") >= o) & (col("first") < c), F.lit(False))).cast("int")
    both = bars.groupBy("symbol").agg(*_row_counts()).unionByName(d.select("symbol", *[v.alias(k) for k, v in counts.items()]), allowMissingColumns=True)
    sums = both.groupBy("symbol").agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in both.columns[1:]])
    out = _judged(sums, *[k for k in counts if k != "instants"])
    return out.withColumn("passed", col("passed") & (col("large_gaps_rth") == 0) & (col("empty_sessions") == 0))


def removed_share(bars: DataFrame) -> DataFrame:
    """(contract, delivered, removed, share): how much of what was delivered the clean view leaves out; redelivered bars are no loss."""
    from tickloom.schema import left_out

    out = left_out(bars).groupBy("contract").agg(F.count("*").alias("delivered"), F.count_if(F.col("left_out") != "redelivered").alias("removed"))
    return out.withColumn("share", F.col("removed") / F.col("delivered"))


def shift_breaks(bars: DataFrame, joined: DataFrame, value: str, period: Column) -> DataFrame:
    """(symbol, breaks): bars whose joined ``value`` is not the close of the last bar of an earlier ``period``, a number that grows with time.

    The close is found over the bars themselves, without the join under test; a bar the join lost counts too.
    """
    w = Window.partitionBy("symbol").orderBy("__p").rangeBetween(Window.unboundedPreceding, -1)
    want = bars.withColumn("__p", period).select("symbol", "timestamp_utc", F.max(F.struct("timestamp_utc", "close")).over(w)["close"].alias("__want"))
    got = joined.select("symbol", "timestamp_utc", F.col(value).alias("__got"))
    return want.join(got, ["symbol", "timestamp_utc"], "left").groupBy("symbol").agg(F.count_if(~F.col("__got").eqNullSafe(F.col("__want"))).alias("breaks"))


def bar_count_outliers(bars: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Bars per New York date, and whether that is beyond ``sigmas`` of the symbol's mean."""
    from pyspark.sql import Window

    day = bars.groupBy("symbol", F.to_date(F.from_utc_timestamp("timestamp_utc", NEW_YORK)).alias("day")).agg(F.count("*").alias("bars"))
    w = Window.partitionBy("symbol")
    day = day.withColumns({"mean_bars": F.avg("bars").over(w), "sd_bars": F.stddev_samp("bars").over(w)})
    return day.withColumn("outlier", F.coalesce(F.abs(F.col("bars") - F.col("mean_bars")) > sigmas * F.col("sd_bars"), F.lit(False)))
