"""Joins in time.

As-of joins are one union, one shuffle and one running window: the last right row is carried to each left row. Where an
entity is too large for one window, ``block`` cuts time into blocks whose start rows are carried in, as in
tickloom.operators.attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Blocks of time into which the histories of an entity are cut.
MONTH_US = 30 * 86_400_000_000


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, left_ts: str = "timestamp_utc", right_ts: str = "timestamp_utc", prefix: str = "", block_us: int | None = None, strict: bool = False) -> DataFrame:
    """Left rows with ``values`` of the last right row at or before them (``strict``: before them), null without one.

    Of right rows at one time the one with the largest values wins. Null keys or times find nothing.
    """
    names = [f"{prefix}{v}" for v in values]
    payload = F.struct(*[F.col(v).alias(n) for v, n in zip(values, names)])
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("__t"), F.lit(1 if strict else 0).alias("__side"), payload.alias("__r"), F.lit(None).cast(left.schema).alias("__l"))
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"))  # noqa: E741
    parts = list(keys)
    if block_us:
        block = F.floor(F.unix_micros("__t") / block_us)
        r, l = r.withColumn("__b", block), l.withColumn("__b", block)  # noqa: E741
        at = F.struct("__t", "__r")
        blocks = r.groupBy(*keys, "__b").agg(F.max(at).alias("__x")).unionByName(l.select(*keys, "__b").distinct().withColumn("__x", F.lit(None).cast(r.select(at).schema[0].dataType)))
        blocks = blocks.groupBy(*keys, "__b").agg(F.max("__x").alias("__x"))
        carry = blocks.withColumn("__x", F.last("__x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).where("__x is not null")
        carry = carry.select(*keys, F.timestamp_micros(F.col("__b") * block_us).alias("__t"), F.lit(-1).alias("__side"), F.col("__x.__r").alias("__r"), F.lit(None).cast(left.schema).alias("__l"), "__b")
        r, parts = r.unionByName(carry), [*keys, "__b"]
    w = Window.partitionBy(*parts).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(l).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    return both.select("__l.*", *[F.col(f"__r.{n}").alias(n) for n in names])


def higher_timeframe(left: DataFrame, right: DataFrame, values: list[str], prefix: str, keys: list[str] | None = None, block_us: int = MONTH_US) -> DataFrame:
    """Columns of the last COMPLETED higher-timeframe bar: right values are shifted by one bar first, so nothing looks ahead."""
    keys = keys or ["symbol"]
    w = Window.partitionBy(*keys).orderBy("timestamp_utc")
    shifted = right.select(*keys, "timestamp_utc", *[F.lag(v).over(w).alias(v) for v in values])
    return asof_backward(left, shifted, keys, values, prefix=prefix, block_us=block_us)


def safe_prefix(timeframe: str) -> str:
    """A prefix that is an identifier: 60m to tf60m, daily as it is."""
    name = "".join(c if c.isalnum() else "_" for c in timeframe)
    return f"tf{name}" if name[:1].isdigit() else name


def daily_projection(left: DataFrame, daily: DataFrame, values: list[str], prefix: str = "daily_", keys: list[str] | None = None) -> DataFrame:
    """Values of the trade date before: shifted by one daily row, then joined on (keys, trade_date)."""
    keys = keys or ["symbol"]
    w = Window.partitionBy(*keys).orderBy("trade_date")
    return left.join(daily.select(*keys, "trade_date", *[F.lag(v).over(w).alias(f"{prefix}{v}") for v in values]), [*keys, "trade_date"], "left")


def containing_bar(points: DataFrame, bars: DataFrame, *, ts: str, keys: list[str] | None = None, block_us: int = MONTH_US) -> DataFrame:
    """The bar each point falls in: the last at or before it, or the first bar of its key."""
    keys = keys or ["symbol"]
    found = asof_backward(points, bars.select(*keys, "timestamp_utc", F.col("timestamp_utc").alias("bar_ts")), keys, ["bar_ts"], left_ts=ts, block_us=block_us)
    first = bars.groupBy(*keys).agg(F.min("timestamp_utc").alias("__first"))
    return found.join(first, keys, "left").withColumn("bar_ts", F.coalesce("bar_ts", "__first")).drop("__first")


def nearest_event(points: DataFrame, events: DataFrame, *, day: str, event_day: str = "event_date") -> DataFrame:
    """Days from each point to the nearest event, positive before it; the earlier event on a tie, null without events or day.

    The events before and after are looked up for the distinct days of the points, of which a century has 36,525, and joined back on
    the day; neither points nor events gather anywhere.
    """
    days = points.select(F.col(day).alias("__d")).where("__d is not null").distinct().withColumn("__e", F.lit(None).cast("date"))
    both = days.unionByName(events.select(F.col(event_day).cast("date").alias("__d"), F.col(event_day).cast("date").alias("__e")).where("__d is not null").distinct())
    w = Window.orderBy("__d")
    both = both.withColumns({"__p": F.last("__e", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "__n": F.first("__e", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    near = F.when(F.col("__n").isNull() | (F.datediff("__d", "__p") <= F.datediff("__n", "__d")), F.col("__p")).otherwise(F.col("__n"))
    near = both.where("__e is null").select("__d", near.alias("event_date"))
    return points.join(near, F.col(day) == F.col("__d"), "left").withColumn("days_to_event", F.datediff("event_date", F.col(day))).drop("__d")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, left_ts: str, right_ts: str = "timestamp_utc", tolerance_us: int, prefix: str = "", block_us: int = 6 * 3_600_000_000) -> DataFrame:
    """Left rows with ``values`` of the right row nearest in time within the tolerance, the earlier one on a tie, null without one.

    Rows are cut into blocks of time, a right row lying in the block of either end of its tolerance, so one window serves a bounded
    stretch of an entity. Of right rows at one time the one with the smallest values wins. Left rows keep their columns.
    """
    if block_us < 2 * tolerance_us:
        raise ValueError("blocks must be at least twice the tolerance")
    names = [f"{prefix}{v}" for v in values]
    us = F.unix_micros("__t")
    payload = F.struct(*[F.col(v).alias(n) for v, n in zip(values, names)])
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("__t"), F.lit(1).alias("__right"), payload.alias("__r"))
    r = r.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((us - tolerance_us) / block_us), F.floor((us + tolerance_us) / block_us)))))
    r = r.groupBy(*keys, "__t", "__b", "__right").agg(F.min("__r").alias("__r")).withColumn("__l", F.lit(None).cast(left.schema))
    lefts = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0).alias("__right"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"))
    lefts = lefts.withColumn("__b", F.floor(us / block_us))
    part = Window.partitionBy(*keys, "__b").orderBy("__t", F.col("__right").desc())
    hit = F.when(F.col("__right") == 1, F.struct(us.alias("us"), F.col("__r").alias("r")))
    both = r.unionByName(lefts).withColumn("__h", hit)
    both = both.withColumns({"__p": F.last("__h", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__n": F.first("__h", ignorenulls=True).over(part.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    dp, dn = us - F.col("__p.us"), F.col("__n.us") - us
    pick = F.when((dp <= tolerance_us) & (dn.isNull() | (dp <= dn)), F.col("__p.r")).when(dn <= tolerance_us, F.col("__n.r"))
    return both.where("__right = 0").withColumn("__x", pick).select("__l.*", *[F.col(f"__x.{n}").alias(n) for n in names])
