"""Market context of bars and regimes of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.nulls import ratio


def session_label(ts: Column) -> Column:
    """Trading session by New York hour."""
    h = F.hour(F.from_utc_timestamp(ts, "America/New_York"))
    return F.when((h >= 18) | (h < 3), "Asia").when(h < 8, "London").when(h < 9, "NY pre-open").when(h < 16, "NY RTH").when(h < 17, "NY close").otherwise("Overnight")


def context(bars: DataFrame) -> DataFrame:
    """Adds the session label and the distance to the session VWAP in ATRs."""
    return bars.withColumns({"session": session_label(F.col("timestamp_utc")), "vwap_distance_atr": ratio(F.col("close") - F.col("vwap_session"), F.col("atr_14"))})


def regime_tags(trades: DataFrame, *, atr_rank: str = "atr_rank", adx: str = "daily_adx", event_gap: str = "days_to_event") -> DataFrame:
    """Volatility, trend, weekday, month, quarter, week of month and event-distance tags; unknown inputs give unknown tags."""
    local = F.from_utc_timestamp("entry_ts", "America/New_York")
    rank, d = F.col(atr_rank), F.col(adx)
    gap = F.abs(F.col(event_gap))
    return trades.withColumns({
        "vol_regime": F.when(rank <= 0.33, "vol_low").when(rank <= 0.66, "vol_mid").when(rank.isNotNull(), "vol_high").otherwise("vol_unknown"),
        "trend_regime": F.when(d <= 20, "trend_weak").when(d <= 40, "trend_mid").when(d.isNotNull(), "trend_strong").otherwise("trend_unknown"),
        "dow": F.weekday(local), "month": F.month(local), "quarter": F.quarter(local), "week_of_month": F.floor((F.dayofmonth(local) - 1) / 7) + 1,
        "event_regime": F.when(gap == 0, "event_day").when(gap <= 1, "event_1d").when(gap <= 5, "event_week").when(gap.isNotNull(), "event_far").otherwise("event_unknown"),
    })
