"""Queries over bars: scans, shaping, bucketing, indicators, joins in time, quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.ewm import ewm_long, span_alpha, wilder_alpha
from tickloom.operators import asof, islands, quality, resample, stitch
from tickloom.operators.grid import trade_date
from tickloom.runtime import table
from tickloom.schema import clean_bars, clean_trades, keep_one, left_out

D = 6  # decimals compared


def _r(*names: str, d: int = D) -> list:
    return [F.round(n, d).alias(n) for n in names]


def bars_of(spark, folder):
    return clean_bars(table(spark, folder, "bars"))


ID = ["symbol", "timestamp_utc"]


# -- scans and shaping ---------------------------------------------------------------------------------------------------
def scan_projection(spark, folder):
    b = table(spark, folder, "bars").where((F.col("timestamp_utc") >= F.lit("2024-03-11").cast("timestamp")) & (F.col("timestamp_utc") <= F.lit("2024-03-15").cast("timestamp")))
    return b.select("bar_id", "contract", F.col("close").alias("bar_close"))


def scan_latest_file(spark, folder):
    return table(spark, folder, "raw_files").groupBy("contract").agg(F.max("path").alias("path"), F.max_by("file_id", "path").alias("file_id"))


def scan_stats(spark, folder):
    return table(spark, folder, "bars").agg(F.count("*").alias("rows"), F.min("timestamp_utc").alias("first_ts"), F.max("timestamp_utc").alias("last_ts"))


def scan_windows(spark, folder):
    """Fetch windows of 30 days, one second apart, per contract's span of bars."""
    span = table(spark, folder, "bars").groupBy("contract").agg(F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("b"))
    w = span.withColumn("i", F.explode(F.expr("sequence(0L, (unix_seconds(b) - unix_seconds(a)) div (2 * 86400 + 1))")))
    start = F.unix_seconds("a") + F.col("i") * (2 * 86400 + 1)
    return w.select("contract", start.alias("window_start"), F.least(start + 2 * 86400, F.unix_seconds("b")).alias("window_end"))


def shape_keep_first(spark, folder):
    return keep_one(table(spark, folder, "bars"), ["contract", "timestamp_utc"], "bar_id").select("bar_id", "contract")


def shape_keep_last(spark, folder):
    return keep_one(table(spark, folder, "bars"), ["contract", "timestamp_utc"], F.col("bar_id").desc()).select("bar_id", "contract")


def shape_clean_bars(spark, folder):
    return bars_of(spark, folder).select(*ID, "open", "high", "low", "close", "volume")


def dq_left_out(spark, folder):
    """Delivered bars per contract by why the clean view leaves them out, and how many it keeps."""
    return left_out(table(spark, folder, "bars")).groupBy("contract", F.coalesce("left_out", F.lit("kept")).alias("reason")).agg(F.count("*").alias("bars"))


def shape_largest_gaps(spark, folder):
    return islands.largest_gaps(bars_of(spark, folder), ["symbol"]).select("symbol", F.unix_micros("gap_end").alias("gap_end_us"), "gap_seconds", "rank")


def shape_rename_prefix(spark, folder):
    p = asof.safe_prefix("60m")
    return bars_of(spark, folder).select(*ID, *[F.col(c).alias(f"{p}_{c}") for c in ("open", "close")])


# -- bucketing -----------------------------------------------------------------------------------------------------------
OHLC = ["open", "high", "low", "close", "volume"]


def agg_resample_15m(spark, folder):
    return resample.resample(bars_of(spark, folder), 15).select(*ID, *OHLC, F.col("buy_volume").cast("double"), F.col("sell_volume").cast("double"))


def agg_resample_many(spark, folder):
    return resample.resample_many(bars_of(spark, folder), [5, 15, 60, 240]).select(*ID, "timeframe", *OHLC)


def agg_resample_daily(spark, folder):
    return resample.resample_daily(bars_of(spark, folder)).select("symbol", "trade_date", "timestamp_utc", *OHLC)


def agg_resample_close(spark, folder):
    return resample.resample_close(bars_of(spark, folder), 60)


def agg_bars_per_day(spark, folder):
    return quality.bar_count_outliers(bars_of(spark, folder)).select("symbol", "day", "bars", *_r("mean_bars", "sd_bars"), "outlier")


# -- indicators ----------------------------------------------------------------------------------------------------------
def ind_sma(spark, folder):
    return ind.sma(bars_of(spark, folder), 20).select(*ID, *_r("sma_20", d=9))


def ind_bollinger(spark, folder):
    return ind.bollinger(bars_of(spark, folder)).select(*ID, *_r("bb_mid", d=9), *_r("bb_upper", "bb_lower", d=6))


def ind_donchian(spark, folder):
    return ind.donchian(bars_of(spark, folder)).select(*ID, *_r("donchian_upper", "donchian_lower", "donchian_mid"))


def ind_ofi(spark, folder):
    return ind.order_flow_imbalance(bars_of(spark, folder)).select(*ID, *_r("ofi_14"))


def ind_true_range(spark, folder):
    return ind.true_range(bars_of(spark, folder)).select(*ID, *_r("true_range"))


def ind_ema(spark, folder):
    return ind.recursive(bars_of(spark, folder), ema=(12,)).select(*ID, *_r("ema_12"))


def ind_ema_long(spark, folder):
    """The same EMA by the chunked affine scan for series too long for a task, unmasked."""
    b = bars_of(spark, folder).withColumn("month", F.date_trunc("month", "timestamp_utc")).select(*ID, "month", "close")
    return ewm_long(b, "close", span_alpha(12), "ema", ["symbol"], ["timestamp_utc"], block="month").select(*ID, *_r("ema"))


def ind_atr(spark, folder):
    return ind.recursive(bars_of(spark, folder), atr=14).select(*ID, *_r("atr_14"))


def ind_rsi(spark, folder):
    return ind.recursive(bars_of(spark, folder), rsi=14).select(*ID, *_r("rsi_14"))


def ind_adx(spark, folder):
    return ind.recursive(bars_of(spark, folder), adx=14).select(*ID, *_r("plus_di", "minus_di", "adx_14"))


def ind_macd(spark, folder):
    return ind.recursive(bars_of(spark, folder), macd=True).select(*ID, *_r("macd", "macd_signal", "macd_hist"))


def ind_macd_state(spark, folder):
    return ind.recursive(bars_of(spark, folder), state=True).select(*ID, "macd_hist_above_zero", *_r("macd_hist_slope"), F.col("bars_since_zero_cross").cast("int"), F.col("decline_streak").cast("int"))


VW = ["vwap_session_band_1_0", "vwap_session_band_2_0"]


def ind_vwap_session(spark, folder):
    return ind.session_vwap(bars_of(spark, folder)).select(*ID, F.col("session_id").cast("bigint"), *_r("vwap_session", d=8), *_r(*VW, d=4))


def ind_vwap_weekly(spark, folder):
    return ind.weekly_vwap(bars_of(spark, folder)).select(*ID, *_r("vwap_weekly", d=8))


def ind_vwap_monthly(spark, folder):
    return ind.monthly_vwap(bars_of(spark, folder)).select(*ID, *_r("vwap_monthly", d=8))


def ind_cci(spark, folder):
    return ind.cci(bars_of(spark, folder)).select(*ID, *_r("cci_14", d=4))


def ind_percentile_rank(spark, folder):
    return ind.percentile_rank(bars_of(spark, folder), "volume", 300, 20, "volume_rank").select(*ID, *_r("volume_rank"))


def ind_day_range_used(spark, folder):
    return ind.day_range_used(bars_of(spark, folder)).select(*ID, *_r("daily_range_used"))


def ind_shift(spark, folder):
    w = ind.series()
    return bars_of(spark, folder).select(*ID, F.lag("close", 3).over(w).alias("close_3"), F.lead("close", 1).over(w).alias("close_next"))


def ind_rolling_std_lagged(spark, folder):
    c = F.col("close")
    return bars_of(spark, folder).select(*ID, F.round(ind.full(F.stddev_samp(c).over(ind.rolling(10, 1)), c, 10, 1), 4).alias("sd_lagged"), F.round(ind.full(F.max(c).over(ind.rolling(10, 1)), c, 10, 1), 6).alias("max_lagged"))


# -- joins in time -------------------------------------------------------------------------------------------------------
def _hourly(spark, folder):
    return resample.resample(bars_of(spark, folder), 60)


def join_asof_backward(spark, folder):
    h = _hourly(spark, folder).select("symbol", "timestamp_utc", F.col("close").alias("hour_close"))
    return asof.asof_backward(bars_of(spark, folder).select(*ID, "close"), h, ["symbol"], ["hour_close"], block_us=86_400_000_000)


def join_higher_timeframe(spark, folder):
    out = asof.higher_timeframe(bars_of(spark, folder).select(*ID, "close"), _hourly(spark, folder), ["close", "high"], "tf60m_")
    return out.select(*ID, "tf60m_close", "tf60m_high")


def join_daily_projection(spark, folder):
    daily = resample.resample_daily(bars_of(spark, folder))
    b = bars_of(spark, folder).select(*ID, trade_date(F.col("timestamp_utc")).alias("trade_date"))
    return asof.daily_projection(b, daily, ["close", "high"]).select(*ID, "daily_close", "daily_high")


def join_containing_bar(spark, folder):
    t = table(spark, folder, "trades").select("trade_id", F.upper(F.trim("contract")).alias("symbol"), "entry_ts").where("entry_ts is not null").distinct()
    return asof.containing_bar(t, bars_of(spark, folder), ts="entry_ts").select("trade_id", "symbol", F.unix_micros("bar_ts").alias("bar_us")).where("bar_us is not null")


def join_nearest(spark, folder):
    """Trades with the close of the clean bar nearest to their entry within ten minutes."""
    t = table(spark, folder, "trades").select("trade_id", F.upper(F.trim("contract")).alias("symbol"), "entry_ts").where("entry_ts is not null").distinct()
    b = bars_of(spark, folder).select(*ID, F.unix_micros("timestamp_utc").alias("bar_us"), "close")
    return asof.asof_nearest(t, b, ["symbol"], ["bar_us", "close"], left_ts="entry_ts", tolerance_us=600_000_000).where("bar_us is not null").select("trade_id", "symbol", "bar_us", "close")


def ctx_trade_context(spark, folder):
    """Results by the session and distance from VWAP at the bar nearest to each entry."""
    from tickloom.operators.context import context

    b = context(ind.session_vwap(ind.recursive(bars_of(spark, folder), atr=14))).select(*ID, "session", F.round("vwap_distance_atr", 6).alias("distance"))
    t = table(spark, folder, "trades").groupBy("trade_id").agg(F.min(F.upper(F.trim("contract"))).alias("symbol"), F.min("entry_ts").alias("entry_ts"), F.min("net_pnl_usd").alias("net_pnl_usd"))
    t = asof.asof_nearest(t.where("entry_ts is not null"), b, ["symbol"], ["session", "distance"], left_ts="entry_ts", tolerance_us=600_000_000)
    return t.groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl_usd"), 4).alias("total"), F.round(F.avg(F.abs("distance")), 4).alias("mean_distance"))


def dq_integrity(spark, folder):
    """Recomputed against stored values: bars whose ATR by the scan over months strays from the one pass over the series.

    The count is zero in a sound feature table; dq_integrity_joins has the counts for the daily and hourly values joined to a bar.
    """
    b = bars_of(spark, folder)
    a = ind.recursive(b, atr=14).where("atr_14 is not null").select("symbol", "timeframe", "timestamp_utc", "atr_14")
    tr = ind.true_range(b).where("true_range is not null").withColumn("month", F.date_trunc("month", "timestamp_utc")).select("symbol", "timeframe", "timestamp_utc", "month", "true_range")
    again = ewm_long(tr, "true_range", wilder_alpha(14), "again", ["symbol", "timeframe"], ["timestamp_utc"], block="month").select("symbol", "timeframe", "timestamp_utc", "again")
    off = F.coalesce(F.abs(F.col("atr_14") - F.col("again")) > 1e-6 * F.col("again") + 1e-9, F.lit(True))
    return a.join(again, ["symbol", "timeframe", "timestamp_utc"], "left").groupBy("symbol").agg(F.count_if(off).alias("strayed"))


def dq_integrity_joins(spark, folder):
    """Bars whose joined daily value is not of the trade date before, or whose joined hourly value is not of the hour before; both are zero in a sound feature table."""
    b = bars_of(spark, folder)
    day = quality.shift_breaks(b, join_daily_projection(spark, folder), "daily_close", F.unix_date(trade_date(F.col("timestamp_utc"))))
    hour = quality.shift_breaks(b, join_higher_timeframe(spark, folder), "tf60m_close", F.floor(F.unix_seconds("timestamp_utc") / 3600))
    return day.withColumnRenamed("breaks", "day_breaks").join(hour.withColumnRenamed("breaks", "hour_breaks"), "symbol")


def dq_trade_dates(spark, folder):
    """Per run the trades that end on another trade date than they began, and those of them that are no end-of-day exits."""
    t = clean_trades(table(spark, folder, "trades")).where("entry_ts is not null and exit_ts is not null")
    over = trade_date(F.col("entry_ts")) != trade_date(F.col("exit_ts"))
    return t.groupBy("run_id").agg(F.count("*").alias("trades"), F.count_if(over).alias("crossed"), F.count_if(over & F.coalesce(F.col("exit_reason") != "eod", F.lit(True))).alias("flagged"))


EVENT_DAYS = [date(2024, 3, 1), date(2024, 3, 12), date(2024, 3, 20), date(2024, 4, 5), date(2024, 4, 10)]


def _event_days(spark):
    return spark.createDataFrame([(d,) for d in EVENT_DAYS], "event_date date")


def join_nearest_event(spark, folder):
    t = table(spark, folder, "trades").groupBy("trade_id").agg(F.min("entry_ts").alias("entry_ts")).where("entry_ts is not null")
    t = t.withColumn("day", F.to_date(F.from_utc_timestamp("entry_ts", "America/New_York")))
    return asof.nearest_event(t, _event_days(spark), day="day").select("trade_id", "event_date", "days_to_event")


def join_blackout(spark, folder):
    t = table(spark, folder, "trades").groupBy("trade_id").agg(F.min("entry_ts").alias("entry_ts"))
    t = t.withColumn("event_date", F.to_date(F.from_utc_timestamp("entry_ts", "America/New_York")))
    return t.join(_event_days(spark), "event_date", "left_semi").select("trade_id", "event_date")


# -- quality -------------------------------------------------------------------------------------------------------------
FRAMES = {"1m": 1, "5m": 5}


def _sessions(spark, folder):
    """The calendar of every series: the overnight sessions of its instrument from its first trade date to its last."""
    day = trade_date(F.col("timestamp_utc"))
    span = table(spark, folder, "bars").where("contract is not null and timestamp_utc is not null").groupBy(F.col("contract").alias("symbol"), "timeframe").agg(F.min(day).alias("a"), F.max(day).alias("z"))
    return stitch.sessions_of(span.select("symbol", "timeframe", F.explode(F.sequence("a", "z")).alias("trade_date")))


def _slots(spark, folder, tf):
    return bars_of(spark, folder).where(F.col("timeframe") == tf).select("symbol", resample.bucket(F.col("timestamp_utc"), FRAMES[tf]).alias("timestamp_utc")).distinct()


def _by_frame(per):
    """One result per timeframe, put together."""
    out = None
    for tf, minutes in FRAMES.items():
        part = per(tf, minutes).withColumn("timeframe", F.lit(tf))
        out = part if out is None else out.unionByName(part)
    return out


def _missing(spark, folder, tf, minutes):
    sessions = _sessions(spark, folder).where(F.col("timeframe") == tf).drop("timeframe")
    return quality.missing_minutes(_slots(spark, folder, tf), sessions, minutes)


def dq_row_checks(spark, folder):
    b = table(spark, folder, "bars").withColumn("symbol", F.col("contract"))
    return quality.row_checks(b)


def dq_missing_minutes(spark, folder):
    """Periods the calendar expects and the series lacks, heads, tails and whole sessions included."""
    return _by_frame(lambda tf, m: _missing(spark, folder, tf, m).select("symbol", F.unix_seconds("timestamp_utc").alias("minute")))


def dq_gap_classes(spark, folder):
    gaps = _by_frame(lambda tf, m: quality.classify_gaps(_missing(spark, folder, tf, m), minutes=m))
    return gaps.select("symbol", "timeframe", F.unix_seconds("run_start").alias("run_start_s"), F.col("bars_missing").cast("bigint"), "in_rth", "kind")


def dq_session_coverage(spark, folder):
    """Bars per session from each symbol's first trade date to its last; sessions without bars have zero."""
    return quality.session_coverage(bars_of(spark, folder), _sessions(spark, folder).drop("trade_date", "timeframe")).select("symbol", F.unix_seconds("session_open").alias("open_s"), "bars")


def dq_missing_sessions(spark, folder):
    """Sessions of the calendar without a bar."""
    return dq_session_coverage(spark, folder).where("bars = 0").select("symbol", "open_s")


def dq_report(spark, folder):
    """The validation report: per symbol the row checks, missing and unexpected periods, large gaps, empty sessions, and the verdict."""
    b = table(spark, folder, "bars").withColumn("symbol", F.col("contract"))
    return quality.report(b, _sessions(spark, folder), FRAMES)


def dq_minute_runs(spark, folder):
    return _by_frame(lambda tf, m: islands.minute_runs(_slots(spark, folder, tf), ["symbol"], minutes=m)).select("symbol", "timeframe", F.unix_seconds("run_start").alias("run_start_s"), "n")


# -- continuous contracts ------------------------------------------------------------------------------------------------
def _chain(spark, folder):
    """The contracts of a root in order of their first bar, each used until the next one starts or its own end."""
    b = bars_of(spark, folder).withColumn("root", F.substring("symbol", 1, 3))
    spans = b.groupBy("root", F.col("symbol").alias("contract")).agg(F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("z"))
    w = Window.partitionBy("root").orderBy("a", "contract")
    seg = spans.withColumns({"seq": F.row_number().over(w), "next_a": F.lead("a").over(w)})
    seg = seg.select("root", "contract", "seq", F.col("a").alias("start_ts"), F.coalesce("next_a", F.col("z") + F.expr("INTERVAL 1 SECOND")).alias("end_ts"))
    return b.withColumnRenamed("symbol", "contract"), seg


def set_back_adjust(spark, folder):
    b, seg = _chain(spark, folder)
    return stitch.back_adjust(b, seg).select("root", "contract", F.unix_micros("timestamp_utc").alias("us"), *_r("close", "adjustment", d=8))


def set_contract_calendar(spark, folder):
    return stitch.contract_calendar(spark, "ZN", date(2023, 1, 1), date(2024, 12, 31))


def set_session_calendar(spark, folder):
    return stitch.session_calendar(spark, date(2024, 3, 1), date(2024, 6, 30)).select("trade_date", F.unix_seconds("session_open").alias("open_s"), F.unix_seconds("session_close").alias("close_s"))


def set_union_distinct(spark, folder):
    a = table(spark, folder, "trades").select(F.upper(F.trim("contract")).alias("contract"))
    return a.union(table(spark, folder, "bars").select("contract")).distinct()


def set_difference(spark, folder):
    a = table(spark, folder, "trades").select(F.upper(F.trim("contract")).alias("contract")).distinct()
    return a.exceptAll(table(spark, folder, "bars").select("contract").distinct())


NAMES = [n for n in dict(globals()) if n.split("_")[0] in ("scan", "shape", "agg", "ind", "join", "ctx", "dq", "set")]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES if callable(globals()[n])}


# -- oracles -------------------------------------------------------------------------------------------------------------
B = """b as (select contract as symbol, timeframe, timestamp_utc, open, high, low, close, volume, buy_volume, sell_volume from (
    select *, row_number() over (partition by contract, timestamp_utc order by bar_id) as rn from bars
    where close is not null and high >= low and volume >= 0) where rn = 1)"""
S = "partition by symbol, timeframe order by timestamp_utc"
TD = "cast(({} + interval 6 hours) at time zone 'America/New_York' as date)"
HOUR = "h as (select symbol, to_timestamp(floor(epoch(timestamp_utc) / 3600) * 3600) as ts, arg_min(open, timestamp_utc) as open, max(high) as high, arg_max(close, timestamp_utc) as close from b group by 1, 2)"


def _frame(n: int, lag: int = 0) -> str:
    return f"({S} rows between {n - 1 + lag} preceding and {lag or 'current row'}{' preceding' if lag else ''})"


def _full(expr: str, of: str, n: int, lag: int = 0) -> str:
    f = _frame(n, lag)
    return f"case when count({of}) over {f} = {n} then {expr} over {f} end"


def _ohlc(minutes: int) -> str:
    return f"""select symbol, to_timestamp(floor(epoch(timestamp_utc) / {minutes * 60}) * {minutes * 60}) as timestamp_utc, arg_min(open, timestamp_utc) as open, max(high) as high,
        min(low) as low, arg_max(close, timestamp_utc) as close, cast(sum(volume) as bigint) as volume"""


def _recursion(columns: dict[str, tuple[str, str]], source: str = "select *, row_number() over (partition by symbol, timeframe order by timestamp_utc) as n from b") -> str:
    """A recursive CTE r over numbered rows x; columns: name -> (first value, next value with p. and x.)."""
    first = ", ".join(f"cast({f} as double) as {n}" for n, (f, _) in columns.items())
    nxt = ", ".join(f"cast({e} as double)" for _, e in columns.values())
    return f"x as ({source}), r as (select symbol, timeframe, n, timestamp_utc, {first} from x where n = 1 union all select x.symbol, x.timeframe, x.n, x.timestamp_utc, {nxt} from r p join x on x.symbol = p.symbol and x.timeframe = p.timeframe and x.n = p.n + 1)"


def _ema_step(col: str, alpha: str, x: str) -> str:
    return f"p.{col} * (1 - {alpha}) + {x} * {alpha}"


TR = f"select *, row_number() over ({S}) as n, greatest(high - low, abs(high - lag(close) over ({S})), abs(low - lag(close) over ({S}))) as tr, close - lag(close) over ({S}) as d, high - lag(high) over ({S}) as up, lag(low) over ({S}) - low as down from b"
MACD = _recursion({"f": ("close", _ema_step("f", "(2.0/13)", "x.close")), "s": ("close", _ema_step("s", "(2.0/27)", "x.close")), "g": ("0", "p.g * 0.8 + ((" + _ema_step("f", "(2.0/13)", "x.close") + ") - (" + _ema_step("s", "(2.0/27)", "x.close") + ")) * 0.2")})
MACD_ROWS = f"with recursive {B}, {MACD}, m as (select symbol, timeframe, timestamp_utc, n, case when n > 34 then f - s end as macd, case when n > 34 then g end as macd_signal, case when n > 34 then f - s - g end as h from r)"
PDM, MDM = "case when x.up > x.down and x.up > 0 then x.up else 0 end", "case when x.down > x.up and x.down > 0 then x.down else 0 end"


ADX = """with recursive {b}, {r}, y as (select symbol, timeframe, timestamp_utc, n, 100 * pl / nullif(tr, 0) as p, 100 * mi / nullif(tr, 0) as m from r), v as (select *, 100 * abs(p - m) / nullif(p + m, 0) as dx from y),
    w as (select *, sum(cast(dx is not null as int)) over (partition by symbol, timeframe order by n) as seen from v), x2 as (select *, row_number() over (partition by symbol, timeframe order by n) as k, n - lag(n) over (partition by symbol, timeframe order by n) as gap from w where dx is not null),
    a as (select symbol, timeframe, k, n, dx as y from x2 where k = 1 union all select x2.symbol, x2.timeframe, x2.k, x2.n, (pow(13.0 / 14, gap) * a.y + x2.dx / 14) / (pow(13.0 / 14, gap) + 1.0 / 14) from a join x2 on x2.symbol = a.symbol and x2.timeframe = a.timeframe and x2.k = a.k + 1)"""
DM = {"tr": ("tr", "p.tr * (1 - 1.0/14) + x.tr / 14.0"), "pl": ("0", "p.pl * (1 - 1.0/14) + (" + PDM + ") / 14.0"), "mi": ("0", "p.mi * (1 - 1.0/14) + (" + MDM + ") / 14.0")}


def _vwap_sql(extra: str, group: str, out: str, more: str = "") -> str:
    w = f"(partition by symbol, timeframe, {group} order by timestamp_utc rows unbounded preceding)"
    return f"""with {B}, s as ({extra}), y as (select *, close - first_value(close) over {w} as xx, first_value(close) over {w} as x0 from s),
        z as (select *, sum(cast(volume as double)) over {w} as v, sum(xx * volume) over {w} / nullif(sum(cast(volume as double)) over {w}, 0) as m, sum(xx * xx * volume) over {w} / nullif(sum(cast(volume as double)) over {w}, 0) as q from y)
        select symbol, timestamp_utc, round(x0 + m, 8) as {out}{more} from z"""


VWAP_SESSION_BANDS = _vwap_sql(f"select *, sum(coalesce(cast(gap > 3600000000 as int), 0)) over ({S}) as session_id from (select *, epoch_us(timestamp_utc) - lag(epoch_us(timestamp_utc)) over ({S}) as gap from b)", "session_id", "vwap_session", ", cast(session_id as bigint) as session_id, round(sqrt(greatest(q - m * m, 0)), 4) as vwap_session_band_1_0, round(2 * sqrt(greatest(q - m * m, 0)), 4) as vwap_session_band_2_0")
VWAP_SESSION = VWAP_SESSION_BANDS.removeprefix(f"with {B}, ").join(["with ", ""]).replace("select symbol, timestamp_utc,", "select symbol, timeframe, timestamp_utc,")
ROW_CHECKS = "with k as (select contract as symbol, count(*) as rows, count(*) - count(distinct timestamp_utc) as duplicates, count(*) filter (volume < 0) as negative_volume, count(*) filter (high < low) as high_below_low, count(*) filter (high < open) as high_below_open, count(*) filter (high < close) as high_below_close, count(*) filter (low > open) as low_above_open, count(*) filter (low > close) as low_above_close, count(*) filter (close is null) as null_close, round(100 * count(buy_volume) / count(*), 2) as order_flow_pct from bars group by 1) select *, duplicates + negative_volume + high_below_low + high_below_open + high_below_close + low_above_open + low_above_close + null_close = 0 as passed from k"


def oracle_sql() -> dict[str, str]:
    step = "case timeframe when '1m' then 60 when '5m' then 300 end"
    mi = f"mi as (select distinct symbol, timeframe, {step} as st, cast(floor(epoch(timestamp_utc) / ({step})) * ({step}) as bigint) as m from b where timeframe in ('1m', '5m'))"
    cal = f"""cal as (select symbol, timeframe, {step} as st, d, cast(epoch(timezone('America/New_York', (d - interval 1 day) + interval 18 hours)) as bigint) as o, cast(epoch(timezone('America/New_York', d + interval 17 hours)) as bigint) as c
        from (select contract as symbol, timeframe, unnest(generate_series(min({TD.format('timestamp_utc')})::timestamp, max({TD.format('timestamp_utc')})::timestamp, interval 1 day)) as d from bars where contract is not null and timestamp_utc is not null group by 1, 2)
        where dayofweek(d) between 1 and 5 and not (month(d) = 6 and year(d) >= 2022 and cast(d as date) = case dayofweek(make_date(year(d), 6, 19)) when 0 then make_date(year(d), 6, 20) when 6 then make_date(year(d), 6, 18) else make_date(year(d), 6, 19) end))"""
    expected = "ex as (select symbol, timeframe, st, unnest(range(o, c, st)) as m from cal where timeframe in ('1m', '5m'))"
    miss = f"with {B}, {mi}, {cal}, {expected}, mm as (select ex.symbol, ex.timeframe, ex.st, ex.m from ex left join mi on ex.symbol = mi.symbol and ex.timeframe = mi.timeframe and ex.m = mi.m where mi.m is null)"
    runs = "select symbol, timeframe, min(m) as s, count(*) as n from (select symbol, timeframe, m, m - st * row_number() over (partition by symbol, timeframe order by m) as k from {}) group by symbol, timeframe, k"
    kinds = f"""ru as ({runs.format('mm')}), gk as (select *, hour(to_timestamp(s) at time zone 'America/New_York') * 60 + minute(to_timestamp(s) at time zone 'America/New_York') between 500 and 900 as in_rth, hour(to_timestamp(s) at time zone 'America/Chicago') * 60 + minute(to_timestamp(s) at time zone 'America/Chicago') as ct from ru),
        gc as (select symbol, timeframe, s as run_start_s, n as bars_missing, in_rth, case when n <= 5 then 'minor' when n <= 30 and ct >= 1020 and ct < 1050 then 'maintenance' when not in_rth and n <= 60 then 'overnight' else 'large' end as kind from gk)"""
    sessions = "cv as (select cal.symbol, cal.o as open_s, count(b.symbol) as bars from cal left join b on b.symbol = cal.symbol and b.timestamp_utc >= to_timestamp(o) and b.timestamp_utc < to_timestamp(c) group by 1, 2)"
    cover = f"{B}, {cal}, {sessions}"
    trades = "t as (select trade_id, min(entry_ts) as entry_ts from trades group by trade_id)"
    days = "ev as (select unnest([" + ", ".join(f"date '{d}'" for d in EVENT_DAYS) + "]) as event_date)"
    chain = f"""with {B}, c as (select *, substr(symbol, 1, 3) as root from b), sp as (select root, symbol, min(timestamp_utc) as a, max(timestamp_utc) as z from c group by 1, 2),
        sg as (select root, symbol, row_number() over (partition by root order by a, symbol) as seq, a, coalesce(lead(a) over (partition by root order by a, symbol), z + interval 1 second) as e from sp),
        i as (select c.*, sg.seq from c join sg on c.symbol = sg.symbol where timestamp_utc >= a and timestamp_utc < e),
        en as (select root, seq, arg_min(open, timestamp_utc) as fo, arg_max(close, timestamp_utc) as lc from i group by 1, 2),
        de as (select root, seq, coalesce(lead(fo) over (partition by root order by seq) - lc, 0) as delta from en),
        ad as (select root, seq, sum(delta) over (partition by root order by seq desc rows unbounded preceding) as adjustment from de)"""
    return {
        "scan_projection": "select bar_id, contract, close as bar_close from bars where timestamp_utc >= timestamptz '2024-03-11 00:00:00+00' and timestamp_utc <= timestamptz '2024-03-15 00:00:00+00'",
        "scan_latest_file": "select contract, max(path) as path, arg_max(file_id, path) as file_id from raw_files group by contract",
        "scan_stats": "select count(*) as rows, min(timestamp_utc) as first_ts, max(timestamp_utc) as last_ts from bars",
        "scan_windows": "with sp as (select contract, cast(floor(epoch(min(timestamp_utc))) as bigint) as a, cast(floor(epoch(max(timestamp_utc))) as bigint) as b from bars group by 1), w as (select contract, b, unnest(range(a, b + 1, 172801)) as s from sp) select contract, s as window_start, least(s + 172800, b) as window_end from w",
        "shape_keep_first": "select min(bar_id) as bar_id, contract from bars group by contract, timestamp_utc",
        "shape_keep_last": "select max(bar_id) as bar_id, contract from bars group by contract, timestamp_utc",
        "shape_clean_bars": f"with {B} select symbol, timestamp_utc, open, high, low, close, volume from b",
        "shape_largest_gaps": f"with {B}, g as (select symbol, timestamp_utc, cast(floor(epoch(timestamp_utc)) as bigint) - cast(floor(epoch(lag(timestamp_utc) over (partition by symbol order by timestamp_utc))) as bigint) as gap from b), k as (select *, row_number() over (partition by symbol order by gap desc, timestamp_utc) as rank from g where gap > 60) select symbol, epoch_us(timestamp_utc) as gap_end_us, gap as gap_seconds, rank from k where rank <= 5",
        "shape_rename_prefix": f"with {B} select symbol, timestamp_utc, open as tf60m_open, close as tf60m_close from b",
        "agg_resample_15m": f"with {B} {_ohlc(15)}, cast(sum(buy_volume) as double) as buy_volume, cast(sum(sell_volume) as double) as sell_volume from b group by 1, 2",
        "agg_resample_many": f"with {B} " + " union all ".join(f"({_ohlc(m)}, '{m}m' as timeframe from b group by 1, 2)" for m in (5, 15, 60, 240)),
        "agg_resample_daily": f"with {B} select symbol, {TD.format('timestamp_utc')} as trade_date, min(timestamp_utc) as timestamp_utc, arg_min(open, timestamp_utc) as open, max(high) as high, min(low) as low, arg_max(close, timestamp_utc) as close, cast(sum(volume) as bigint) as volume from (select timestamp_utc, * exclude (timestamp_utc) from b) group by 1, 2",
        "agg_resample_close": f"with {B} select symbol, to_timestamp(floor(epoch(b.timestamp_utc) / 3600) * 3600) as timestamp_utc, arg_max(close, b.timestamp_utc) as close from b group by 1, 2",
        "agg_bars_per_day": f"with {B}, d as (select symbol, cast(timestamp_utc at time zone 'America/New_York' as date) as day, count(*) as bars from b group by 1, 2), m as (select *, avg(bars) over (partition by symbol) as mb, stddev_samp(bars) over (partition by symbol) as sb from d) select symbol, day, bars, round(mb, 6) as mean_bars, round(sb, 6) as sd_bars, coalesce(abs(bars - mb) > 2 * sb, false) as outlier from m",
        "ind_sma": f"with {B} select symbol, timestamp_utc, round({_full('avg(close)', 'close', 20)}, 9) as sma_20 from b",
        "ind_bollinger": f"with {B}, m as (select symbol, timestamp_utc, {_full('avg(close)', 'close', 20)} as mid, {_full('stddev_samp(close)', 'close', 20)} as dev from b) select symbol, timestamp_utc, round(mid, 9) as bb_mid, round(mid + 2 * dev, 6) as bb_upper, round(mid - 2 * dev, 6) as bb_lower from m",
        "ind_donchian": f"with {B}, m as (select symbol, timestamp_utc, {_full('max(high)', 'high', 20)} as u, {_full('min(low)', 'low', 20)} as l from b) select symbol, timestamp_utc, round(u, 6) as donchian_upper, round(l, 6) as donchian_lower, round((u + l) / 2, 6) as donchian_mid from m",
        "ind_ofi": f"with {B}, o as (select *, cast(buy_volume - sell_volume as double) / nullif(buy_volume + sell_volume, 0) as ofi from b) select symbol, timestamp_utc, round({_full('avg(ofi)', 'ofi', 14)}, 6) as ofi_14 from o",
        "ind_true_range": f"with {B}, t as ({TR}) select symbol, timestamp_utc, round(tr, 6) as true_range from t",
        "ind_ema": f"with recursive {B}, {_recursion({'y': ('close', _ema_step('y', '(2.0/13)', 'x.close'))})} select symbol, timestamp_utc, round(case when n >= 12 then y end, 6) as ema_12 from r",
        "ind_ema_long": f"with recursive {B}, {_recursion({'y': ('close', _ema_step('y', '(2.0/13)', 'x.close'))})} select symbol, timestamp_utc, round(y, 6) as ema from r",
        "ind_atr": f"with recursive {B}, {_recursion({'y': ('tr', _ema_step('y', '(1.0/14)', 'x.tr'))}, TR)} select symbol, timestamp_utc, round(case when n > 14 then y end, 6) as atr_14 from r",
        "ind_rsi": f"with recursive {B}, {_recursion({'g': ('null', 'case when p.g is null then greatest(x.d, 0) else ' + _ema_step('g', '(1.0/14)', 'greatest(x.d, 0)') + ' end'), 'l': ('null', 'case when p.l is null then greatest(-x.d, 0) else ' + _ema_step('l', '(1.0/14)', 'greatest(-x.d, 0)') + ' end')}, TR)} select symbol, timestamp_utc, round(case when n > 14 then case when l = 0 then 100 else 100 - 100 / (1 + g / l) end end, 6) as rsi_14 from r",
        "ind_macd": f"{MACD_ROWS} select symbol, timestamp_utc, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(h, 6) as macd_hist from m",
        "ind_adx": ADX.format(b=B, r=_recursion(DM, TR)) + " select w.symbol, w.timestamp_utc, round(p, 6) as plus_di, round(m, 6) as minus_di, round(case when w.n > 28 then a.y end, 6) as adx_14 from w left join a on a.symbol = w.symbol and a.timeframe = w.timeframe and a.k = w.seen",
        "ind_macd_state": f"""{MACD_ROWS}, a as (select *, lag(h) over w as b, row_number() over w as k from m window w as (partition by symbol, timeframe order by n)),
            c as (select *, sum(cast(h is not null and (b is null or sign(h) <> sign(b)) as int)) over w as zc, sum(cast(h is not null and (b is null or (h > 0) <> (b > 0)) as int)) over w as side, case when b is null or (h > 0) <> (b > 0) then 1 when abs(h) > abs(b) then 1 when abs(h) < abs(b) then -1 end as mv, b is null or (h > 0) <> (b > 0) as fresh from a window w as (partition by symbol, timeframe order by n)),
            d as (select *, last_value(mv ignore nulls) over (partition by symbol, timeframe, side order by n) as dir from c where h is not null), e as (select *, lag(dir) over (partition by symbol, timeframe, side order by n) as was from d), f as (select *, sum(cast(fresh or dir <> was as int)) over (partition by symbol, timeframe, side order by n) as leg from e)
            select symbol, timestamp_utc, coalesce(h > 0, false) as macd_hist_above_zero, round(h - b, 6) as macd_hist_slope, cast(row_number() over (partition by symbol, timeframe, zc order by n) - 1 as int) as bars_since_zero_cross, cast(dir * count(mv) over (partition by symbol, timeframe, side, leg order by n) as int) as decline_streak from f
            union all select symbol, timestamp_utc, false, null, null, null from c where h is null""",
        "ind_vwap_session": VWAP_SESSION_BANDS,
        "ind_vwap_weekly": _vwap_sql(f"select *, yearweek({TD.format('timestamp_utc')}) as yw from b", "yw", "vwap_weekly"),
        "ind_vwap_monthly": _vwap_sql(f"select *, date_trunc('month', {TD.format('timestamp_utc')}) as mo from b", "mo", "vwap_monthly"),
        "ind_cci": f"with {B}, t as (select *, (high + low + close) / 3 as tp from b), m as (select *, {_full('avg(tp)', 'tp', 14)} as mean, list(tp) over {_frame(14)} as fr from t) select symbol, timestamp_utc, round((tp - mean) / nullif(0.015 * list_sum(list_transform(fr, lambda v: abs(v - mean))) / 14, 0), 4) as cci_14 from m",
        "ind_percentile_rank": f"with {B}, m as (select symbol, timestamp_utc, volume, list(volume) over {_frame(300)} as fr from b) select symbol, timestamp_utc, round(case when len(fr) >= 20 then len(list_filter(fr, lambda v: v < volume)) / len(fr) end, 6) as volume_rank from m",
        "ind_day_range_used": f"with {B}, d as (select *, cast(timestamp_utc at time zone 'America/New_York' as date) as dd from b) select symbol, timestamp_utc, round((close - first_value(open) over w) / nullif(max(high) over w - min(low) over w, 0), 6) as daily_range_used from d window w as (partition by symbol, timeframe, dd order by timestamp_utc rows unbounded preceding)",
        "ind_shift": f"with {B} select symbol, timestamp_utc, lag(close, 3) over ({S}) as close_3, lead(close) over ({S}) as close_next from b",
        "ind_rolling_std_lagged": f"with {B} select symbol, timestamp_utc, round({_full('stddev_samp(close)', 'close', 10, 1)}, 4) as sd_lagged, round({_full('max(close)', 'close', 10, 1)}, 6) as max_lagged from b",
        "join_asof_backward": f"with {B}, {HOUR} select b.symbol, b.timestamp_utc, b.close, h.close as hour_close from b asof left join h on b.symbol = h.symbol and b.timestamp_utc >= h.ts",
        "join_higher_timeframe": f"with {B}, {HOUR}, g as (select symbol, ts, lag(close) over (partition by symbol order by ts) as c, lag(high) over (partition by symbol order by ts) as hi from h) select b.symbol, b.timestamp_utc, g.c as tf60m_close, g.hi as tf60m_high from b asof left join g on b.symbol = g.symbol and b.timestamp_utc >= g.ts",
        "join_daily_projection": f"with {B}, e as (select *, {TD.format('timestamp_utc')} as td from b), d as (select symbol, td, arg_max(close, timestamp_utc) as c, max(high) as h from e group by 1, 2), l as (select symbol, td, lag(c) over (partition by symbol order by td) as c, lag(h) over (partition by symbol order by td) as h from d) select e.symbol, e.timestamp_utc, l.c as daily_close, l.h as daily_high from e left join l on e.symbol = l.symbol and e.td = l.td",
        "join_containing_bar": f"with {B}, t as (select distinct trade_id, upper(trim(contract)) as symbol, entry_ts from trades where entry_ts is not null), f as (select symbol, min(timestamp_utc) as first from b group by 1) select t.trade_id, t.symbol, epoch_us(coalesce(b.timestamp_utc, f.first)) as bar_us from t asof left join b on t.symbol = b.symbol and t.entry_ts >= b.timestamp_utc left join f on t.symbol = f.symbol where coalesce(b.timestamp_utc, f.first) is not null",
        "join_nearest": f"with {B}, t as (select distinct trade_id, upper(trim(contract)) as symbol, entry_ts from trades where entry_ts is not null) select trade_id, symbol, bar_us, close from (select t.trade_id, t.symbol, epoch_us(b.timestamp_utc) as bar_us, b.close, row_number() over (partition by t.trade_id, t.symbol, t.entry_ts order by abs(epoch_us(b.timestamp_utc) - epoch_us(t.entry_ts)), b.timestamp_utc) as rn from t join b on t.symbol = b.symbol and b.timestamp_utc between t.entry_ts - interval 10 minutes and t.entry_ts + interval 10 minutes) where rn = 1",
        "ctx_trade_context": f"""with recursive {B}, {_recursion({'y': ('tr', _ema_step('y', '(1.0/14)', 'x.tr'))}, TR)}, vw as (select symbol, timeframe, timestamp_utc, vwap_session as vw from ({VWAP_SESSION})), cx as (select r.symbol, r.timestamp_utc, hour(r.timestamp_utc at time zone 'America/New_York') as h, round((b.close - vw.vw) / nullif(case when r.n > 14 then r.y end, 0), 6) as distance
            from r join b on b.symbol = r.symbol and b.timestamp_utc = r.timestamp_utc join vw on vw.symbol = r.symbol and vw.timestamp_utc = r.timestamp_utc),
            t as (select trade_id, min(upper(trim(contract))) as symbol, min(entry_ts) as entry_ts, min(net_pnl_usd) as net from trades group by 1 having min(entry_ts) is not null),
            k as (select * from (select t.trade_id, t.net, case when h >= 18 or h < 3 then 'Asia' when h < 8 then 'London' when h < 9 then 'NY pre-open' when h < 16 then 'NY RTH' when h < 17 then 'NY close' else 'Overnight' end as session, distance, row_number() over (partition by t.trade_id order by abs(epoch_us(cx.timestamp_utc) - epoch_us(t.entry_ts)), cx.timestamp_utc) as rn
                from t join cx on cx.symbol = t.symbol and cx.timestamp_utc between t.entry_ts - interval 10 minutes and t.entry_ts + interval 10 minutes) where rn = 1)
            select session, count(*) as n, round(sum(t.net), 4) as total, round(avg(abs(distance)), 4) as mean_distance from t left join k using (trade_id) group by 1""",
        "dq_integrity": f"with {B}, n as (select symbol, count(*) as n from b group by symbol, timeframe) select symbol, 0::bigint as strayed from n where n > 14",
        "dq_integrity_joins": f"with {B} select distinct symbol, 0::bigint as day_breaks, 0::bigint as hour_breaks from b",
        "dq_trade_dates": f"with t as (select *, lower(trim(exit_reason)) as why, row_number() over (partition by trade_id order by exported_at desc, net_pnl_usd) as rn from trades), k as (select strategy_id as run_id, why, {TD.format('entry_ts')} <> {TD.format('exit_ts')} as over_date from t where rn = 1 and entry_ts is not null and exit_ts is not null) select run_id, count(*) as trades, count(*) filter (over_date) as crossed, count(*) filter (over_date and why is distinct from 'eod') as flagged from k group by 1",
        "join_nearest_event": f"with {trades}, {days}, d as (select trade_id, cast(entry_ts at time zone 'America/New_York' as date) as day from t where entry_ts is not null), k as (select trade_id, event_date, datediff('day', day, event_date) as days_to_event, row_number() over (partition by trade_id order by abs(datediff('day', day, event_date)), event_date) as rn from d, ev) select trade_id, event_date, cast(days_to_event as int) as days_to_event from k where rn = 1",
        "join_blackout": f"with {trades}, {days} select trade_id, cast(entry_ts at time zone 'America/New_York' as date) as event_date from t where cast(entry_ts at time zone 'America/New_York' as date) in (select event_date from ev)",
        "dq_row_checks": ROW_CHECKS,
        "dq_missing_minutes": f"{miss} select symbol, timeframe, m as minute from mm",
        "dq_gap_classes": f"{miss}, {kinds} select * from gc",
        "dq_minute_runs": f"with {B}, {mi}, ru as ({runs.format('mi')}) select symbol, timeframe, s as run_start_s, n from ru",
        "dq_session_coverage": f"with {cover} select * from cv",
        "dq_missing_sessions": f"with {cover} select symbol, open_s from cv where bars = 0",
        "dq_left_out": "with r as (select contract, timestamp_utc, bar_id, case when close is null then 'null_close' when high is null or low is null or high < low then 'crossed' when volume is null or volume < 0 then 'no_volume' end as why from bars), k as (select contract, coalesce(why, case when row_number() over (partition by contract, timestamp_utc, why is null order by bar_id) > 1 then 'redelivered' else 'kept' end) as reason from r) select contract, reason, count(*) as bars from k group by 1, 2",
        "dq_report": f"""{miss}, {kinds}, {sessions}, rc as ({ROW_CHECKS}), a1 as (select symbol, count(*) as missing_periods from mm group by 1),
            a2 as (select mi.symbol, count(*) as unexpected_periods from mi left join ex on ex.symbol = mi.symbol and ex.timeframe = mi.timeframe and ex.m = mi.m where ex.m is null group by 1),
            a3 as (select symbol, count(*) as large_gaps, count(*) filter (in_rth) as large_gaps_rth from gc where kind = 'large' group by 1), a4 as (select symbol, count(*) as empty_sessions from cv where bars = 0 group by 1)
            select rc.* exclude (passed), coalesce(missing_periods, 0) as missing_periods, coalesce(unexpected_periods, 0) as unexpected_periods, coalesce(large_gaps, 0) as large_gaps, coalesce(large_gaps_rth, 0) as large_gaps_rth, coalesce(empty_sessions, 0) as empty_sessions,
                passed and coalesce(large_gaps_rth, 0) = 0 and coalesce(empty_sessions, 0) = 0 as passed from rc left join a1 using (symbol) left join a2 using (symbol) left join a3 using (symbol) left join a4 using (symbol)""",
        "set_back_adjust": f"{chain} select i.root, i.symbol as contract, epoch_us(i.timestamp_utc) as us, round(close + adjustment, 8) as close, round(adjustment, 8) as adjustment from i join ad on i.root = ad.root and i.seq = ad.seq",
        "set_session_calendar": "select cast(d as date) as trade_date, cast(epoch(timezone('America/New_York', (d - interval 1 day) + interval 18 hours)) as bigint) as open_s, cast(epoch(timezone('America/New_York', d + interval 17 hours)) as bigint) as close_s from (select unnest(generate_series(timestamp '2024-03-01', timestamp '2024-06-30', interval 1 day)) as d) where dayofweek(d) between 1 and 5 and cast(d as date) <> date '2024-06-19'",
        "set_contract_calendar": """with m as (select unnest(generate_series(timestamp '2023-01-01', timestamp '2025-06-01', interval 1 month)) as d), e as (select d, month(d) as mo, year(d) as y, unnest(generate_series(d - interval 40 day, last_day(d)::timestamp, interval 1 day)) as x from m where month(d) in (3, 6, 9, 12)),
            b as (select *, row_number() over (partition by d order by x desc) as r from e where isodow(x) < 6), l as (select mo, y, cast(max(x) filter (r = 13) as date) as roll from b group by 1, 2), k as (select mo, y, roll, lag(roll) over (order by roll) as p from l where roll >= date '2023-01-01')
            select 'ZN' || case mo when 3 then 'H' when 6 then 'M' when 9 then 'U' else 'Z' end || substr(cast(y as varchar), 3) as contract, coalesce(p, date '2023-01-01') as data_start, least(roll, date '2024-12-31') as data_end, roll from k where coalesce(p, date '2023-01-01') < date '2024-12-31'""",
        "set_union_distinct": "select upper(trim(contract)) as contract from trades union select contract from bars",
        "set_difference": "select distinct upper(trim(contract)) as contract from trades where upper(trim(contract)) not in (select contract from bars)",
    }
