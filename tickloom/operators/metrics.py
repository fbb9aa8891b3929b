"""Risk and return measures of trade logs, per run, as aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.nulls import ratio
from tickloom.functions.special import chi2_upper, normal_cdf, sharpe_variance
from tickloom.operators.ranks import after, before, month_of, places

ORDER = ["exit_ts", "entry_ts", "trade_id"]
YEAR_DAYS = 252


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b, rounded down."""
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000)


def derived(trades: DataFrame, instruments: DataFrame | None = None, root: str = "root") -> DataFrame:
    """Adds risk in money, results in units of risk, holding times, outcome and New York entry day and hour."""
    col = F.col
    if instruments is not None:
        trades = trades.join(instruments.select(col("symbol").alias(root), "point_value"), root, "left")
    risk = F.nullif(F.abs(col("entry_price") - col("initial_stop")) * col("point_value") * col("quantity"), F.lit(0.0))
    local = F.from_utc_timestamp("entry_ts", "America/New_York")
    t = trades.withColumn("initial_risk_usd", risk)
    unit = col("point_value") * col("quantity")
    minutes = (F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 60_000_000
    return t.withColumns({
        "pnl_r": col("net_pnl_usd") / risk, "mae_r": -F.abs(col("mae_points")) * unit / risk, "mfe_r": col("mfe_points") * unit / risk,
        "hold_minutes": minutes, "hold_bars": F.greatest(F.lit(0), F.bround(minutes / 5)).cast("bigint"),
        "outcome": F.when(col("net_pnl_usd") > 0, "win").otherwise("loss"), "entry_dow": F.weekday(local), "entry_hour": F.hour(local),
    })


def equity(trades: DataFrame, keys: list[str], value: str = "net_pnl_usd", order: list[str] | None = None, ts: str = "exit_ts") -> DataFrame:
    """Adds ``equity`` (running sum), ``peak`` (its running maximum) and ``drawdown`` (equity - peak), in two levels.

    Sums and maxima within a month are windows of bounded size; months are chained over one row each.
    """
    order = order or ORDER
    t = trades.where(F.col(ts).isNotNull()).withColumn("__b", F.date_trunc("month", ts))
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("__c", F.sum(value).over(w))
    t = t.withColumn("__p", F.max("__c").over(w))
    chain = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    months = t.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"), F.max("__c").alias("__m"))
    months = months.withColumn("__before", F.coalesce(F.sum("__s").over(chain), F.lit(0.0)))
    months = months.withColumn("__top", F.max(F.col("__before") + F.col("__m")).over(chain)).select(*keys, "__b", "__before", "__top")
    t = t.join(months, [*keys, "__b"])
    t = t.withColumn("equity", F.col("__c") + F.col("__before")).withColumn("peak", F.greatest(F.col("__p") + F.col("__before"), F.col("__top")))
    return t.withColumn("drawdown", F.col("equity") - F.col("peak")).drop("__b", "__c", "__p", "__before", "__top")


def daily_pnl(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Net result per UTC date of the exit."""
    return trades.groupBy(*keys, F.to_date("exit_ts").alias("day")).agg(F.sum("net_pnl_usd").alias("pnl"))


def daily_ratios(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Annualised Sharpe and Sortino over days with exits."""
    p = F.col("pnl")
    neg = F.when(p < 0, p)
    out = daily.groupBy(*keys).agg(F.avg(p).alias("m"), F.stddev_samp(p).alias("s"), F.when(F.count(neg) >= 2, F.stddev_samp(neg)).alias("d"))
    root = F.sqrt(F.lit(float(YEAR_DAYS)))
    return out.select(*keys, (ratio(F.col("m"), F.col("s")) * root).alias("sharpe"), (ratio(F.col("m"), F.col("d")) * root).alias("sortino"))


def drawdowns(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Every stretch under water: start (first point below the peak), trough, recovery (null if still under), depth, points.

    Islands over the equity curve, counted within months with the count before and the next exit after them carried in; depth_pct is
    null where the peak is zero.
    """
    e = equity(trades, keys).withColumns({"__below": F.col("drawdown") < 0, "__b": month_of("exit_ts")})
    w = Window.partitionBy(*keys, "__b").orderBy(*ORDER)
    up = (~F.col("__below")).cast("int")
    blocks = e.groupBy(*keys, "__b").agg(F.sum(up).alias("__k"), F.min("exit_ts").alias("__first"))
    blocks = blocks.select(*keys, "__b", F.coalesce(F.sum("__k").over(before(keys)), F.lit(0)).alias("__o"), F.min("__first").over(after(keys)).alias("__then"))
    e = e.withColumns({"__g": F.sum(up).over(w), "__next": F.lead("exit_ts").over(w)}).join(blocks, [*keys, "__b"])
    e = e.withColumns({"__g": F.col("__g") + F.col("__o"), "__next": F.coalesce("__next", "__then")})
    out = e.where("__below").groupBy(*keys, "__g").agg(
        F.min("exit_ts").alias("start_ts"), F.min_by("exit_ts", F.struct("equity", *ORDER)).alias("trough_ts"), F.max_by("__next", F.struct(*ORDER)).alias("recovery_ts"),
        F.max("exit_ts").alias("last_ts"), (F.max("peak") - F.min("equity")).alias("depth_usd"), F.max("peak").alias("peak_usd"), F.count("*").alias("points"),
    )
    return out.withColumn("depth_pct", ratio(F.col("depth_usd"), F.abs("peak_usd"))).withColumn("days", days_between(F.col("start_ts"), F.coalesce("recovery_ts", "last_ts"))).drop("__g")


def usable(trades: DataFrame, value: str = "net_pnl_usd") -> DataFrame:
    """Trades whose result is a finite number other than zero."""
    v = F.col(value).cast("double")
    return trades.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v != 0))


def degradation(periods: DataFrame, keys: list[str], period: str, metric: str = "calmar", least: int = 3) -> DataFrame:
    """(keys, periods, degraded): at least ``least`` periods have the measure and it is below zero in the last two of them."""
    has = F.col(metric).isNotNull()
    last = F.sort_array(F.collect_list(F.when(has, F.struct(F.col(period).alias("p"), F.col(metric).alias("m")))), asc=False)
    out = periods.groupBy(*keys).agg(F.count_if(has).alias("periods"), F.slice(last, 1, 2).alias("__l"))
    return out.withColumn("degraded", (F.col("periods") >= least) & F.forall("__l", lambda x: x["m"] < 0)).drop("__l")


def summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The sixteen measures of a run. Undefined ratios are null; a loss is a result of zero or less."""
    from tickloom.operators.islands import streaks

    col = F.col
    net = col("net_pnl_usd")
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(F.when(net > 0, net)).alias("avg_win_usd"), F.avg(F.when(net <= 0, net)).alias("avg_loss_usd"),
        F.sum(F.when(net > 0, net)).alias("__w"), F.sum(F.when(net <= 0, net)).alias("__l"), F.avg(net).alias("expectancy_usd"), F.sum(net).alias("total_usd"),
        F.min("entry_ts").alias("__a"), F.max("exit_ts").alias("__z"), F.avg("mae_points").alias("avg_mae_points"), F.avg("mfe_points").alias("avg_mfe_points"),
    )
    runs = streaks(trades, keys, ORDER, net <= 0).where("value").groupBy(*keys).agg(F.max("length").alias("max_consec_losses"))
    e = equity(trades, keys)
    low = e.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown_usd"), F.min_by("peak", F.struct("drawdown", *ORDER)).alias("__peak"))
    long = drawdowns(trades, keys).groupBy(*keys).agg(F.max("days").alias("drawdown_duration_days"))
    out = reduce(lambda a, b: a.join(b, keys, "left"), (daily_ratios(daily_pnl(trades, keys), keys), runs, low, long), base)
    span = days_between(col("__a"), col("__z")).cast("double")
    out = out.withColumns({
        "profit_factor": ratio(F.coalesce(col("__w"), F.lit(0.0)), F.abs("__l")), "trades_per_week": ratio(col("total_trades").cast("double"), span / 7),
        "calmar": ratio(ratio(col("total_usd"), span) * YEAR_DAYS, F.abs("max_drawdown_usd")), "max_drawdown_pct": ratio(col("max_drawdown_usd"), F.abs("__peak")),
    })
    return out.fillna(0, ["max_consec_losses", "drawdown_duration_days"]).drop("__w", "__l", "__a", "__z", "__peak")


def extended_risk(trades: DataFrame, keys: list[str]) -> DataFrame:
    """MAR, ulcer index and performance, recovery, pain, tail and omega ratios."""
    col = F.col
    e = equity(trades, keys)
    under = F.when(col("peak") > 0, -col("drawdown") / col("peak")).otherwise(0.0)
    out = e.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max_by("equity", F.struct(*ORDER)).alias("last"), F.max(-col("drawdown")).alias("dd"), F.avg(-col("drawdown")).alias("pain"), F.sqrt(F.avg(under * under)).alias("ulcer_index"),
        F.min("exit_ts").alias("a"), F.max("exit_ts").alias("z"), F.percentile("net_pnl_usd", F.lit(0.95)).alias("hi"), F.percentile("net_pnl_usd", F.lit(0.05)).alias("lo"),
        F.sum(F.greatest(col("net_pnl_usd"), F.lit(0.0))).alias("gains"), F.sum(F.greatest(-col("net_pnl_usd"), F.lit(0.0))).alias("losses"),
    )
    days = F.greatest(days_between(col("a"), col("z")), F.lit(1)).cast("double")
    year = col("last") / days * YEAR_DAYS
    return out.where("n >= 2").select(*keys, ratio(year, col("dd")).alias("mar"), "ulcer_index", ratio(year, col("ulcer_index")).alias("ulcer_performance"), ratio(col("last"), col("dd")).alias("recovery"), ratio(col("last"), col("pain")).alias("pain_ratio"), ratio(F.abs("hi"), F.abs("lo")).alias("tail_ratio"), ratio(col("gains"), col("losses")).alias("omega"))


def time_under_water(trades: DataFrame, keys: list[str]) -> DataFrame:
    e = equity(trades, keys).groupBy(*keys).agg(F.avg((F.col("drawdown") < 0).cast("double")).alias("share_under_water"))
    d = drawdowns(trades, keys).groupBy(*keys).agg(F.max("points").alias("longest_points"), F.max("days").alias("longest_days"), F.count("*").alias("stretches"))
    return e.join(d, keys, "left").fillna(0, ["longest_points", "longest_days", "stretches"])


def distribution(trades: DataFrame, keys: list[str], value: str = "net_pnl_usd") -> DataFrame:
    """Population skewness and kurtosis, and Jarque-Bera with its p-value exp(-JB/2)."""
    out = trades.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("excess_kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4)
    return out.withColumn("pearson_kurtosis", F.col("excess_kurtosis") + 3).withColumn("jarque_bera", jb).withColumn("jarque_bera_p", F.exp(-jb / 2))


def autocorrelation(trades: DataFrame, keys: list[str], lags: int = 20, value: str = "net_pnl_usd") -> DataFrame:
    """(lag, acf): mean of lagged products over the population variance; runs shorter than lags + 2 give none."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(*ORDER)
    t = trades.withColumns({"__m": F.avg(value).over(w), "__v": F.var_pop(value).over(w), "__n": F.count(value).over(w)}).where(F.col("__n") >= lags + 2)
    t = t.withColumn("__x", F.col(value) - F.col("__m"))
    t = t.withColumns({f"__l{k}": F.lag("__x", k).over(o) for k in range(1, lags + 1)})
    sums = [F.avg(F.col("__x") * F.col(f"__l{k}")).alias(f"a{k}") for k in range(1, lags + 1)]
    one = t.groupBy(*keys).agg(F.first("__v").alias("v"), F.first("__n").alias("n"), *sums)
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), ratio(F.col(f"a{k}"), F.col("v")).alias("acf")) for k in range(1, lags + 1)])
    return one.select(*keys, "n", F.explode(cells).alias("c")).select(*keys, "n", "c.lag", "c.acf")


def ljung_box(acf: DataFrame, keys: list[str]) -> DataFrame:
    q = acf.groupBy(*keys).agg(F.first("n").alias("n"), F.max("lag").alias("lags"), F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("s"))
    q = q.withColumn("q", F.col("n") * (F.col("n") + 2) * F.col("s"))
    return q.select(*keys, "q", chi2_upper("q", "lags").alias("p_value"))


def probabilistic_sharpe(stats: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """Adds ``psr``: probability that the true Sharpe beats the benchmark; needs n, sharpe, skewness, pearson_kurtosis."""
    v = sharpe_variance(F.col("n"), F.col("sharpe"), F.col("skewness"), F.col("pearson_kurtosis"))
    return stats.withColumn("psr", normal_cdf((F.col("sharpe") - F.lit(benchmark)) / F.sqrt(v)))


def exit_reasons(trades: DataFrame, keys: list[str]) -> DataFrame:
    net = F.col("net_pnl_usd")
    return trades.groupBy(*keys, "exit_reason").agg(F.count("*").alias("n"), F.sum(net).alias("total"), F.avg(net).alias("mean"), F.avg((net > 0).cast("double")).alias("win_rate"), F.percentile("hold_minutes", F.lit(0.5)).alias("median_hold"), F.percentile("mae_points", F.lit(0.5)).alias("median_mae"), F.percentile("mfe_points", F.lit(0.5)).alias("median_mfe"))


def heatmap(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and count for Monday to Friday by hour 0-23, zero where there were no trades."""
    spine = trades.select(*keys).distinct() if keys else trades.sparkSession.range(1).select()
    spine = spine.withColumn("entry_dow", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("entry_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    cells = trades.groupBy(*keys, "entry_dow", "entry_hour").agg(F.sum("net_pnl_usd").alias("total"), F.count("*").alias("n"))
    return spine.join(cells, [*keys, "entry_dow", "entry_hour"], "left").fillna(0, ["total", "n"])


def calendar(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Year by month of exit with a total per row."""
    t = trades.withColumns({"year": F.year("exit_ts"), "month": F.month("exit_ts")})
    out = t.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.sum("net_pnl_usd")).fillna(0)
    return out.select(*keys, "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)], sum((F.col(str(m)) for m in range(2, 13)), F.col("1")).alias("total"))


def monthly_returns(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Change of month-end equity over the months from first to last; months without trades carry the equity and are left out, as is the first."""
    e = equity(trades, keys).groupBy(*keys, F.date_trunc("month", "exit_ts").alias("month")).agg(F.max_by("equity", F.struct(*ORDER)).alias("equity"))
    w = Window.partitionBy(*keys).orderBy("month")
    e = e.withColumns({"__b": F.lag("month").over(w), "change": F.col("equity") - F.lag("equity").over(w)})
    return e.where(F.col("__b") == F.col("month") - F.expr("INTERVAL 1 MONTH")).drop("__b", "equity")


def cost_scenarios(trades: DataFrame, keys: list[str], multiples: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Final equity and deepest drawdown if costs were a multiple of what they were."""
    cost = F.col("slippage_usd") + F.col("commission_usd")
    t = trades.withColumn("multiple", F.explode(F.array(*map(F.lit, multiples)))).withColumn("__net", F.col("net_pnl_usd") - cost * (F.col("multiple") - 1))
    return equity(t, [*keys, "multiple"], "__net").groupBy(*keys, "multiple").agg(F.sum("__net").alias("total"), F.min("drawdown").alias("max_drawdown"))


def rolling_expectancy(trades: DataFrame, keys: list[str], sizes: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    made = {}
    for n in sizes:
        f = w.rowsBetween(-(n - 1), 0)
        made[f"mean_r_{n}"] = F.when(F.count("pnl_r").over(f) == n, F.avg("pnl_r").over(f))
    return trades.withColumns(made)


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str = "p", q: float = 0.05, tie: str = "test_id") -> DataFrame:
    """Adds rank, adjusted p (step-up, at most 1) and whether the test is rejected at rate q.

    Ranks and the step-up minimum run within blocks of p, so tests of one family are many tasks.
    """
    block = F.floor(F.col(p) * 4096)
    t = places(tests, keys, [p, tie], block, "rank", "__n").withColumns({"__b": block, "__a": F.col(p) * F.col("__n") / F.col("rank")})
    up = Window.partitionBy(*keys, "__b").orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.when(F.col(p) <= F.col("rank") / F.col("__n") * q, F.col("rank"))
    blocks = t.groupBy(*keys, "__b").agg(F.min("__a").alias("__m"), F.max(below).alias("__k"))
    blocks = blocks.select(*keys, "__b", F.min("__m").over(after(keys)).alias("__later"), F.max("__k").over(Window.partitionBy(*keys)).alias("__last"))
    t = t.withColumn("__a", F.min("__a").over(up)).join(blocks, [*keys, "__b"])
    return t.withColumns({"adjusted_p": F.least(F.lit(1.0), "__a", "__later"), "rejected": F.coalesce(F.col("rank") <= F.col("__last"), F.lit(False))}).drop("__n", "__b", "__a", "__later", "__last")


def composite_score(profit_factor: Column, drawdown: Column, n: Column, least: int = 100) -> Column:
    """ln(PF) (1 - DD) (1 + log10(n / least)); null under ``least`` trades or at a total loss. Drawdowns above 1 are percent."""
    dd = F.when(F.abs(drawdown) > 1, F.abs(drawdown) / 100).otherwise(F.abs(drawdown))
    score = F.ln(F.greatest(profit_factor, F.lit(1e-6))) * (1 - F.least(dd, F.lit(0.99))) * (1 + F.log10(n / F.lit(float(least))))
    return F.when((n >= least) & (dd < 1), score)


def win_share_before(trades: DataFrame, keys: list[str], out: str = "win_prob") -> DataFrame:
    """Adds the share of wins among a key's earlier trades, shrunk to one half as by two trades before the first; months carry their counts on."""
    win = (F.col("net_pnl_usd") > 0).cast("bigint")
    t = trades.where("exit_ts is not null").withColumns({"__b": month_of("exit_ts"), "__w": win})
    w = Window.partitionBy(*keys, "__b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    months = t.groupBy(*keys, "__b").agg(F.sum("__w").alias("__s"), F.count("*").alias("__k"))
    months = months.select(*keys, "__b", *[F.coalesce(F.sum(c).over(before(keys)), F.lit(0)).alias(n) for c, n in (("__s", "__so"), ("__k", "__ko"))])
    t = t.withColumns({"__s": F.coalesce(F.sum("__w").over(w), F.lit(0)), "__k": F.count("*").over(w)}).join(months, [*keys, "__b"])
    return t.withColumn(out, (1 + F.col("__s") + F.col("__so")) / (2.0 + F.col("__k") + F.col("__ko"))).drop("__b", "__w", "__s", "__k", "__so", "__ko")


def meta_label_sweep(trades: DataFrame, keys: list[str], probability: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: trades kept, win rate, precision, recall, F1, total and Calmar of keeping those at or above it."""
    t = trades.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    kept, win = F.col(probability) >= F.col("threshold"), F.col("net_pnl_usd") > 0
    by = [*keys, "threshold"]
    out = t.groupBy(*by).agg(
        F.count_if(kept).alias("n"), F.count_if(kept & win).alias("tp"), F.count_if(kept & ~win).alias("fp"), F.count_if(~kept & win).alias("fn"), F.coalesce(F.sum(F.when(kept, F.col("net_pnl_usd"))), F.lit(0.0)).alias("total"),
        days_between(F.min(F.when(kept, F.col("entry_ts"))), F.max(F.when(kept, F.col("exit_ts")))).alias("__span"),
    )
    deep = equity(t.where(kept), by).groupBy(*by).agg(F.min("drawdown").alias("__dd"))
    p, r = ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    out = out.join(deep, by, "left").withColumns({"precision": p, "recall": r, "win_rate": F.coalesce(p, F.lit(0.0)), "calmar": ratio(ratio(F.col("total"), F.col("__span").cast("double")) * YEAR_DAYS, F.abs("__dd"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("__span", "__dd")


def regime_breakdown(trades: DataFrame, regime: str, keys: list[str]) -> DataFrame:
    """Per regime: count, total, mean, win rate, Sharpe and Calmar where there are more than two days, trades a week over the whole log's span."""
    by = [*keys, regime]
    net = F.col("net_pnl_usd")
    base = trades.groupBy(*by).agg(F.count("*").alias("n"), F.sum(net).alias("total"), F.avg(net).alias("mean"), F.avg((net > 0).cast("double")).alias("win_rate"))
    d = daily_pnl(trades, by)
    days = d.groupBy(*by).agg(F.count("*").alias("days"))
    e = equity(d.withColumns({"exit_ts": F.col("day").cast("timestamp")}), by, "pnl", ["exit_ts"]).groupBy(*by).agg(F.min("drawdown").alias("dd"))
    span = trades.groupBy(*keys).agg(F.greatest((F.unix_micros(F.max("exit_ts")) - F.unix_micros(F.min("entry_ts"))) / 86_400_000_000 / 7, F.lit(1e-9)).alias("weeks"))
    out = base.join(daily_ratios(d, by), by, "left").join(days, by, "left").join(e, by, "left")
    out = out.join(span, keys) if keys else out.crossJoin(F.broadcast(span))
    enough = F.col("days") > 2
    return out.select(*by, "n", "total", "mean", "win_rate", F.when(enough, F.col("sharpe")).alias("sharpe"), F.when(enough, ratio(F.col("total") / F.col("days") * YEAR_DAYS, F.abs("dd"))).alias("calmar"), (F.col("n") / F.col("weeks")).alias("per_week"))


def event_study(trades: DataFrame, window: int, events: int, distance: str = "days_to_event") -> DataFrame:
    """Result by distance from the event over [-window, window], per event, with its running sum."""
    spine = trades.sparkSession.range(-window, window + 1).select(F.col("id").cast("int").alias(distance))
    got = trades.where(F.abs(distance) <= window).groupBy(distance).agg(F.sum("net_pnl_usd").alias("total"), F.count("*").alias("n"))
    out = spine.join(got, distance, "left").fillna(0, ["total", "n"]).withColumn("per_event", F.col("total") / events)
    return out.withColumn("cumulative", F.sum("per_event").over(Window.partitionBy().orderBy(distance).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def quantile_plot(trades: DataFrame, keys: list[str], value: str = "net_pnl_usd") -> DataFrame:
    """Standardised results in order beside normal quantiles at evenly spaced probabilities from 0.01 to 0.99."""
    from tickloom.functions.special import normal_quantile

    w = Window.partitionBy(*keys)
    t = trades.where(F.col(value).isNotNull()).withColumns({"__n": F.count("*").over(w), "sample": ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)), "rank": F.row_number().over(w.orderBy(value, "trade_id"))})
    t = t.where("__n >= 2").withColumn("probability", 0.01 + 0.98 * (F.col("rank") - 1) / (F.col("__n") - 1))
    return t.select(*keys, "rank", "sample", "probability", normal_quantile("probability").alias("theoretical"))


def histogram(trades: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of values clipped to [low, high]; the last bin is closed."""
    v = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return trades.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
