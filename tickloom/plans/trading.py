"""Queries over trade logs: derived columns, risk measures, breakdowns, portfolios, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import asof, islands, metrics, portfolio, registry
from tickloom.plans.market import EVENT_DAYS, _event_days
from tickloom.runtime import table
from tickloom.schema import clean_trades

RUN = ["run_id"]
MONTHS = [f"m{m:02d}" for m in range(1, 13)]


def trades_of(spark, folder):
    return metrics.derived(clean_trades(table(spark, folder, "trades")), table(spark, folder, "instruments"))


def _r(*names: str, d: int = 6) -> list:
    return [F.round(n, d).alias(n) for n in names]


def daily_of(spark, folder):
    return metrics.daily_pnl(trades_of(spark, folder), RUN)


def log_derived(spark, folder):
    return trades_of(spark, folder).select("trade_id", *_r("initial_risk_usd", "pnl_r", "mae_r", "mfe_r", d=9), "hold_bars", "outcome", "entry_dow", "entry_hour")


def log_top_trades(spark, folder):
    """Twenty best and twenty worst by net result."""
    t = trades_of(spark, folder).select("trade_id", "net_pnl_usd")
    best = t.orderBy(F.col("net_pnl_usd").desc(), "trade_id").limit(20).withColumn("side", F.lit("best"))
    return best.unionByName(t.orderBy("net_pnl_usd", "trade_id").limit(20).withColumn("side", F.lit("worst")))


def log_give_back(spark, folder):
    """Trades more than one R ahead that lost, the thirty furthest ahead."""
    t = trades_of(spark, folder).where("mfe_r > 1 and net_pnl_usd < 0").orderBy(F.col("mfe_r").desc(), "trade_id").limit(30)
    return t.select("trade_id", *_r("mfe_r"), "net_pnl_usd")


def log_streaks(spark, folder):
    return islands.streaks(trades_of(spark, folder), RUN, metrics.ORDER, F.col("net_pnl_usd") <= 0).select("run_id", F.col("value").alias("losing"), "length").groupBy("run_id", "losing", "length").agg(F.count("*").alias("n"))


def log_equity(spark, folder):
    return metrics.equity(trades_of(spark, folder), RUN).select("run_id", "trade_id", *_r("equity", "peak", "drawdown", d=4))


def met_summary(spark, folder):
    s = metrics.summary(trades_of(spark, folder), RUN)
    means = ["avg_win_usd", "avg_loss_usd", "expectancy_usd", "avg_mae_points", "avg_mfe_points"]
    names = ["win_rate", "profit_factor", "trades_per_week", "sharpe", "sortino", "calmar", "max_drawdown_usd", "max_drawdown_pct"]
    return s.select("run_id", "total_trades", F.col("max_consec_losses").cast("bigint"), F.col("drawdown_duration_days").cast("bigint"), *_r(*means, d=11), *_r(*names, d=9))


def met_subperiods(spark, folder):
    """The summary per run and month of exit, each with its own equity."""
    t = trades_of(spark, folder).withColumn("period", F.date_format("exit_ts", "yyyy-MM"))
    return metrics.summary(t, ["run_id", "period"]).select("run_id", "period", "total_trades", *_r("win_rate", "profit_factor", "sharpe", "calmar", "max_drawdown_usd", d=9))


def met_extended_risk(spark, folder):
    return metrics.extended_risk(trades_of(spark, folder), RUN).select("run_id", *_r("mar", "ulcer_index", "ulcer_performance", "recovery", "pain_ratio", "tail_ratio", "omega", d=5))


def met_drawdowns(spark, folder):
    d = metrics.drawdowns(trades_of(spark, folder), RUN)
    return d.select("run_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("trough_ts").alias("trough_us"), *_r("depth_usd", "depth_pct", d=5), "points", F.col("days").cast("bigint"))


def met_under_water(spark, folder):
    return metrics.time_under_water(trades_of(spark, folder), RUN).select("run_id", *_r("share_under_water"), F.col("longest_points").cast("bigint"), F.col("longest_days").cast("bigint"), F.col("stretches").cast("bigint"))


def met_distribution(spark, folder):
    return metrics.distribution(trades_of(spark, folder), RUN).select("run_id", "n", *_r("skewness", "excess_kurtosis", "jarque_bera_p", d=5))


def met_autocorrelation(spark, folder):
    return metrics.autocorrelation(trades_of(spark, folder), ["root"], 5).select("root", "lag", *_r("acf", d=5))


def met_ljung_box(spark, folder):
    return metrics.ljung_box(metrics.autocorrelation(trades_of(spark, folder), ["root"], 5), ["root"]).select("root", *_r("q", "p_value", d=5))


def met_probabilistic_sharpe(spark, folder):
    t = trades_of(spark, folder)
    stats = metrics.distribution(t, RUN).join(metrics.daily_ratios(metrics.daily_pnl(t, RUN), RUN), "run_id")
    return metrics.probabilistic_sharpe(stats).select("run_id", "n", *_r("sharpe", "psr", d=5))


def met_exit_reasons(spark, folder):
    return metrics.exit_reasons(trades_of(spark, folder), []).select("exit_reason", "n", *_r("total", "mean", "win_rate", "median_hold", "median_mae", "median_mfe", d=4))


def met_heatmap(spark, folder):
    return metrics.heatmap(trades_of(spark, folder), ["root"]).select("root", "entry_dow", "entry_hour", *_r("total", d=4), "n")


def met_calendar(spark, folder):
    c = metrics.calendar(trades_of(spark, folder), ["root"])
    return c.select("root", "year", *_r(*MONTHS, "total", d=4))


def met_monthly(spark, folder):
    return metrics.monthly_returns(trades_of(spark, folder), ["root"]).select("root", F.to_date("month").alias("month"), *_r("change", d=4))


def met_cost_scenarios(spark, folder):
    return metrics.cost_scenarios(trades_of(spark, folder), RUN).select("run_id", "multiple", *_r("total", "max_drawdown", d=4))


def met_rolling_expectancy(spark, folder):
    return metrics.rolling_expectancy(trades_of(spark, folder), ["root"], (5, 20)).select("root", "trade_id", *_r("mean_r_5", "mean_r_20", d=5))


def met_regime_breakdown(spark, folder):
    t = trades_of(spark, folder)
    return metrics.regime_breakdown(t, "entry_dow", ["direction"]).select("direction", "entry_dow", "n", *_r("total", "mean", "win_rate", "sharpe", "calmar", "per_week", d=4))


def met_event_study(spark, folder):
    t = trades_of(spark, folder).where("entry_ts is not null").withColumn("day", F.to_date(F.from_utc_timestamp("entry_ts", "America/New_York")))
    t = asof.nearest_event(t, _event_days(spark), day="day")
    return metrics.event_study(t, 5, len(EVENT_DAYS)).select("days_to_event", "n", *_r("total", "per_event", "cumulative", d=4))


def met_meta_sweep(spark, folder):
    """Thresholds over the probability of a win as the run's trades before have it: their share of wins, one of two for none."""
    t = metrics.win_share_before(trades_of(spark, folder), RUN)
    return metrics.meta_label_sweep(t, [], "win_prob", [round(0.30 + 0.05 * i, 2) for i in range(13)]).select("threshold", "n", *_r("win_rate", "precision", "recall", "f1", "total", "calmar", d=5))


def met_benjamini_hochberg(spark, folder):
    """Ranked p-values of runs: the chance of as many winning days or more, of all days with a result, by coin flips."""
    d = daily_of(spark, folder).where("pnl <> 0")
    p = registry.positive_folds(d, RUN, "pnl").select("run_id", F.round("p_value", 9).alias("p"))
    return metrics.benjamini_hochberg(p, [], "p", 0.1, "run_id").select("run_id", "rank", *_r("adjusted_p", d=8), "rejected")


def met_leaderboard(spark, folder):
    """Runs by composite score, best first; runs under five trades have none."""
    s = metrics.summary(trades_of(spark, folder), RUN)
    score = metrics.composite_score(F.col("profit_factor"), F.coalesce(F.col("max_drawdown_pct"), F.lit(0.0)) / 100, F.col("total_trades"), 5)
    return s.withColumn("score", score).where("score is not null").orderBy(F.col("score").desc_nulls_last(), "run_id").limit(10).select("run_id", "total_trades", *_r("score", d=5))


def met_quantile_plot(spark, folder):
    return metrics.quantile_plot(trades_of(spark, folder), ["root"]).select("root", "rank", *_r("sample", "probability", "theoretical", d=6))


def met_hold_histogram(spark, folder):
    return metrics.histogram(trades_of(spark, folder), ["outcome"], "hold_minutes", 0.0, 200.0, 20)


def met_r_histogram(spark, folder):
    return metrics.histogram(trades_of(spark, folder), ["exit_reason"], "pnl_r", -5.0, 5.0, 60)


def port_correlation(spark, folder):
    return portfolio.correlation(daily_of(spark, folder)).select("run_a", "run_b", *_r("corr", d=5))


def port_spearman(spark, folder):
    return portfolio.correlation(daily_of(spark, folder), "spearman").select("run_a", "run_b", *_r("corr", d=5))


def port_combined(spark, folder):
    return portfolio.combined(daily_of(spark, folder)).select("day", *_r("pnl", "equity", "drawdown", d=4))


def port_sizing(spark, folder):
    return portfolio.compare_sizing(daily_of(spark, folder), 10).select("method", *_r("final_pnl", "max_dd", "calmar", "sharpe", d=4))


def port_attribution(spark, folder):
    return portfolio.drawdown_attribution(daily_of(spark, folder)).select("start_day", "trough_day", "run_id", *_r("max_dd_pct", "loss_usd", "total_loss_usd", "share", d=5))


def port_capital(spark, folder):
    m = table(spark, folder, "instruments").select("symbol", (F.col("point_value") * 25).alias("margin"))
    return portfolio.capital(trades_of(spark, folder), RUN, m).select("run_id", *_r("on_margin", "on_peak_capital", "on_max_dd", d=9))


def port_kelly(spark, folder):
    return portfolio.kelly(daily_of(spark, folder)).select("run_id", *_r("full_kelly", "half_kelly", "dd_constrained_kelly", "hist_max_dd", d=9))


def port_rolling_correlation(spark, folder):
    return portfolio.rolling_correlations(daily_of(spark, folder), 10).select("run_a", "run_b", "day", *_r("corr", d=5))


NAMES = [n for n in dict(globals()) if n.split("_")[0] in ("log", "met", "port")]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES if callable(globals()[n])}


T = """t as (select *, abs(entry_price - initial_stop) * point_value * quantity as risk0 from (select trade_id, strategy_id as run_id, symbol as root, lower(trim(exit_reason)) as exit_reason, direction, quantity, entry_ts, exit_ts,
    entry_price, initial_stop, slippage_usd, commission_usd, net_pnl_usd, mae_points, mfe_points, row_number() over (partition by trade_id order by exported_at desc, net_pnl_usd) as rn from trades) left join (select symbol as root, point_value from instruments) using (root) where rn = 1),
    d as (select *, nullif(risk0, 0) as risk, net_pnl_usd / nullif(risk0, 0) as pnl_r, -abs(mae_points) * point_value * quantity / nullif(risk0, 0) as mae_r, mfe_points * point_value * quantity / nullif(risk0, 0) as mfe_r,
        (epoch_us(exit_ts) - epoch_us(entry_ts)) / 60000000 as hold_minutes, isodow(entry_ts at time zone 'America/New_York') - 1 as entry_dow, hour(entry_ts at time zone 'America/New_York') as entry_hour from t)"""
O = "exit_ts, entry_ts, trade_id"


def _equity(by: str, value: str = "net_pnl_usd", source: str = "d") -> str:
    w = f"(partition by {by} order by {O} rows unbounded preceding)"
    return f"e0 as (select *, sum({value}) over {w} as equity from {source} where exit_ts is not null), e1 as (select *, max(equity) over {w} as peak from e0), e as (select *, equity - peak as drawdown from e1)"


def _spells(by: str) -> str:
    w = f"(partition by {by} order by {O})"
    return f"""s0 as (select *, sum(case when drawdown < 0 then 0 else 1 end) over {w} as g, lead(exit_ts) over {w} as nxt from e),
        s as (select {by}, g, min(exit_ts) as start_ts, arg_min(exit_ts, (equity, {O})) as trough_ts, arg_max(coalesce(nxt, exit_ts), ({O})) as end_ts, max(peak) - min(equity) as depth_usd, max(peak) as peak_usd, count(*) as points from s0 where drawdown < 0 group by {by}, g),
        sp as (select *, cast(floor((epoch_us(end_ts) - epoch_us(start_ts)) / 86400000000) as bigint) as days from s)"""


def _summary(by: str, source: str = "d") -> str:
    w = f"(partition by {by} order by {O})"
    return f"""{_equity(by, source=source)}, {_spells(by)},
        ba as (select {by}, count(*) as n, avg(cast(net_pnl_usd > 0 as double)) as wr, avg(case when net_pnl_usd > 0 then net_pnl_usd end) as aw, avg(case when net_pnl_usd <= 0 then net_pnl_usd end) as al,
            sum(case when net_pnl_usd > 0 then net_pnl_usd end) as sw, sum(case when net_pnl_usd <= 0 then net_pnl_usd end) as sl, avg(net_pnl_usd) as ex, sum(net_pnl_usd) as tot, avg(mae_points) as mae, avg(mfe_points) as mfe,
            floor((epoch_us(max(exit_ts)) - epoch_us(min(entry_ts))) / 86400000000) as span from {source} group by {by}),
        dy as (select {by}, cast(exit_ts at time zone 'UTC' as date) as day, sum(net_pnl_usd) as pnl from {source} group by all),
        ra as (select {by}, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) as sharpe, avg(pnl) / nullif(case when count(*) filter (pnl < 0) >= 2 then stddev_samp(pnl) filter (pnl < 0) end, 0) * sqrt(252) as sortino from dy group by {by}),
        r0 as (select *, row_number() over {w} - row_number() over (partition by {by}, net_pnl_usd <= 0 order by {O}) as k from {source}),
        r1 as (select {by}, max(c) as mcl from (select {by}, k, count(*) as c from r0 where net_pnl_usd <= 0 group by {by}, k) group by {by}),
        lo as (select {by}, min(drawdown) as dd, arg_min(peak, (drawdown, {O})) as pk from e group by {by}),
        du as (select {by}, max(days) as dur from sp group by {by}),
        su as (select * from ba left join ra using ({by}) left join r1 using ({by}) left join lo using ({by}) left join du using ({by}))"""


ALIGN = "al as (select a.day, b.run_id, coalesce(p.pnl, 0) as pnl from (select distinct day from dp) a cross join (select distinct run_id from dp) b left join dp p on p.day = a.day and p.run_id = b.run_id)"
DP = "dp as (select run_id, cast(exit_ts at time zone 'UTC' as date) as day, sum(net_pnl_usd) as pnl from d group by 1, 2)"
CO = "c0 as (select day, sum(pnl) as pnl from dp group by 1), c1 as (select *, sum(pnl) over (order by day rows unbounded preceding) as equity from c0), co as (select *, max(equity) over (order by day rows unbounded preceding) as peak from c1)"


def oracle_sql() -> dict[str, str]:
    ev = "ev as (select unnest([" + ", ".join(f"date '{x}'" for x in EVENT_DAYS) + "]) as event_date)"
    su_cols = "round(wr, 9) as win_rate, round(coalesce(sw, 0) / nullif(abs(sl), 0), 9) as profit_factor, round(sharpe, 9) as sharpe, round(tot / nullif(span, 0) * 252 / nullif(abs(dd), 0), 9) as calmar, round(dd, 9) as max_drawdown_usd"
    acf = "a0 as (select root, net_pnl_usd - avg(net_pnl_usd) over (partition by root) as x, var_pop(net_pnl_usd) over (partition by root) as v, count(*) over (partition by root) as n, exit_ts, entry_ts, trade_id from d), " + "ac as (" + " union all ".join(f"select root, {k} as lag, any_value(n) as n, avg(x * l) / nullif(any_value(v), 0) as acf from (select *, lag(x, {k}) over (partition by root order by {O}) as l from a0 where n >= 7) group by root" for k in range(1, 6)) + ")"
    sized = {
        "equal_weight": "select day, run_id, pnl, 1.0 / k as w from kk",
        "vol_target": "select day, run_id, pnl, coalesce(i / nullif(sum(i) over (partition by day), 0), 1.0 / k) as w from (select *, 1 / nullif(case when count(*) over z = 10 then stddev_samp(pnl) over z end, 0) as i from kk window z as (partition by run_id order by day rows between 10 preceding and 1 preceding))",
        "inverse_dd": "select day, run_id, pnl, coalesce(i / nullif(sum(i) over (partition by day), 0), 1.0 / k) as w from (select *, 1 / (abs(lag(c) over (partition by run_id order by day) - coalesce(case when count(*) over z = 10 then max(c) over z end, 0)) + 1) as i from (select *, sum(pnl) over (partition by run_id order by day rows unbounded preceding) as c from kk) window z as (partition by run_id order by day rows between 10 preceding and 1 preceding))",
    }
    sized["risk_parity"] = sized["vol_target"]
    sizing = f"with {T}, {DP}, {ALIGN}, kk as (select *, count(*) over (partition by day) as k from al), " + ", ".join(f"z_{m} as (select day, sum(pnl * w) as pnl from ({q}) group by day), y_{m} as (select *, sum(pnl) over (order by day rows unbounded preceding) as eq from z_{m})" for m, q in sized.items())
    sizing += " " + " union all ".join(f"select '{m}' as method, round(sum(pnl), 4) as final_pnl, round(max(pk - eq), 4) as max_dd, round(sum(pnl) / (count(*) / 252.0) / nullif(max(pk - eq), 0), 4) as calmar, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 4) as sharpe from (select *, max(eq) over (order by day rows unbounded preceding) as pk from y_{m})" for m in sized)
    return {
        "log_derived": f"with {T} select trade_id, round(risk, 9) as initial_risk_usd, round(pnl_r, 9) as pnl_r, round(mae_r, 9) as mae_r, round(mfe_r, 9) as mfe_r, cast(greatest(0, round_even(hold_minutes / 5, 0)) as bigint) as hold_bars, case when net_pnl_usd > 0 then 'win' else 'loss' end as outcome, cast(entry_dow as int) as entry_dow, cast(entry_hour as int) as entry_hour from d",
        "log_top_trades": f"with {T} (select trade_id, net_pnl_usd, 'best' as side from d order by net_pnl_usd desc nulls last, trade_id limit 20) union all (select trade_id, net_pnl_usd, 'worst' as side from d order by net_pnl_usd nulls first, trade_id limit 20)",
        "log_give_back": f"with {T} select trade_id, round(mfe_r, 6) as mfe_r, net_pnl_usd from d where mfe_r > 1 and net_pnl_usd < 0 order by d.mfe_r desc, trade_id limit 30",
        "log_streaks": f"with {T}, r0 as (select run_id, net_pnl_usd <= 0 as losing, row_number() over (partition by run_id order by {O}) - row_number() over (partition by run_id, net_pnl_usd <= 0 order by {O}) as k from d), r1 as (select run_id, losing, k, count(*) as length from r0 group by 1, 2, 3) select run_id, losing, length, count(*) as n from r1 group by 1, 2, 3",
        "log_equity": f"with {T}, {_equity('run_id')} select run_id, trade_id, round(equity, 4) as equity, round(peak, 4) as peak, round(drawdown, 4) as drawdown from e",
        "met_summary": f"with {T}, {_summary('run_id')} select run_id, n as total_trades, coalesce(mcl, 0) as max_consec_losses, coalesce(dur, 0) as drawdown_duration_days, {su_cols}, round(aw, 11) as avg_win_usd, round(al, 11) as avg_loss_usd, round(ex, 11) as expectancy_usd, round(n / nullif(span / 7, 0), 9) as trades_per_week, round(sortino, 9) as sortino, round(dd / nullif(abs(pk), 0), 9) as max_drawdown_pct, round(mae, 11) as avg_mae_points, round(mfe, 11) as avg_mfe_points from su",
        "met_subperiods": f"with {T}, dd as (select *, strftime(exit_ts at time zone 'UTC', '%Y-%m') as period from d), {_summary('run_id, period', 'dd')} select run_id, period, n as total_trades, {su_cols} from su",
        "met_extended_risk": f"with {T}, {_equity('run_id')}, x as (select run_id, count(*) as n, arg_max(equity, ({O})) as last, max(-drawdown) as dd, avg(-drawdown) as pain, sqrt(avg(case when peak > 0 then (drawdown / peak) * (drawdown / peak) else 0 end)) as ui, greatest(floor((epoch_us(max(exit_ts)) - epoch_us(min(exit_ts))) / 86400000000), 1) as days, quantile_cont(net_pnl_usd, 0.95) as hi, quantile_cont(net_pnl_usd, 0.05) as lo, sum(greatest(net_pnl_usd, 0)) as g, sum(greatest(-net_pnl_usd, 0)) as l from e group by 1) select run_id, round(last / days * 252 / nullif(dd, 0), 5) as mar, round(ui, 5) as ulcer_index, round(last / days * 252 / nullif(ui, 0), 5) as ulcer_performance, round(last / nullif(dd, 0), 5) as recovery, round(last / nullif(pain, 0), 5) as pain_ratio, round(abs(hi) / nullif(abs(lo), 0), 5) as tail_ratio, round(g / nullif(l, 0), 5) as omega from x where n >= 2",
        "met_drawdowns": f"with {T}, {_equity('run_id')}, {_spells('run_id')} select run_id, epoch_us(start_ts) as start_us, epoch_us(trough_ts) as trough_us, round(depth_usd, 5) as depth_usd, round(depth_usd / nullif(abs(peak_usd), 0), 5) as depth_pct, points, days from sp",
        "met_under_water": f"with {T}, {_equity('run_id')}, {_spells('run_id')}, a as (select run_id, avg(cast(drawdown < 0 as double)) as sh from e group by 1), b as (select run_id, max(points) as p, max(days) as dy, count(*) as c from sp group by 1) select run_id, round(sh, 6) as share_under_water, coalesce(p, 0) as longest_points, coalesce(dy, 0) as longest_days, coalesce(c, 0) as stretches from a left join b using (run_id)",
        "met_distribution": f"with {T}, m as (select run_id, net_pnl_usd - avg(net_pnl_usd) over (partition by run_id) as x from d), q as (select run_id, count(*) as n, avg(x * x) as m2, avg(x * x * x) as m3, avg(x * x * x * x) as m4 from m group by 1), z as (select run_id, n, m3 / nullif(pow(m2, 1.5), 0) as s, m4 / nullif(m2 * m2, 0) - 3 as k from q) select run_id, n, round(s, 5) as skewness, round(k, 5) as excess_kurtosis, round(exp(-(n / 6 * (s * s + k * k / 4)) / 2), 5) as jarque_bera_p from z",
        "met_autocorrelation": f"with {T}, {acf} select root, lag, round(acf, 5) as acf from ac",
        "met_exit_reasons": f"with {T} select exit_reason, count(*) as n, round(sum(net_pnl_usd), 4) as total, round(avg(net_pnl_usd), 4) as mean, round(avg(cast(net_pnl_usd > 0 as double)), 4) as win_rate, round(quantile_cont(hold_minutes, 0.5), 4) as median_hold, round(quantile_cont(mae_points, 0.5), 4) as median_mae, round(quantile_cont(mfe_points, 0.5), 4) as median_mfe from d group by 1",
        "met_heatmap": f"with {T}, g as (select root, cast(w as int) as entry_dow, cast(h as int) as entry_hour from (select distinct root from d) cross join range(0, 5) a(w) cross join range(0, 24) b(h)), c as (select root, entry_dow, entry_hour, sum(net_pnl_usd) as total, count(*) as n from d group by 1, 2, 3) select g.root, g.entry_dow, g.entry_hour, round(coalesce(total, 0), 4) as total, coalesce(n, 0) as n from g left join c on g.root = c.root and g.entry_dow = c.entry_dow and g.entry_hour = c.entry_hour",
        "met_calendar": f"with {T} select root, cast(year(exit_ts at time zone 'UTC') as int) as year, " + ", ".join(f"round(coalesce(sum(net_pnl_usd) filter (month(exit_ts at time zone 'UTC') = {int(m[1:])}), 0), 4) as {m}" for m in MONTHS) + ", round(sum(net_pnl_usd), 4) as total from d group by 1, 2",
        "met_monthly": f"with {T}, {_equity('root')}, m as (select root, cast(date_trunc('month', exit_ts at time zone 'UTC') as date) as month, arg_max(equity, ({O})) as eq from e group by 1, 2), l as (select *, lag(month) over (partition by root order by month) as b, eq - lag(eq) over (partition by root order by month) as change from m) select root, month, round(change, 4) as change from l where b = month - interval 1 month",
        "met_cost_scenarios": f"with {T}, k as (select *, net_pnl_usd - (slippage_usd + commission_usd) * (multiple - 1) as net2 from d cross join (select unnest([1.0::double, 2.0::double, 3.0::double]) as multiple)), {_equity('run_id, multiple', 'net2', 'k')} select run_id, multiple, round(sum(net2), 4) as total, round(min(drawdown), 4) as max_drawdown from e group by 1, 2",
        "met_rolling_expectancy": f"with {T} select root, trade_id, round(case when count(pnl_r) over a = 5 then avg(pnl_r) over a end, 5) as mean_r_5, round(case when count(pnl_r) over b = 20 then avg(pnl_r) over b end, 5) as mean_r_20 from d window a as (partition by root order by {O} rows between 4 preceding and current row), b as (partition by root order by {O} rows between 19 preceding and current row)",
        "met_regime_breakdown": f"with {T}, b as (select direction, entry_dow, count(*) as n, sum(net_pnl_usd) as total, avg(net_pnl_usd) as mean, avg(cast(net_pnl_usd > 0 as double)) as wr from d group by 1, 2), dy as (select direction, entry_dow, cast(exit_ts at time zone 'UTC' as date) as day, sum(net_pnl_usd) as pnl from d group by 1, 2, 3), q0 as (select *, sum(pnl) over (partition by direction, entry_dow order by day rows unbounded preceding) as eq from dy), q1 as (select *, max(eq) over (partition by direction, entry_dow order by day rows unbounded preceding) as pk from q0), q as (select direction, entry_dow, count(*) as days, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) as sharpe, min(eq - pk) as dd from q1 group by 1, 2), sp as (select direction, (epoch_us(max(exit_ts)) - epoch_us(min(entry_ts))) / 86400000000 / 7 as weeks from d group by 1) select b.direction, cast(b.entry_dow as int) as entry_dow, n, round(total, 4) as total, round(mean, 4) as mean, round(wr, 4) as win_rate, round(case when days > 2 then sharpe end, 4) as sharpe, round(case when days > 2 then total / days * 252 / nullif(abs(dd), 0) end, 4) as calmar, round(n / weeks, 4) as per_week from b join q on b.direction = q.direction and b.entry_dow = q.entry_dow join sp on b.direction = sp.direction",
        "met_event_study": f"with {T}, {ev}, k as (select trade_id, net_pnl_usd, datediff('day', day, event_date) as dist, row_number() over (partition by trade_id order by abs(datediff('day', day, event_date)), event_date) as rn from (select *, cast(entry_ts at time zone 'America/New_York' as date) as day from d where entry_ts is not null), ev), g as (select cast(i as int) as days_to_event from range(-5, 6) r(i)), c as (select dist, sum(net_pnl_usd) as total, count(*) as n from k where rn = 1 and abs(dist) <= 5 group by 1), z as (select days_to_event, coalesce(n, 0) as n, coalesce(total, 0) as total from g left join c on g.days_to_event = c.dist) select days_to_event, n, round(total, 4) as total, round(total / {len(EVENT_DAYS)}, 4) as per_event, round(sum(total / {len(EVENT_DAYS)}) over (order by days_to_event rows unbounded preceding), 4) as cumulative from z",
        "met_meta_sweep": f"with {T}, p as (select *, (1 + coalesce(sum(cast(net_pnl_usd > 0 as int)) over w, 0)) / (2.0 + count(*) over w) as wp from d window w as (partition by run_id order by {O} rows between unbounded preceding and 1 preceding)), k as (select * from p cross join (select unnest([{', '.join(f'{round(0.30 + 0.05 * i, 2)}::double' for i in range(13))}]) as threshold)), c as (select threshold, count(*) filter (wp >= threshold) as n, count(*) filter (wp >= threshold and net_pnl_usd > 0) as tp, count(*) filter (wp >= threshold and net_pnl_usd <= 0) as fp, count(*) filter (wp < threshold and net_pnl_usd > 0) as fn, coalesce(sum(net_pnl_usd) filter (wp >= threshold), 0) as total, floor((epoch_us(max(exit_ts) filter (wp >= threshold)) - epoch_us(min(entry_ts) filter (wp >= threshold))) / 86400000000) as span from k group by 1), q0 as (select *, sum(net_pnl_usd) over (partition by threshold order by {O} rows unbounded preceding) as eq from k where wp >= threshold), q as (select threshold, min(eq - pk) as dd from (select *, max(eq) over (partition by threshold order by {O} rows unbounded preceding) as pk from q0) group by 1), m as (select c.*, dd, tp / nullif(tp + fp, 0) as pr, tp / nullif(tp + fn, 0) as re from c left join q using (threshold)) select threshold, n, round(coalesce(pr, 0), 5) as win_rate, round(pr, 5) as precision, round(re, 5) as recall, round(2 * pr * re / nullif(pr + re, 0), 5) as f1, round(total, 5) as total, round(total / nullif(span, 0) * 252 / nullif(abs(dd), 0), 5) as calmar from m",
        "met_benjamini_hochberg": f"with {T}, {DP}, g as (select run_id, count(*) as n, count(*) filter (pnl > 0) as k from dp where pnl <> 0 group by 1), s as (select run_id, round(list_sum(list_transform(range(k, n + 1), lambda i: factorial(cast(n as int)) / (factorial(cast(i as int)) * factorial(cast(n - i as int))))) / pow(2, n), 9) as p from g), r as (select *, row_number() over (order by p, run_id) as rank, count(*) over () as n from s), a as (select *, least(1.0, min(p * n / rank) over (order by rank desc rows unbounded preceding)) as adj, max(case when p <= rank / n * 0.1 then rank end) over () as k from r) select run_id, rank, round(adj, 8) as adjusted_p, coalesce(rank <= k, false) as rejected from a",
        "met_leaderboard": f"with {T}, {_summary('run_id')}, q as (select run_id, n, coalesce(sw, 0) / nullif(abs(sl), 0) as pf, abs(coalesce(dd / nullif(abs(pk), 0), 0) / 100) as x from su), z as (select *, case when x > 1 then x / 100 else x end as y from q), w as (select run_id, n, case when n >= 5 and y < 1 then ln(greatest(pf, 1e-6)) * (1 - least(y, 0.99)) * (1 + log10(n / 5.0)) end as score from z) select run_id, n as total_trades, round(score, 5) as score from w where score is not null and run_id in (select run_id from q where pf is not null or true) order by w.score desc, run_id limit 10",
        "met_hold_histogram": f"with {T} select case when net_pnl_usd > 0 then 'win' else 'loss' end as outcome, cast(least(floor(least(greatest(hold_minutes, 0), 200) / 10), 19) as bigint) as bin, count(*) as n from d where hold_minutes is not null group by 1, 2",
        "met_r_histogram": f"with {T} select exit_reason, cast(least(floor((least(greatest(pnl_r, -5), 5) + 5) / (10.0::double / 60)), 59) as bigint) as bin, count(*) as n from d where pnl_r is not null group by 1, 2",
        "port_correlation": f"with {T}, {DP}, {ALIGN} select a.run_id as run_a, b.run_id as run_b, round(corr(a.pnl, b.pnl), 5) as corr from al a join al b on a.day = b.day and a.run_id < b.run_id group by 1, 2",
        "port_spearman": f"with {T}, {DP}, {ALIGN}, rk as (select day, run_id, rank() over (partition by run_id order by pnl) + (count(*) over (partition by run_id, pnl) - 1) / 2 as r from al) select a.run_id as run_a, b.run_id as run_b, round(corr(a.r, b.r), 5) as corr from rk a join rk b on a.day = b.day and a.run_id < b.run_id group by 1, 2",
        "port_combined": f"with {T}, {DP}, {CO} select day, round(pnl, 4) as pnl, round(equity, 4) as equity, round(equity - peak, 4) as drawdown from co",
        "port_sizing": sizing,
        "port_attribution": f"with {T}, {DP}, {CO}, b as (select *, (equity - peak) / case when peak = 0 then 1e-9 else peak end as p from co), g as (select *, sum(case when p < 0 then 0 else 1 end) over (order by day) as g from b), s as (select min(day) as start_day, max(day) as end_day, min(p) as max_dd_pct, arg_min(day, (p, day)) as trough_day from g where p < 0 group by g having abs(min(p)) >= 0.01), x as (select start_day, trough_day, max_dd_pct, run_id, sum(pnl) as l from s join dp on dp.day between start_day and trough_day group by all), y as (select *, sum(l) over (partition by start_day) as t from x) select start_day, trough_day, run_id, round(max_dd_pct, 5) as max_dd_pct, round(l, 5) as loss_usd, round(t, 5) as total_loss_usd, round(case when t < 0 then l / t else 0 end, 5) as share from y",
        "port_capital": f"with {T}, {_equity('run_id')}, a as (select run_id, arg_min(root, ({O})) as root, sum(net_pnl_usd) as net, max(equity) as top, max(-drawdown) as dd from e group by 1) select run_id, round(coalesce(net / nullif(i.point_value * 25, 0), 0), 9) as on_margin, round(net / (top + 100000), 9) as on_peak_capital, round(case when dd > 0 then net / dd end, 9) as on_max_dd from a left join instruments i on a.root = i.symbol",
        "port_kelly": f"with {T}, {DP}, k as (select *, exp(sum(ln(1 + pnl / 100000)) over (partition by run_id order by day rows unbounded preceding)) as c, pnl / 100000 as r from dp), m as (select *, max(c) over (partition by run_id order by day rows unbounded preceding) as p from k), z as (select run_id, avg(r) as m, var_samp(r) as v, max((p - c) / p) as h from m group by 1 having count(*) >= 2), f as (select *, case when v > 0 and m > 0 then m / v else 0 end as fk from z) select run_id, round(fk, 9) as full_kelly, round(fk / 2, 9) as half_kelly, round(case when h > 0 then least(fk, 0.2 / h) else fk end, 9) as dd_constrained_kelly, round(h, 9) as hist_max_dd from f",
        "port_rolling_correlation": f"with {T}, {DP}, {ALIGN}, p as (select a.run_id as run_a, b.run_id as run_b, a.day, a.pnl as x, b.pnl as y from al a join al b on a.day = b.day and a.run_id < b.run_id) select run_a, run_b, day, round(case when count(*) over w = 10 then corr(x, y) over w end, 5) as corr from p window w as (partition by run_a, run_b order by day rows between 9 preceding and current row)",
    }
