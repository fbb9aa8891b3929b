"""Queries of sinks, run artefacts, registries, replay, status and coded strategies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.operators import asof, metrics, portfolio, registry, resample, stationarity, strategies, walkforward
from tickloom.operators.simulate import simulate
from tickloom.plans.backtest import CONFIG, RULES, _banded
from tickloom.plans.market import ID, B, S, VWAP_SESSION, _full, _ohlc, _r, bars_of
from tickloom.plans.trading import DP, T, _summary, daily_of, trades_of
from tickloom.runtime import shared_folder, table
from tickloom.sources import broker, runs

NOW = "2024-10-01"


def sink_layer(spark, folder):
    """15-minute bars written as a layer with its manifest and read back: rows and span per symbol beside what the manifest declares."""
    path = broker.write_layer(resample.resample(bars_of(spark, folder), 15), shared_folder(spark, "layer"), "clean_15m", {"minutes": 15})
    declared = broker.read_manifests(spark, f"{path}.manifest").select("row_count")
    return spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("timestamp_utc").alias("first_ts"), F.max("timestamp_utc").alias("last_ts")).join(F.broadcast(declared.limit(1)))


def sink_run(spark, folder):
    """The artefacts of every run; the summary as read back from its JSON."""
    s = runs.write_run(trades_of(spark, folder), shared_folder(spark, "run"), ["run_id"])
    return s.select("run_id", "total_trades", *_r("win_rate", "profit_factor", "sharpe", "calmar", d=6))


def sink_walkforward(spark, folder):
    t = trades_of(spark, folder).withColumn("fold", F.month("exit_ts"))
    return runs.write_walkforward(t, shared_folder(spark, "folds"), ["run_id"]).select("run_id", F.col("fold").cast("int"), "total_trades", *_r("win_rate", d=6))


def src_logs(spark, folder):
    """Pipeline events of the files as JSON lines by day, some of them broken; the errors of two days, other days unopened."""
    f = table(spark, folder, "raw_files").select(F.col("received_at").cast("string").alias("timestamp"), F.when(F.col("file_id") % 3 == 0, "ERROR").otherwise("INFO").alias("level"), F.when(F.col("file_id") % 7 != 0, "file").alias("event"), F.col("file_id").cast("string").alias("run_id"), "symbol", F.to_date("received_at").cast("string").alias("day"))
    path = runs.save_logs(f, shared_folder(spark, "logs"))
    days = [r["day"] for r in f.select("day").distinct().orderBy("day").limit(2).collect()]
    return registry.read_logs(broker.read_logs(spark, path, days), errors_only=True).select("run_id", F.col("day").cast("string").alias("day"))


def scan_head(spark, folder):
    """The first hundred bars as a sample, as read back."""
    out = shared_folder(spark, "head")
    runs.head_sample(table(spark, folder, "bars"), out, ["bar_id"])
    return spark.read.parquet(f"{out}/head").select("bar_id", "contract", "close")


def scan_replay_window(spark, folder):
    w = runs.replay_window(bars_of(spark, folder), "2024-03-05 00:00:00", "2024-03-12 00:00:00", sma=20)
    return w.select("symbol", "timeframe", "timestamp_utc", "close", *_r("sma_20", d=9))


def shape_sequence(spark, folder):
    """Bars in order of time: every bar's place in its series."""
    from tickloom.operators.ranks import month_of, places

    return places(bars_of(spark, folder), ["symbol"], ["timestamp_utc"], month_of("timestamp_utc"), "place").select(*ID, F.col("place").cast("bigint"))


def log_usable(spark, folder):
    """Trades whose result is a finite number other than zero."""
    return metrics.usable(trades_of(spark, folder)).select("trade_id", "net_pnl_usd")


def met_degradation(spark, folder):
    """Runs by whether their last two weeks with a Calmar are both negative, of at least three."""
    t = trades_of(spark, folder).withColumn("period", F.date_format(F.date_trunc("week", "exit_ts"), "yyyy-MM-dd"))
    return metrics.degradation(metrics.summary(t, ["run_id", "period"]), ["run_id"], "period").select("run_id", F.col("periods").cast("bigint"), "degraded")


def port_benchmark(spark, folder):
    """Each run against all runs together, over the days both have."""
    d = daily_of(spark, folder)
    return portfolio.benchmark_correlation(d, portfolio.combined(d).select("day", F.col("pnl").alias("value"))).select("run_id", *_r("corr", d=6), "days")


def _manifests(spark, folder):
    w = Window.partitionBy("contract").orderBy("file_seq", "file_id")
    f = table(spark, folder, "raw_files").withColumn("p", F.lag("path").over(w))
    source = F.struct(F.col("p").alias("path"), F.lit("").alias("built_at"), F.lit(0).cast("bigint").alias("row_count"))
    return f.select("file_id", "contract", "file_seq", "path", F.when(F.col("file_seq") % 2 == 0, F.filter(F.array(source), lambda s: s["path"].isNotNull())).otherwise(F.array().cast("array<struct<path:string,built_at:string,row_count:bigint>>")).alias("sources"))


def reg_pinned(spark, folder):
    m = _manifests(spark, folder)
    return registry.pinned(m, m).select("file_id")


def reg_superseded(spark, folder):
    m = _manifests(spark, folder)
    return registry.superseded(m, m, ["contract"], "file_seq").select("file_id")


def _exports(spark, folder, first: bool):
    t = table(spark, folder, "trades")
    w = Window.partitionBy("trade_id").orderBy(F.col("exported_at") if first else F.col("exported_at").desc(), "net_pnl_usd")
    t = t.where("exported_at < timestamp'2024-03-20 00:00:00'") if first else t
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("trade_id").alias("run_id"), F.col("exported_at").alias("ts"), "exit_reason", "contract", F.col("quantity").cast("string").alias("quantity"))


def reg_trial_diff(spark, folder):
    """The registry as first exported by 20 March against all of it as last exported."""
    return registry.diff(_exports(spark, folder, True), _exports(spark, folder, False), ["exit_reason", "contract", "quantity"])


def reg_merge(spark, folder):
    return registry.merge(_exports(spark, folder, True), _exports(spark, folder, False)).groupBy("exit_reason").agg(F.count("*").alias("n"))


def reg_orphans(spark, folder):
    """Trades whose contract has no bars, as trials whose sweep is gone."""
    t = table(spark, folder, "trades").select("trade_id", "exported_at", F.upper(F.trim("contract")).alias("sweep_id"))
    return registry.orphans(t, table(spark, folder, "bars").select(F.col("contract").alias("sweep_id"))).select("trade_id", "exported_at", "sweep_id")


def reg_status_data(spark, folder):
    return runs.status(bars_of(spark, folder), trades_of(spark, folder), NOW)[0].select("symbol", "bars", F.col("age_days").cast("int"), "storage", "stale")


def reg_status_runs(spark, folder):
    return runs.status(bars_of(spark, folder), trades_of(spark, folder), NOW)[1]


def wf_sweep_record(spark, folder):
    """A sweep of which one variant cannot be made: all variants are recorded, the others run."""
    grid = [{"stop_mult": 1.0}, {"stop_mult": "no_such_column"}, {"stop_mult": 2.5}]
    failures: list[dict] = []

    def signals(b, k):
        strategies.need(b, *[v for v in k.values() if isinstance(v, str)])
        return strategies.from_rules(b, CONFIG | {"knobs": k})

    t = walkforward.sweep(_banded(spark, folder), grid, signals, RULES, failures)
    n = t.groupBy("run_id").agg(F.count("*").alias("trades"))
    return walkforward.sweep_record(spark, grid, failures).join(n, "run_id", "left").select("run_id", "status", F.coalesce("trades", F.lit(0)).cast("bigint").alias("trades"))


def sim_sized(spark, folder):
    """Trades with contracts by risk and with each instrument's own point value and commission."""
    cost = table(spark, folder, "instruments").select(F.col("symbol").alias("root"), "point_value", F.col("commission_per_side_usd").alias("commission_per_side"))
    s = strategies.from_rules(_banded(spark, folder), CONFIG).withColumn("root", F.substring("symbol", 1, 3)).join(cost, "root", "left")
    s = s.withColumn("size", strategies.position_size(25_000.0, 0.02, F.col("close") - F.col("stop"), F.col("point_value")))
    t = simulate(s, RULES)
    return t.select("symbol", F.unix_micros("entry_ts").alias("entry_us"), "quantity", *_r("net_pnl_usd", d=5))


def sim_exit_rule(spark, folder):
    """Positions given up by the strategy's own rule: a close beyond the middle of the band, at the next open."""
    s = strategies.from_rules(_banded(spark, folder), CONFIG | {"exits": {"stop": CONFIG["exits"]["stop"]}})
    s = s.withColumn("leave", F.when(F.col("close") > F.col("bb_mid"), 1).when(F.col("close") < F.col("bb_mid"), -1).otherwise(0))
    return simulate(s, RULES).groupBy("symbol", "exit_reason").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl_usd"), 4).alias("total"))


def _slow(spark, folder):
    """Bars with the hourly MACD that was complete at their time."""
    hour = ind.recursive(resample.resample(bars_of(spark, folder), 60), state=True).select("symbol", "timestamp_utc", "macd_hist", "macd_hist_slope")
    return asof.higher_timeframe(ind.recursive(bars_of(spark, folder), atr=14, state=True), hour, ["macd_hist", "macd_hist_slope"], "tf60m_")


def join_hourly_macd(spark, folder):
    return _slow(spark, folder).select(*ID, *_r("tf60m_macd_hist", "tf60m_macd_hist_slope", d=5))


def str_coded(spark, folder):
    """The coded strategies by their signals. The hourly series stands for the daily one, which these few days are too short for."""
    b = ind.donchian(ind.session_vwap(_slow(spark, folder))).withColumns({"daily_macd_hist": F.col("tf60m_macd_hist")})
    hour = ind.sma(ind.sma(resample.resample(bars_of(spark, folder), 60), 3), 6).select("symbol", "timestamp_utc", F.col("sma_3").alias("ema_50"), F.col("sma_6").alias("ema_200"))
    b = asof.higher_timeframe(b, hour, ["ema_50", "ema_200"], "daily_")
    out = None
    for name in ("donchian-breakout", "band-reversion", "macd-pullback"):
        part = strategies.TEMPLATES[name](b, {}).groupBy("symbol").agg(F.count_if(F.col("signal") > 0).alias("longs"), F.count_if(F.col("signal") < 0).alias("shorts")).withColumn("template", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stat_series(spark, folder):
    """The series the stationarity suite runs on, by their number, mean and last value."""
    out = None
    for kind in ("log_return", "vwap_spread"):
        for minutes in (5, 15):
            x = stationarity.series(bars_of(spark, folder).where("close > 0"), kind, minutes).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max_by("x", "timestamp_utc"), 5).alias("last"), F.round(F.avg("x"), 5).alias("mean"))
            x = x.select(F.lit(kind).alias("kind"), F.lit(minutes).alias("minutes"), "symbol", "n", "last", "mean")
            out = x if out is None else out.unionByName(x)
    return out


NAMES = [n for n in dict(globals()) if n.split("_")[0] in ("sink", "src", "scan", "shape", "log", "met", "port", "reg", "wf", "sim", "join", "str", "stat")]


def queries() -> dict:
    return {n: f for n in NAMES if callable(f := globals()[n]) and getattr(f, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    from tickloom.plans import backtest
    from tickloom.plans.market import MACD_ROWS, _frame

    cal = "tot / nullif(span, 0) * 252 / nullif(abs(dd), 0)"
    man = "mf as (select file_id, contract, file_seq, path, case when file_seq % 2 = 0 then lag(path) over (partition by contract order by file_seq, file_id) end as cited from raw_files)"
    ex = lambda first: f"select trade_id as run_id, exported_at as ts, exit_reason, contract, cast(quantity as varchar) as quantity from (select *, row_number() over (partition by trade_id order by exported_at {'' if first else 'desc'}, net_pnl_usd) as r from trades {'where exported_at < timestamptz ' + chr(39) + '2024-03-20 00:00:00+00' + chr(39) if first else ''}) where r = 1"
    every = " union all ".join(f"(select symbol, '{m}m' as timeframe, timestamp_utc, open, high, low, close from ({_ohlc(m)} from b group by 1, 2))" for m in (5, 15, 60))
    td = "cast((timestamp_utc + interval 6 hours) at time zone 'America/New_York' as date)"
    every += f" union all (select symbol, '1D', min(timestamp_utc), arg_min(open, timestamp_utc), max(high), min(low), arg_max(close, timestamp_utc) from b group by symbol, {td})"
    sim = backtest.simulated()
    leave = sim.replace("case when close < bb_lower or close > bb_upper then bb_mid end as target", "cast(null as double) as target").replace("when sig = -pos then 'signal' end as why", "when sig = -pos then 'signal' when pos = 1 and close > bb_mid or pos = -1 and close < bb_mid then 'rule' end as why").replace("x.sig, x.stop as stop0", "x.bb_mid, x.sig, x.stop as stop0").replace("when 'signal' then", "when 'signal' then").replace("(pos = 0 or why = 'signal')", "(pos = 0 or why in ('signal', 'rule'))")
    leave = leave.replace("case why when 'stop' then st when 'target' then tg when 'signal' then coalesce(nxo, open) - pos * 0.01", "case why when 'stop' then st when 'target' then tg when 'signal' then coalesce(nxo, open) - pos * 0.01 when 'rule' then coalesce(nxo, open) - pos * 0.01").replace("case when why = 'signal' then coalesce(nxt, ts) else ts end", "case when why in ('signal', 'rule') then coalesce(nxt, ts) else ts end")
    hb = B.replace("b as (", "b0 as (") + f", b as (select symbol, '60m' as timeframe, timestamp_utc, open, high, low, close from ({_ohlc(60)} from b0 group by 1, 2))"
    hourly = f"hm as ({MACD_ROWS.replace(B, hb)} select symbol, timestamp_utc, h, h - lag(h) over (partition by symbol order by timestamp_utc) as sl from m), hs as (select symbol, timestamp_utc, lag(h) over w as h, lag(sl) over w as sl from hm window w as (partition by symbol order by timestamp_utc))"
    return {
        "sink_layer": f"with {B}, r as ({_ohlc(15)} from b group by 1, 2) select symbol, count(*) as bars, min(timestamp_utc) as first_ts, max(timestamp_utc) as last_ts, (select count(*) from r) as row_count from r group by 1",
        "sink_run": f"with {T}, {_summary('run_id')} select run_id, n as total_trades, round(wr, 6) as win_rate, round(coalesce(sw, 0) / nullif(abs(sl), 0), 6) as profit_factor, round(sharpe, 6) as sharpe, round({cal}, 6) as calmar from su",
        "sink_walkforward": f"with {T} select run_id, cast(month(exit_ts at time zone 'UTC') as int) as fold, count(*) as total_trades, round(avg(cast(net_pnl_usd > 0 as double)), 6) as win_rate from d group by 1, 2",
        "src_logs": "with f as (select file_id, cast(received_at at time zone 'UTC' as date) as day from raw_files), k as (select distinct day from f order by day limit 2) select cast(file_id as varchar) as run_id, cast(day as varchar) as day from f where day in (select day from k) and file_id % 3 = 0 and file_id % 7 <> 0",
        "scan_head": "select bar_id, contract, close from bars order by bar_id limit 100",
        "scan_replay_window": f"with {B}, e as ({every}), m as (select *, case when count(close) over w = 20 then avg(close) over w end as sma from e window w as (partition by symbol, timeframe order by timestamp_utc rows between 19 preceding and current row)) select symbol, timeframe, timestamp_utc, close, round(sma, 9) as sma_20 from m where timestamp_utc between timestamptz '2024-03-05 00:00:00+00' and timestamptz '2024-03-12 00:00:00+00'",
        "shape_sequence": f"with {B} select symbol, timestamp_utc, row_number() over (partition by symbol order by timestamp_utc) as place from b",
        "log_usable": f"with {T} select trade_id, net_pnl_usd from d where net_pnl_usd is not null and isfinite(net_pnl_usd) and net_pnl_usd <> 0",
        "met_degradation": f"with {T}, dd as (select *, strftime(date_trunc('week', exit_ts at time zone 'UTC'), '%Y-%m-%d') as period from d), {_summary('run_id, period', 'dd')}, k as (select run_id, period, {cal} as c from su), g as (select run_id, c, row_number() over (partition by run_id order by period desc) as r, count(*) over (partition by run_id) as n from k where c is not null), h as (select run_id, any_value(n) as n, max(n) >= 3 and bool_and(c < 0) filter (r <= 2) as bad from g group by 1), a as (select distinct run_id from d) select a.run_id, coalesce(n, 0) as periods, coalesce(bad, false) as degraded from a left join h using (run_id)",
        "port_benchmark": f"with {T}, {DP}, c as (select day, sum(pnl) as b from dp group by 1) select run_id, round(case when stddev_pop(pnl) > 0 and stddev_pop(b) > 0 then corr(pnl, b) end, 6) as corr, count(*) as days from dp join c using (day) group by 1",
        "reg_pinned": f"with {man} select file_id from mf where path in (select cited from mf where cited is not null)",
        "reg_superseded": f"with {man}, r as (select *, row_number() over (partition by contract order by file_seq desc, path) as r from mf) select file_id from r where r > 1 and path not in (select cited from mf where cited is not null)",
        "reg_trial_diff": f"with o as ({ex(True)}), n as ({ex(False)}) select n.run_id, 'added' as change, null as field from n where run_id not in (select run_id from o) union all select o.run_id, 'removed', null from o where run_id not in (select run_id from n) union all " + " union all ".join(f"select n.run_id, 'changed', '{f}' from n join o using (run_id) where n.{f} is distinct from o.{f}" for f in ("exit_reason", "contract", "quantity")),
        "reg_merge": f"with n as ({ex(False)}) select exit_reason, count(*) as n from n group by 1",
        "reg_orphans": "select trade_id, exported_at, upper(trim(contract)) as sweep_id from trades where upper(trim(contract)) not in (select contract from bars where contract is not null)",
        "reg_status_data": f"with {B} select symbol, count(*) as bars, cast(datediff('day', cast(max(timestamp_utc) at time zone 'UTC' as date), date '{NOW}') as int) as age_days, case when count(*) * 96 / 1e6 < 0.1 then 'small' when count(*) * 96 / 1e6 < 100 then 'medium' else 'large' end as storage, datediff('day', cast(max(timestamp_utc) at time zone 'UTC' as date), date '{NOW}') > 7 as stale from b group by 1",
        "reg_status_runs": f"with {T} select run_id, max(exit_ts) as last_exit, count(*) as trades from d group by 1 order by max(exit_ts) desc nulls last, run_id limit 5",
        "wf_sweep_record": "with s as (" + backtest.oracle_sql()["wf_sweep"] + ") select 'v0000' as run_id, 'ok' as status, (select trades from s where run_id = 'v0000') as trades union all select 'v0001', 'failed', 0 union all select 'v0002', 'ok', (select trades from s where run_id = 'v0002')",
        "sim_sized": f"{sim}, c as (select symbol as root, point_value as pv, commission_per_side_usd as cm from instruments), kz as (select tr.symbol, epoch_us(ets) as entry_us, greatest(1, cast(floor(500 / nullif(abs(x.close - x.stop) * c.pv, 0)) as bigint)) as quantity, d * (price - e) as pts, pv, cm from tr join x on x.symbol = tr.symbol and x.nxt = tr.ets left join c on c.root = substr(tr.symbol, 1, 3)) select symbol, entry_us, quantity, round((pts * pv - 0.01 * pv * 2 - cm * 2) * quantity, 5) as net_pnl_usd from kz",
        "sim_exit_rule": f"{leave} select symbol, reason as exit_reason, count(*) as n, round(sum(d * (price - e) * 50 - 0.01 * 50 * 2 - 4), 4) as total from tr group by 1, 2",
        "join_hourly_macd": f"with {B}, {hourly} select b.symbol, b.timestamp_utc, round(hs.h, 5) as tf60m_macd_hist, round(hs.sl, 5) as tf60m_macd_hist_slope from b asof left join hs on b.symbol = hs.symbol and b.timestamp_utc >= hs.timestamp_utc",
        "str_coded": f"""with {B}, {hourly}, ms as ({backtest.macd_state_sql()}), ax as ({backtest.atr_sql()}), vw as ({backtest.bands_sql()}), dc as (select symbol, timestamp_utc, lag(u) over (partition by symbol order by timestamp_utc) as u, lag(l) over (partition by symbol order by timestamp_utc) as l from (select symbol, timestamp_utc, {_full('max(high)', 'high', 20)} as u, {_full('min(low)', 'low', 20)} as l from b)),
            ho as (select symbol, timestamp_utc, lag(a) over (partition by symbol order by timestamp_utc) as a, lag(c) over (partition by symbol order by timestamp_utc) as c from (select symbol, timestamp_utc, case when count(close) over w3 = 3 then avg(close) over w3 end as a, case when count(close) over w6 = 6 then avg(close) over w6 end as c from ({_ohlc(60)} from b group by 1, 2) window w3 as (partition by symbol order by timestamp_utc rows between 2 preceding and current row), w6 as (partition by symbol order by timestamp_utc rows between 5 preceding and current row))),
            q as (select b.symbol, b.close as c, hs.h as hh, hs.sl as hsl, ms.h, ms.streak, ax.y as atr, vw.v, vw.sd, dc.u, dc.l, ho.a as fast, ho.c as slow, hour(b.timestamp_utc at time zone 'UTC') * 60 + minute(b.timestamp_utc at time zone 'UTC') as mi
                from b asof left join hs on b.symbol = hs.symbol and b.timestamp_utc >= hs.timestamp_utc asof left join ho on b.symbol = ho.symbol and b.timestamp_utc >= ho.timestamp_utc join ms on ms.symbol = b.symbol and ms.timestamp_utc = b.timestamp_utc join ax on ax.symbol = b.symbol and ax.timestamp_utc = b.timestamp_utc join vw on vw.symbol = b.symbol and vw.timestamp_utc = b.timestamp_utc join dc on dc.symbol = b.symbol and dc.timestamp_utc = b.timestamp_utc),
            s as (select 'donchian-breakout' as template, symbol, case when atr is null then 0 when c > u and fast > slow then 1 when c < l and fast < slow then -1 else 0 end as sig from q union all
                select 'band-reversion', symbol, case when atr is null or not (mi >= 800 and mi < 1200) then 0 when c < v - 2 * sd and hh > 0 then 1 when c > v + 2 * sd and hh < 0 then -1 else 0 end from q union all
                select 'macd-pullback', symbol, case when atr is null then 0 when hh > 0 and hsl >= 0 and h < 0 and streak <= -3 then 1 when hh < 0 and hsl <= 0 and h > 0 and streak <= -3 then -1 else 0 end from q)
            select template, symbol, count(*) filter (sig > 0) as longs, count(*) filter (sig < 0) as shorts from s group by 1, 2""",
        "stat_series": f"with {B.replace('where close is not null', 'where close > 0')}, vw as ({VWAP_SESSION.replace('where close is not null', 'where close > 0')}), j as (select b.symbol, b.timestamp_utc, b.close, b.close - vw.vwap_session as sp from b join vw on vw.symbol = b.symbol and vw.timestamp_utc = b.timestamp_utc), " + ", ".join(f"k{m} as (select symbol, floor(epoch(timestamp_utc) / {m * 60}) as slot, arg_max(ln(close), timestamp_utc) as lc, arg_max(sp, timestamp_utc) as sp from j group by 1, 2), r{m} as (select symbol, slot, lc - lag(lc) over (partition by symbol order by slot) as x from k{m})" for m in (5, 15)) + " " + " union all ".join(f"select 'log_return' as kind, {m} as minutes, symbol, count(x) as n, round(arg_max(x, slot) filter (x is not null), 5) as last, round(avg(x), 5) as mean from r{m} where x is not null group by symbol union all select 'vwap_spread', {m}, symbol, count(sp), round(arg_max(sp, slot), 5), round(avg(sp), 5) from k{m} where sp is not null group by symbol" for m in (5, 15)),
    }
