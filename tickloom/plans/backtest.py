"""Queries of the feature builder, rule language, simulator, folds, sweeps, resampling, tests, registry and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.operators import asof, context, features, learn, metrics, registry, resampling, stationarity, strategies, walkforward
from tickloom.operators.simulate import Rules, simulate
from tickloom.plans.market import ADX, B, DM, EVENT_DAYS, ID, TR, VWAP_SESSION, VWAP_SESSION_BANDS, S, _ema_step, _frame, _event_days, _full, _ohlc, _r, _recursion, bars_of
from tickloom.plans.trading import T, O, _summary, trades_of
from tickloom.runtime import shared_folder, table
from tickloom.sources import broker

RULES = Rules(tick_size=0.01, point_value=50.0, slippage_ticks=1.0, commission_per_side=2.0, quantity=1, eod_flat=True, rth_close_minute=960, max_holding_bars=40)
CONFIG = {
    "knobs": {"stop_mult": 2.0},
    "entry": {"long": {"all": ["close < bb_lower"]}, "short": {"all": ["close > bb_upper"]}},
    "exits": {"stop": {"long": "close - stop_mult * half", "short": "close + stop_mult * half"}, "target": {"long": "bb_mid", "short": "bb_mid"}},
}


def _banded(spark, folder):
    b = ind.bollinger(bars_of(spark, folder))
    r = lambda c: F.round(c, 9).alias(c)
    b = b.select(*[c for c in b.columns if not c.startswith("bb_")], r("bb_mid"), r("bb_upper"), r("bb_lower"))
    return b.withColumn("half", F.round(F.col("bb_upper") - F.col("bb_mid"), 9))


def str_rule_signals(spark, folder):
    s = strategies.from_rules(_banded(spark, folder), CONFIG)
    return s.select(*ID, "signal", *_r("stop", "target", d=9))


def str_expression(spark, folder):
    """The language's corners: shift, division by zero, inequality with a missing side."""
    from tickloom.functions.expressions import Compiler

    b = ind.sma(bars_of(spark, folder), 20).withColumn("sma_20", F.round("sma_20", 7))
    c = Compiler(b.columns, {"k": 2.0}, ind.series())
    return b.select(*ID, c.condition("close > shift(close, 3) and volume > k * 10").alias("up"), c.condition("sma_20 != close").alias("off"), c.condition("not (close - open > 0) or high - low == 0").alias("down"), c.condition("1 / (high - low) > 100").alias("tight"))


def str_templates(spark, folder):
    b = ind.session_vwap(ind.recursive(bars_of(spark, folder), atr=14, adx=14))
    frames = [strategies.TEMPLATES[n](b, {}).select(F.lit(n).alias("template"), "symbol", "signal") for n in ("always-flat", "vwap-reversion", "vwap-reversion-adx")]
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return out.groupBy("template", "symbol").agg(F.count_if(F.col("signal") > 0).alias("longs"), F.count_if(F.col("signal") < 0).alias("shorts"))


def str_volatility_regime(spark, folder):
    b = ind.true_range(bars_of(spark, folder)).withColumn("train", F.dayofmonth("timestamp_utc") <= 20)
    return strategies.volatility_regime(b, 75, ["symbol"], "true_range").select(*ID, "calm")


def sim_trades(spark, folder):
    t = simulate(strategies.from_rules(_banded(spark, folder), CONFIG), RULES)
    us = lambda c, n: F.unix_micros(c).alias(n)
    return t.select("symbol", "direction", us("entry_ts", "entry_us"), us("exit_ts", "exit_us"), "exit_reason", *_r("entry_price", "exit_price", "net_pnl_usd", "mae_points", "mfe_points", d=8))


def sim_summary(spark, folder):
    t = simulate(strategies.from_rules(_banded(spark, folder), CONFIG), RULES)
    return metrics.summary(t, ["symbol"]).select("symbol", "total_trades", *_r("win_rate", "profit_factor", "max_drawdown_usd", d=5))


def sim_scale_in(spark, folder):
    from dataclasses import replace

    s = strategies.from_rules(ind.recursive(_banded(spark, folder), atr=14), CONFIG)
    t = simulate(s, replace(RULES, scale_in_atr=1.0, max_scale_ins=2))
    return t.groupBy("symbol", "exit_reason", "leg").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl_usd"), 4).alias("total"))


def wf_contiguous(spark, folder):
    f = walkforward.contiguous_folds(strategies.from_rules(_banded(spark, folder), CONFIG), 4, 20, 10)
    return simulate(f, RULES).groupBy("symbol", "fold").agg(F.count("*").alias("trades"), F.round(F.sum("net_pnl_usd"), 4).alias("total"))


def wf_fold_bounds(spark, folder):
    f = walkforward.contiguous_folds(bars_of(spark, folder), 4, 20, 10)
    return f.groupBy("symbol", "fold").agg(F.count("*").alias("bars"), F.min("timestamp_utc").alias("first_ts"))


def wf_rolling(spark, folder):
    f = walkforward.rolling_folds(bars_of(spark, folder), "2 days", "1 days", 5)
    return f.groupBy("symbol", "fold", "train").agg(F.count("*").alias("bars"))


def wf_sweep(spark, folder):
    grid = walkforward.expand({"stop_mult": [1.0, 1.5, 2.5]})
    t = walkforward.sweep(_banded(spark, folder), grid, lambda b, k: strategies.from_rules(b, CONFIG | {"knobs": k}), RULES)
    return t.groupBy("run_id").agg(F.count("*").alias("trades"), F.round(F.sum("net_pnl_usd"), 4).alias("total"))


def wf_positive_folds(spark, folder):
    t = trades_of(spark, folder).withColumn("week", F.weekofyear("exit_ts"))
    f = t.groupBy("run_id", "week").agg(F.sum("net_pnl_usd").alias("calmar"))
    return registry.positive_folds(f, ["run_id"]).select("run_id", F.col("n").cast("bigint"), F.col("k").cast("bigint"), *_r("p_value", d=8))


def feat_base_v1(spark, folder):
    f = features.build(bars_of(spark, folder), 15, features.BASE_V1)
    names = ["atr_14", "rsi_14", "adx_14", "bb_pct_b", "macd_hist", "donchian_upper", "sma_200", "ofi_14", "vwap_session", "vwap_weekly", "daily_ema_20", "daily_atr_14"]
    return f.select(*ID, *_r(*names, d=5))


def feat_base_v2(spark, folder):
    f = features.build(bars_of(spark, folder), 60, features.BASE_V2)
    return f.select(*ID, *_r("ema_9", "ema_20", "cci_14", "atr_14", d=5))


def ctx_session_labels(spark, folder):
    return context.context(ind.session_vwap(ind.recursive(bars_of(spark, folder), atr=14))).groupBy("symbol", "session").agg(F.count("*").alias("n"))


def ctx_regime_tags(spark, folder):
    """Trades by regime: the volatility's rank and the ADX at the bar nearest to the entry, and the nearest event."""
    b = ind.recursive(ind.true_range(bars_of(spark, folder)), adx=14)
    b = ind.percentile_rank(b, "true_range", 300, 20, "atr_rank").select(*ID, "atr_rank", F.round("adx_14", 9).alias("daily_adx"))
    t = trades_of(spark, folder).where("entry_ts is not null").withColumn("day", F.to_date(F.from_utc_timestamp("entry_ts", "America/New_York")))
    t = asof.asof_nearest(t, b, ["symbol"], ["atr_rank", "daily_adx"], left_ts="entry_ts", tolerance_us=600_000_000)
    t = asof.nearest_event(t, _event_days(spark), day="day")
    return context.regime_tags(t).groupBy("vol_regime", "trend_regime", "event_regime", "week_of_month").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl_usd"), 4).alias("total"))


def rs_bootstrap(spark, folder):
    i = resampling.intervals(resampling.samples(trades_of(spark, folder), ["run_id"]), ["run_id"])
    return i.select("run_id", *_r("expectancy_lo", "expectancy_hi", "win_rate_lo", "win_rate_hi"))


def rs_shuffle(spark, folder):
    return resampling.shuffle_ranks(trades_of(spark, folder), ["run_id"]).select("run_id", *_r("actual", "median", "p95", "rank", d=4))


def rs_hash_bootstrap(spark, folder):
    return resampling.hash_bootstrap_means(trades_of(spark, folder), ["run_id"]).select("run_id", "sample", *_r("mean", d=8))


def rs_generic_bootstrap(spark, folder):
    return resampling.generic_bootstrap(trades_of(spark, folder), ["run_id"]).select("run_id", *_r("point", "lo", "hi"))


def stat_tests(spark, folder):
    b = bars_of(spark, folder).withColumn("x", F.ln("close") - F.lag(F.ln("close")).over(ind.series())).where("x is not null")
    return stationarity.tests(b, ["symbol"], ["timestamp_utc"], "x").select("symbol", "test", *_r("statistic", "p_value", d=5), "n")


def stat_half_life(spark, folder):
    h = stationarity.half_life(bars_of(spark, folder), ["symbol"], ["timestamp_utc"], "close")
    return h.select("symbol", "n", *_r("beta", "r_squared", "half_life", d=4), "kind", stationarity.half_life_label(F.col("half_life"), F.lit(5.0), F.lit(60.0)).alias("label"))


def stat_dfa(spark, folder):
    d = stationarity.dfa_relational(bars_of(spark, folder).withColumn("x", F.col("close") - F.col("open")), ["symbol"], ["timestamp_utc"], "x")
    return d.select("symbol", *_r("exponent", d=5), "windows", stationarity.hurst_label(F.col("exponent")).alias("label"))


def _runs_as_trials(spark, folder):
    s = metrics.summary(trades_of(spark, folder), ["run_id"])
    return s.select("run_id", F.col("run_id").alias("strategy_id"), F.substring("run_id", 1, 4).alias("cohort_label"), F.lit("exploration").alias("mode"), "sharpe", "calmar", "win_rate", "total_trades", F.col("total_trades").cast("int").alias("n_obs"), F.lit(0.0).alias("skewness"), F.lit(3.0).alias("kurtosis_pearson"))


def reg_leaderboard(spark, folder):
    return registry.leaderboard(_runs_as_trials(spark, folder), {"mode": "exploration"}, "calmar", True, 10).select("run_id", *_r("calmar", "sharpe", d=5))


def reg_deflated_sharpe(spark, folder):
    return registry.deflated_sharpe(_runs_as_trials(spark, folder)).select("cohort_label", "trials", *_r("sharpe", "benchmark", "dsr", d=6))


def reg_trial_tiers(spark, folder):
    t = table(spark, folder, "trades").groupBy("strategy_id", F.to_date("exported_at").alias("ts")).agg(F.count("*").alias("n"))
    return registry.trial_tiers(t, "2024-10-01").groupBy("tier", "archive_month").agg(F.sum("n").alias("n"))


def reg_keep_runs(spark, folder):
    t = table(spark, folder, "trades").select("strategy_id", F.col("trade_id").alias("run_id"), F.col("exported_at").alias("ts"), F.when(F.col("quantity") == 3, "validation").otherwise("exploration").alias("mode"))
    return registry.keep_runs(t.groupBy("strategy_id", "run_id", "mode").agg(F.max("ts").alias("ts")), 5).groupBy("strategy_id").agg(F.count("*").alias("to_delete"))


def reg_manifests(spark, folder):
    """Files whose declared row count is not the actual one, the count under a known name, as a number or as text; or that declare none."""
    names = ["row_count", "n_rows", "rows", "record_count"]
    f = table(spark, folder, "raw_files").select("file_id", F.from_json("manifest", ", ".join(f"{n} string" for n in names)).alias("m"))
    count = lambda n: F.expr(f"try_cast(round(try_cast(m.{n} as decimal(38, 6))) as bigint)")
    n = table(spark, folder, "raw_records").groupBy("file_id").agg(F.count("*").alias("actual"))
    return f.select("file_id", F.coalesce(*[count(n) for n in names]).alias("declared")).join(n, "file_id", "left").where("not declared <=> coalesce(actual, 0)").select("file_id", "declared", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))


def reg_lineage(spark, folder):
    """Files built from the file before them in their contract: sources that arrived later than what cites them."""
    from pyspark.sql import Window

    w = Window.partitionBy("contract").orderBy("file_seq")
    f = table(spark, folder, "raw_files").withColumn("p", F.lag("path").over(w))
    m = f.select("path", F.col("received_at").cast("string").alias("built_at"), F.when(F.col("p").isNotNull(), F.array(F.struct(F.col("p").alias("path"), F.lit("").alias("built_at"), F.lit(0).cast("bigint").alias("row_count")))).alias("sources"))
    return registry.stale(m)


def src_normalise_payload(spark, folder):
    """Every record in the broker's own field names, and whether they gave a whole bar; p2_records follows names that drift."""
    r = broker.normalise_payload(table(spark, folder, "raw_records").select("record_id", "payload"))
    return r.select("record_id", "open", "high", "low", "close", "volume", "valid")


def src_fetch_windows(spark, folder):
    return broker.fetch_windows(spark, "2024-01-01", "2024-12-31")


def ml_win_probabilities(spark, folder):
    t = trades_of(spark, folder).withColumns({"hour": F.col("entry_hour").cast("double"), "size": F.col("quantity").cast("double")})
    p = learn.win_probabilities(t, ["hour", "size", "mae_points"])
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("win_prob"), 4).alias("mean"))


def _ml_trades(spark, folder):
    return trades_of(spark, folder).withColumns({"hour": F.col("entry_hour").cast("double"), "size": F.col("quantity").cast("double")})


def ml_importance(spark, folder):
    return learn.importance(_ml_trades(spark, folder), ["hour", "size", "mae_points"]).select("fold", "feature", *_r("importance", d=6))


def ml_partial_dependence(spark, folder):
    return learn.partial_dependence(_ml_trades(spark, folder), ["hour", "size", "mae_points"]).select("feature", "value", *_r("win_prob", d=6))


def ml_clusters(spark, folder):
    t = trades_of(spark, folder).withColumns({"hour": F.col("entry_hour").cast("double"), "size": F.col("quantity").cast("double")})
    names = ["hour", "size", "mae_r", "mfe_r"]
    return learn.cluster_marks(learn.clusters(t, names), names).select("cluster", "rank", "feature", *_r("gap", "mean_pnl", "win_rate", d=4), "trades")


def stream_resample_15m(spark, folder):
    """The streaming twin of agg_resample_15m, run to the end of the bars' table into the shared folder."""
    from tickloom.streaming.bars import run_once, stream_clean, stream_resample, with_end

    path = f"{folder}/bars.parquet"
    schema = table(spark, folder, "bars").schema
    pattern = path if os.path.isdir(path.removeprefix("file://")) else f"{folder}/bars*.parquet"
    base = shared_folder(spark, "stream")
    rows = with_end(spark.readStream.schema(schema).parquet(pattern), f"{base}/end")
    return run_once(stream_resample(stream_clean(rows, "1 hour"), 15, None), base)


NAMES = [n for n in dict(globals()) if n.split("_")[0] in ("str", "sim", "wf", "feat", "ctx", "rs", "stat", "reg", "src", "ml", "stream")]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES if callable(globals()[n])}


_F20 = f"({S} rows between 19 preceding and current row)"


def _band() -> str:
    return f"""{B}, bb as (select *, case when count(close) over {_F20} = 20 then avg(close) over {_F20} end as mid, case when count(close) over {_F20} = 20 then stddev_samp(close) over {_F20} end as dev from b),
        k as (select *, round(mid, 9) as bb_mid, round(mid + 2 * dev, 9) as bb_upper, round(mid - 2 * dev, 9) as bb_lower, round(round(mid + 2 * dev, 9) - round(mid, 9), 9) as half from bb),
        sg as (select *, case when close < bb_lower then 1 when close > bb_upper then -1 else 0 end as sig, case when close < bb_lower then close - 2 * half when close > bb_upper then close + 2 * half end as stop,
            case when close < bb_lower or close > bb_upper then bb_mid end as target from k)"""


def _sim(source: str) -> str:
    """Trades tr of a signal table sg by a recursion over its bars x."""
    return f"""with recursive {source}, x as (select *, row_number() over (partition by symbol order by timestamp_utc) as n, count(*) over (partition by symbol) as nn, lead(open) over (partition by symbol order by timestamp_utc) as nxo, lead(timestamp_utc) over (partition by symbol order by timestamp_utc) as nxt,
            hour(timestamp_utc at time zone 'America/New_York') * 60 + minute(timestamp_utc at time zone 'America/New_York') as mi from sg),
        r as (
            select symbol, n, 0::int as pos, 0::double as ep, 0::double as st, 0::double as tg, 0::bigint as held, 0::double as lo, 0::double as hi, null::timestamptz as ets, null::varchar as reason, 0::double as xp, 0::int as xd, 0::double as xe, null::timestamptz as xet, null::timestamptz as xts, 0::double as xlo, 0::double as xhi from x where n = 0
            union all select symbol, 0::bigint, 0::int, 0::double, 0::double, 0::double, 0::bigint, 0::double, 0::double, null::timestamptz, null::varchar, 0::double, 0::int, 0::double, null::timestamptz, null::timestamptz, 0::double, 0::double from (select distinct symbol from x)
            union all
            select symbol, n, cast(case when go then sig when closed then 0 else pos end as int), case when go then nxo + sig * 0.01 else ep end, case when go then stop0 else st end, case when go then tg0 else tg end,
                cast(case when go then 0 else held1 end as bigint), case when go then 1e300 else lo1 end, case when go then -1e300 else hi1 end, case when go then nxt else ets end,
                why, case why when 'stop' then st when 'target' then tg when 'signal' then coalesce(nxo, open) - pos * 0.01 when 'end' then close else close - pos * 0.01 end, cast(case when closed then pos else 0 end as int), ep, ets, case when why = 'signal' then coalesce(nxt, ts) else ts end, lo1, hi1
            from (select *, why is not null as closed, (pos = 0 or why = 'signal') and sig <> 0 and nxo is not null and stop0 is not null as go from (
                select q.*, case when pos = 0 then null when mi >= 960 then 'eod' when held1 >= 40 then 'time_limit' when (pos = 1 and low <= st) or (pos = -1 and high >= st) then 'stop' when (pos = 1 and high >= tg) or (pos = -1 and low <= tg) then 'target' when sig = -pos then 'signal' end as why
                from (select p.symbol, x.n, p.pos, p.ep, p.st, p.tg, p.held + 1 as held1, least(p.lo, x.low) as lo1, greatest(p.hi, x.high) as hi1, p.ets, x.low, x.high, x.close, x.open, x.sig, x.stop as stop0, x.target as tg0, x.nxo, x.nxt, x.timestamp_utc as ts, x.mi
                    from r p join x on x.symbol = p.symbol and x.n = p.n + 1) q) z) y),
        lastbar as (select x.symbol, x.close, x.timestamp_utc as ts, x.low, x.high, x.n from x where n = nn),
        tr as (select symbol, xd as d, xe as e, xp as price, xet as ets, xts, case when reason = 'end' then 'eod' else reason end as reason, xlo, xhi from r where reason is not null
            union all select r.symbol, r.pos, r.ep, l.close, r.ets, l.ts, 'eod', case when r.lo > 1e299 then l.low else r.lo end, case when r.hi < -1e299 then l.high else r.hi end from r join lastbar l on r.symbol = l.symbol and r.n = l.n where r.pos <> 0)"""


def simulated() -> str:
    return _sim(_band())


def macd_state_sql() -> str:
    """symbol, timestamp_utc, h, streak of the base bars."""
    from tickloom.plans import market

    whole = market.oracle_sql()["ind_macd_state"]
    return whole.replace("select symbol, timestamp_utc, coalesce(h > 0, false) as macd_hist_above_zero,", "select symbol, timestamp_utc, h, coalesce(h > 0, false) as macd_hist_above_zero,").replace("as decline_streak from f", "as streak from f").replace("union all select symbol, timestamp_utc, false,", "union all select symbol, timestamp_utc, null, false,")


def atr_sql() -> str:
    return f"with recursive {B}, {_recursion({'y': ('tr', _ema_step('y', '(1.0/14)', 'x.tr'))}, TR)} select symbol, timestamp_utc, case when n > 14 then y end as y from r"


def bands_sql() -> str:
    return VWAP_SESSION_BANDS.replace("round(x0 + m, 8) as vwap_session", "x0 + m as v").replace("round(sqrt(greatest(q - m * m, 0)), 4) as vwap_session_band_1_0", "sqrt(greatest(q - m * m, 0)) as sd")


_V2 = B.replace("b as (", "b0 as (") + f", b as (select symbol, '60m' as timeframe, timestamp_utc, open, high, low, close from ({_ohlc(60).replace('select symbol,', 'select symbol,', 1)} from b0 group by 1, 2))"
FEAT_V2 = f"with recursive {_V2}, {_recursion({'e9': ('close', _ema_step('e9', '0.2', 'x.close')), 'e20': ('close', _ema_step('e20', '(2.0/21)', 'x.close')), 'y': ('tr', _ema_step('y', '(1.0/14)', 'x.tr'))}, TR)}" + f", t as (select *, (high + low + close) / 3 as tp from b), m as (select *, {_full('avg(tp)', 'tp', 14)} as mean, list(tp) over {_frame(14)} as fr from t) select r.symbol, r.timestamp_utc, round(case when n >= 9 then e9 end, 5) as ema_9, round(case when n >= 20 then e20 end, 5) as ema_20, round((tp - mean) / nullif(0.015 * list_sum(list_transform(fr, lambda v: abs(v - mean))) / 14, 0), 5) as cci_14, round(case when n > 14 then y end, 5) as atr_14 from r join m on m.symbol = r.symbol and m.timestamp_utc = r.timestamp_utc"
_ADX = ADX.format(b=B, r=_recursion(DM, TR))
STR_TEMPLATES = f"""{_ADX}, vw as ({VWAP_SESSION}), q as (select w.symbol, b.close as c, vw.vwap_session as v, case when w.n > 28 then a.y end as adx, case when w.n > 14 then rr.tr end as atr, hour(w.timestamp_utc at time zone 'UTC') * 60 + minute(w.timestamp_utc at time zone 'UTC') as mi,
    (hour(w.timestamp_utc at time zone 'America/New_York') * 60 + minute(w.timestamp_utc at time zone 'America/New_York') + 360) % 1440 as since from w left join a on a.symbol = w.symbol and a.timeframe = w.timeframe and a.k = w.seen
    join r rr on rr.symbol = w.symbol and rr.timestamp_utc = w.timestamp_utc join b on b.symbol = w.symbol and b.timestamp_utc = w.timestamp_utc join vw on vw.symbol = w.symbol and vw.timestamp_utc = w.timestamp_utc),
    s as (select 'always-flat' as template, symbol, 0 as sig from q union all
        select 'vwap-reversion', symbol, case when mi >= 720 and mi < 1020 and since >= 60 then case when (c - v) / nullif(atr, 0) < -2.2 then 1 when (c - v) / nullif(atr, 0) > 2.2 then -1 else 0 end else 0 end from q union all
        select 'vwap-reversion-adx', symbol, case when mi >= 720 and mi < 1020 and adx < 22 then case when c < v - 1.5 * atr then 1 when c > v + 1.5 * atr then -1 else 0 end else 0 end from q)
    select template, symbol, count(*) filter (sig > 0) as longs, count(*) filter (sig < 0) as shorts from s group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    band, sim = _band(), _sim
    f20 = _F20
    # many runs at once: their key stands in for the symbol
    keyed = lambda key, more: band.replace("sg as (", "sg0 as (") + f", {more}, sg as (select {key} as key, * exclude (symbol) from sg1)"
    of = lambda source: sim(source.replace("as key,", "as symbol,"))
    net = "d * (price - e) * 50 - 0.01 * 50 * 2 - 4"
    size = "(t - 90) // 4"
    folds = f"sg1 as (select * exclude (i, t) from (select *, case when i < {size} then 0 when i >= ({size} + 30) + 10 and i < ({size} + 30) + 10 + {size} then 1 when i >= 2 * ({size} + 30) + 10 and i < 2 * ({size} + 30) + 10 + {size} then 2 when i >= 3 * ({size} + 30) + 10 then 3 end as fold from (select *, row_number() over (partition by symbol order by timestamp_utc) - 1 as i, count(*) over (partition by symbol) as t from sg0) where t - 90 >= 40) where fold is not null)"
    knobs = "sg1 as (select sg0.* exclude (stop), v.run_id, case when close < bb_lower then close - v.m * half when close > bb_upper then close + v.m * half end as stop from sg0 cross join (values ('v0000', 1.0), ('v0001', 1.5), ('v0002', 2.5)) v(run_id, m))"
    runs = f"with {T}"
    return {
        "str_rule_signals": f"with {band} select symbol, timestamp_utc, cast(sig as int) as signal, round(stop, 9) as stop, round(target, 9) as target from sg",
        "str_expression": f"with {B}, m as (select *, case when count(close) over {f20} = 20 then avg(close) over {f20} end as sma, lag(close, 3) over ({S}) as c3 from b) select symbol, timestamp_utc, coalesce(close > c3, false) and volume > 20 as up, coalesce(round(sma, 7) <> close, true) as off, not (close - open > 0) or high - low = 0 as down, case when high - low = 0 then true else 1 / (high - low) > 100 end as tight from m",
        "str_volatility_regime": f"with {B}, t as (select *, greatest(high - low, abs(high - lag(close) over ({S})), abs(low - lag(close) over ({S}))) as tr from b), l as (select symbol, quantile_cont(tr, 0.75) as lim from t where day(timestamp_utc at time zone 'UTC') <= 20 group by 1) select t.symbol, timestamp_utc, coalesce(tr > 0 and tr <= lim, false) as calm from t left join l on t.symbol = l.symbol",
        "sim_trades": f"{sim(band)} select symbol, case when d > 0 then 'long' else 'short' end as direction, epoch_us(ets) as entry_us, epoch_us(xts) as exit_us, reason as exit_reason, round(e, 8) as entry_price, round(price, 8) as exit_price, round(d * (price - e) * 50 - 0.01 * 50 * 2 - 4, 8) as net_pnl_usd, round(case when d > 0 then e - xlo else xhi - e end, 8) as mae_points, round(case when d > 0 then xhi - e else e - xlo end, 8) as mfe_points from tr",
        "sim_summary": f"{sim(band)}, g as (select symbol, {net} as net_pnl_usd, ets as entry_ts, xts as exit_ts, cast(row_number() over (order by symbol, ets, xts) as varchar) as trade_id, 0.0 as mae_points, 0.0 as mfe_points from tr), {_summary('symbol', 'g')} select symbol, n as total_trades, round(wr, 5) as win_rate, round(coalesce(sw, 0) / nullif(abs(sl), 0), 5) as profit_factor, round(dd, 5) as max_drawdown_usd from su",
        "wf_contiguous": f"{of(keyed("symbol || '|' || fold", folds))} select split_part(symbol, '|', 1) as symbol, cast(split_part(symbol, '|', 2) as int) as fold, count(*) as trades, round(sum({net}), 4) as total from tr group by 1, 2",
        "wf_sweep": f"{of(keyed("symbol || '|' || run_id", knobs))} select split_part(symbol, '|', 2) as run_id, count(*) as trades, round(sum({net}), 4) as total from tr group by 1",
        "wf_rolling": f"with {B}, sp as (select symbol, min(timestamp_utc) as a, max(timestamp_utc) as z from b group by 1 having max(timestamp_utc) > min(timestamp_utc) + interval 2 days), pl as (select symbol, a, unnest(range(0, cast(floor((epoch_us(z) - epoch_us(a) - 172800000000) / 86400000000) as bigint) + 1)) as fold from sp), w as (select symbol, cast(fold as int) as fold, a + to_days(cast(fold as int)) as s, a + to_days(cast(fold as int) + 2) as t, a + to_days(cast(fold as int) + 3) as e from pl), k as (select b.symbol, w.fold, b.timestamp_utc < w.t as train, row_number() over (partition by b.symbol, w.fold, b.timestamp_utc < w.t order by b.timestamp_utc) as i from b join w on b.symbol = w.symbol and b.timestamp_utc >= w.s and b.timestamp_utc < w.e), g as (select symbol, fold, train, count(*) as bars from k where train or i > 5 group by all), o as (select symbol, fold from g group by 1, 2 having coalesce(sum(bars) filter (train), 0) >= 100 and coalesce(sum(bars) filter (not train), 0) >= 10) select g.* from g join o using (symbol, fold)",
        "feat_base_v2": FEAT_V2,
        "str_templates": STR_TEMPLATES,
        "reg_leaderboard": f"{runs}, {_summary('run_id')} select run_id, round(tot / nullif(span, 0) * 252 / nullif(abs(dd), 0), 5) as calmar, round(sharpe, 5) as sharpe from su order by tot / nullif(span, 0) * 252 / nullif(abs(dd), 0) desc nulls last, run_id limit 10",
        "wf_fold_bounds": f"with {B}, n as (select symbol, timestamp_utc, row_number() over (partition by symbol order by timestamp_utc) - 1 as i, count(*) over (partition by symbol) as t from b), s as (select *, (t - 90) // 4 as sz from n where t - 90 >= 40), f as (select *, case when i < sz then 0 when i >= (sz + 30) + 10 and i < (sz + 30) + 10 + sz then 1 when i >= 2 * (sz + 30) + 10 and i < 2 * (sz + 30) + 10 + sz then 2 when i >= 3 * (sz + 30) + 10 then 3 end as fold from s) select symbol, cast(fold as int) as fold, count(*) as bars, min(timestamp_utc) as first_ts from f where fold is not null group by 1, 2",
        "wf_positive_folds": f"{runs}, f as (select run_id, weekofyear(exit_ts at time zone 'UTC') as wk, sum(net_pnl_usd) as v from d group by 1, 2), g as (select run_id, count(*) as n, count(*) filter (v > 0) as k from f group by 1) select run_id, n, k, round(list_sum(list_transform(range(k, n + 1), lambda i: factorial(cast(n as int)) / (factorial(cast(i as int)) * factorial(cast(n - i as int))))) / pow(2, n), 8) as p_value from g",
        "ctx_session_labels": f"with {B}, h as (select symbol, hour(timestamp_utc at time zone 'America/New_York') as h from b) select symbol, case when h >= 18 or h < 3 then 'Asia' when h < 8 then 'London' when h < 9 then 'NY pre-open' when h < 16 then 'NY RTH' when h < 17 then 'NY close' else 'Overnight' end as session, count(*) as n from h group by 1, 2",
        "ctx_regime_tags": f"""{_ADX}, tr as (select symbol, timestamp_utc, greatest(high - low, abs(high - lag(close) over ({S})), abs(low - lag(close) over ({S}))) as v, timeframe from b), fr as (select symbol, timestamp_utc, v, list(v) over {_frame(300)} as f, count(v) over {_frame(300)} as c from tr),
            cx as (select fr.symbol, fr.timestamp_utc, case when c >= 20 and v is not null then len(list_filter(f, lambda e: e < v)) / len(f) end as rk, round(case when w.n > 28 then a.y end, 9) as adx from fr join w on w.symbol = fr.symbol and w.timestamp_utc = fr.timestamp_utc left join a on a.symbol = w.symbol and a.timeframe = w.timeframe and a.k = w.seen),
            {T.replace("d as (", "dt as (").replace("t as (select *, abs(entry", "tt as (select *, abs(entry").replace("from t)", "from tt)")}, cl as (select trade_id, min(upper(trim(contract))) as code from trades group by 1), ev as (select unnest([{", ".join(f"date '{x}'" for x in EVENT_DAYS)}]) as event_date),
            tx as (select dt.trade_id, net_pnl_usd, entry_ts, cl.code, cast(entry_ts at time zone 'America/New_York' as date) as day from dt join cl using (trade_id) where entry_ts is not null),
            nb as (select * from (select tx.trade_id, rk, adx, row_number() over (partition by tx.trade_id order by abs(epoch_us(cx.timestamp_utc) - epoch_us(tx.entry_ts)), cx.timestamp_utc) as rn from tx join cx on cx.symbol = tx.code and cx.timestamp_utc between tx.entry_ts - interval 10 minutes and tx.entry_ts + interval 10 minutes) where rn = 1),
            ge as (select trade_id, min(abs(datediff('day', day, event_date))) as gap from tx, ev group by 1)
            select case when rk <= 0.33 then 'vol_low' when rk <= 0.66 then 'vol_mid' when rk is not null then 'vol_high' else 'vol_unknown' end as vol_regime, case when adx <= 20 then 'trend_weak' when adx <= 40 then 'trend_mid' when adx is not null then 'trend_strong' else 'trend_unknown' end as trend_regime,
                case when gap = 0 then 'event_day' when gap <= 1 then 'event_1d' when gap <= 5 then 'event_week' else 'event_far' end as event_regime, cast((day(day) - 1) // 7 + 1 as bigint) as week_of_month, count(*) as n, round(sum(net_pnl_usd), 4) as total from tx left join nb using (trade_id) left join ge using (trade_id) group by 1, 2, 3, 4""",
        "rs_hash_bootstrap": f"{runs}, i as (select run_id, net_pnl_usd, row_number() over (partition by run_id order by {O}) - 1 as i, count(*) over (partition by run_id) as m from d), s as (select run_id, m, i, s as sample from i cross join range(0, 1000) q(s)), k as (select *, ((1103515245::bigint * (sample * m + i + 42) + 12345) % 2147483648) % m as pick from s) select k.run_id, cast(k.sample as int) as sample, round(avg(i.net_pnl_usd), 8) as mean from k join i on k.run_id = i.run_id and k.pick = i.i group by 1, 2",
        "stat_dfa": f"""with {B}, y as (select symbol, timestamp_utc, close - open as x, row_number() over (partition by symbol order by timestamp_utc) - 1 as i, count(*) over (partition by symbol) as n, avg(close - open) over (partition by symbol) as m from b), z as (select symbol, i, n, sum(x - m) over (partition by symbol order by timestamp_utc rows unbounded preceding) as z from y),
            f as (select symbol, z, w, i // w as seg, cast(i % w as double) as t from (select *, unnest([16, 32, 64, 128, 256, 512]) as w from z) where w <= n // 2 and (i // w + 1) * w <= n), s as (select symbol, w, seg, regr_syy(z, t) - regr_sxy(z, t) * regr_sxy(z, t) / regr_sxx(z, t) as ss from f group by 1, 2, 3),
            g as (select symbol, w, sqrt(avg(greatest(ss, 0) / w)) as f from s group by 1, 2), e as (select symbol, regr_slope(ln(f), ln(w)) as h, count(*) as windows from g where f > 0 group by 1)
            select symbol, round(h, 5) as exponent, windows, case when h is null then 'INSUFFICIENT_DATA' when h < 0.4 then 'MEAN_REVERTING (strong)' when h < 0.45 then 'MEAN_REVERTING (weak)' when h <= 0.55 then 'RANDOM_WALK' when h < 0.6 then 'TRENDING (weak)' else 'TRENDING (strong)' end as label from e""",
        "stat_half_life": f"with {B}, l as (select symbol, lag(close) over (partition by symbol order by timestamp_utc) as p, close - lag(close) over (partition by symbol order by timestamp_utc) as d from b), m as (select symbol, d - avg(d) filter (p is not null) over (partition by symbol) as y, p - avg(p) over (partition by symbol) as x from l where p is not null), g as (select symbol, count(*) as n, sum(x * y) / sum(x * x) as beta, pow(sum(x * y), 2) / (sum(x * x) * sum(y * y)) as r2 from m group by 1), h as (select *, case when beta < -1e-10 then ln(2) / -beta end as hl from g) select symbol, n, round(beta, 4) as beta, round(r2, 4) as r_squared, round(hl, 4) as half_life, case when abs(beta) < 1e-10 then 'RANDOM_WALK' when beta >= 0 then 'TRENDING' else 'MEAN_REVERTING' end as kind, case when hl is null then 'TRENDING' when hl < 5 then 'TOO_FAST' when hl > 60 then 'TOO_SLOW' else 'TRADEABLE' end as label from h",
        "reg_trial_tiers": "with t as (select strategy_id, cast(exported_at at time zone 'UTC' as date) as ts, count(*) as n from trades group by 1, 2) select case when date '2024-10-01' - ts <= 180 then 'hot' when date '2024-10-01' - ts <= 730 then 'warm' else 'cold' end as tier, strftime(ts, '%Y-%m') as archive_month, cast(sum(n) as bigint) as n from t group by 1, 2",
        "reg_keep_runs": "with t as (select strategy_id, trade_id, case when quantity = 3 then 'validation' else 'exploration' end as mode, max(exported_at) as ts from trades group by all), r as (select *, row_number() over (partition by strategy_id order by ts desc, trade_id) as r from t) select strategy_id, count(*) as to_delete from r where r > 5 and mode <> 'validation' group by 1",
        "reg_manifests": "with f as (select file_id, coalesce(try_cast(manifest->>'row_count' as bigint), try_cast(manifest->>'n_rows' as bigint), try_cast(manifest->>'rows' as bigint), try_cast(manifest->>'record_count' as bigint)) as declared from raw_files), n as (select file_id, count(*) as c from raw_records group by 1) select f.file_id, declared, coalesce(c, 0) as actual from f left join n on f.file_id = n.file_id where declared is distinct from coalesce(c, 0)",
        "reg_lineage": "with p as (select path, received_at, lag(path) over (partition by contract order by file_seq) as source, lag(received_at) over (partition by contract order by file_seq) as sb from raw_files) select path, source, 'newer' as problem from p where sb > received_at",
        "src_normalise_payload": "with p as (select record_id, try_cast(payload->>'Open' as double) as open, try_cast(payload->>'High' as double) as high, try_cast(payload->>'Low' as double) as low, try_cast(payload->>'Close' as double) as close, coalesce(cast(trunc(try_cast(payload->>'TotalVolume' as double)) as bigint), cast(trunc(try_cast(payload->>'Volume' as double)) as bigint)) as volume from raw_records) select *, open is not null and high is not null and low is not null and close is not null and volume is not null as valid from p",
        "stream_resample_15m": f"with {B} {_ohlc(15)} from b group by 1, 2",
        "src_fetch_windows": "select s as first, least(s + 30 * 86400, 1735603200) as last from (select unnest(range(1704067200, 1735603200 + 1, 30 * 86400 + 1)) as s)",
    }
