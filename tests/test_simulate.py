from dataclasses import replace
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, walk
from tickloom.functions import indicators as ind
from tickloom.functions.expressions import Compiler
from tickloom.operators import strategies, walkforward
from tickloom.operators.simulate import Rules, run_bars, simulate

R = Rules(tick_size=1 / 64, point_value=1000.0, slippage_ticks=1.0, commission_per_side=2.0, quantity=1)
NAN = float("nan")


def legs(closes, signals, rules=R, high=0.25, low=0.25, minute=None, flow=None, atr=None):
    c = np.array(closes, dtype=float)
    o = np.r_[c[0], c[:-1]] if len(c) else c
    o = c.copy()
    n = len(c)
    sig, stop, target = np.zeros(n, int), np.full(n, NAN), np.full(n, NAN)
    for i, (s, st, tg) in signals.items():
        sig[i], stop[i], target[i] = s, st, tg
    return run_bars(np.arange(n), o, c + high, c - low, c, np.zeros(n) if flow is None else np.array(flow), sig, stop, target, np.full(n, 600) if minute is None else np.array(minute), np.full(n, NAN) if atr is None else np.array(atr), rules)


def test_target_trade_to_the_cent():
    (t,) = legs([110, 110.5, 111.5, 111, 110], {0: (1, 109.5, 111.25)})
    assert t["exit_reason"] == "target" and t["fill"] == 1 and t["entry_price"] == 110.515625 and t["exit_price"] == 111.25
    assert abs(t["net_pnl_usd"] - ((111.25 - 110.515625) * 1000 - 2 * 1000 / 64 - 4)) < 1e-9


def test_stop_wins_unless_order_flow_speaks():
    kw = dict(closes=[110, 110, 110], signals={0: (1, 109.5, 110.5)}, high=1, low=1)
    assert legs(**kw)[0]["exit_reason"] == "stop"
    assert legs(**kw, rules=replace(R, use_order_flow=True), flow=[0, 0.5, 0])[0]["exit_reason"] == "target"
    assert legs(**kw, rules=replace(R, use_order_flow=True), flow=[0, 0.0, 0])[0]["exit_reason"] == "stop"


def test_end_of_day_time_limit_and_end_of_data():
    a = legs([110, 110, 110, 110], {0: (1, 100, NAN)}, minute=[900, 950, 960, 961])
    assert (a[0]["exit_reason"], a[0]["exit"]) == ("eod", 2) and a[0]["exit_price"] == 110 - 1 / 64
    b = legs([110] * 6, {0: (-1, 120, NAN)}, replace(R, max_holding_bars=2))
    assert (b[0]["exit_reason"], b[0]["exit"]) == ("time_limit", 2) and b[0]["exit_price"] == 110 + 1 / 64
    c = legs([110, 110], {0: (1, 100, NAN)})
    assert (c[0]["exit_reason"], c[0]["exit_price"]) == ("eod", 110)


def test_opposing_signal_reverses_and_missing_stop_does_not_enter():
    t = legs([110, 110, 110, 110, 110], {0: (1, 100, NAN), 2: (-1, 120, NAN)})
    assert [x["exit_reason"] for x in t] == ["signal", "eod"] and t[0]["exit"] == 3 and t[1]["direction"] == "short" and t[1]["fill"] == 3
    t = legs([110, 110, 110, 110], {0: (1, 100, NAN), 1: (-1, NAN, NAN)})
    assert [x["exit_reason"] for x in t] == ["signal"]
    assert legs([110, 110], {0: (1, NAN, NAN)}) == [] and legs([110], {0: (1, 100, NAN)}) == [] and legs([], {}) == []


def test_excursions_include_the_fill_bar():
    (t,) = legs([110, 112, 108, 111], {0: (1, 100, NAN)}, high=1, low=2)
    assert t["mfe_points"] == 113 - t["entry_price"] and t["mae_points"] == t["entry_price"] - 106


def test_scale_in_rules():
    rules = replace(R, scale_in_atr=1.0, max_scale_ins=1, scale_target_atr=0.5)
    t = legs([110, 110, 109.5, 109.5, 112, 112], {0: (1, 100, 115), 1: (1, 100, 115), 2: (1, 100, 115)}, rules, atr=[1.0] * 6)
    assert [x["leg"] for x in t] == [0, 1] and t[0]["exit_price"] == t[1]["exit_price"] and t[0]["mae_points"] - t[1]["mae_points"] == t[0]["entry_price"] - t[1]["entry_price"]
    assert abs(t[0]["exit_price"] - ((t[0]["entry_price"] + t[1]["entry_price"]) / 2 + 0.5)) < 1e-9
    far = legs([110, 110, 105, 105, 105], {0: (1, 100, 115), 1: (1, 100, 115)}, rules, atr=[1.0] * 5)
    assert [x["leg"] for x in far] == [0]


def test_same_bar_needs_a_reason():
    with pytest.raises(ValueError):
        Rules(same_bar=True)
    assert legs([110, 111], {0: (1, 100, NAN)}, replace(R, same_bar=True, same_bar_reason="limit order"))[0]["entry_price"] == 110


def signals(spark, n=300):
    b = ind.bollinger(frame(spark, walk(n, 8)).drop("symbol").withColumnRenamed("contract", "symbol"))
    return strategies.from_rules(b, {"knobs": {"m": 2}, "entry": {"long": {"all": ["close < bb_lower"]}, "short": {"any": ["close > bb_upper", "close > 1e9"]}}, "exits": {"stop": {"long": "close - m", "short": "close + m"}, "target": {"long": "bb_mid", "short": "bb_mid"}}})


def test_spark_runs_equal_the_loop(spark):
    s = signals(spark)
    got = simulate(s, R).orderBy("entry_ts").toPandas()
    p = s.toPandas().sort_values("timestamp_utc").reset_index(drop=True)
    minute = p.timestamp_utc.dt.tz_localize("UTC").dt.tz_convert("America/New_York").dt.hour * 60
    want = run_bars(np.arange(len(p)), *(p[k].to_numpy() for k in ("open", "high", "low", "close")), np.zeros(len(p)), p.signal.to_numpy(), p.stop.to_numpy(dtype=float), p.target.to_numpy(dtype=float), minute.to_numpy(), np.full(len(p), NAN), R)
    assert len(got) == len(want) > 3 and np.allclose(got.net_pnl_usd, [x["net_pnl_usd"] for x in want]) and got.trade_id.is_unique
    assert simulate(s.limit(0), R).count() == 0


def test_variants_run_as_one_job(spark):
    b = ind.bollinger(frame(spark, walk(300, 8)).drop("symbol").withColumnRenamed("contract", "symbol"))
    cfg = lambda k: {"knobs": k, "entry": {"long": {"all": ["close < bb_lower"]}}, "exits": {"stop": {"long": "close - m"}}}
    grid = walkforward.expand({"m": [1.0, 3.0], "z": [1]})
    assert grid == [{"m": 1.0, "z": 1}, {"m": 3.0, "z": 1}]
    t = walkforward.sweep(b, grid, lambda f, k: strategies.from_rules(f, cfg(k)), R).toPandas()
    assert set(t.run_id) == {"v0000", "v0001"}


def test_contiguous_folds_leave_gaps(spark):
    b = frame(spark, walk(500)).drop("symbol").withColumnRenamed("contract", "symbol")
    f = walkforward.contiguous_folds(b, 4, 20, 10).toPandas()
    ids = {k: sorted(g.bar_id - 1) for k, g in f.groupby("fold")}
    size = (500 - 30 * 3) // 4
    assert ids[0] == list(range(size)) and ids[1][0] == size + 30 + 10 and ids[3][-1] == 499
    assert walkforward.contiguous_folds(b.limit(50), 4, 20, 10).count() == 0


def test_rolling_folds_drop_the_embargo(spark):
    b = frame(spark, walk(500)).drop("symbol").withColumnRenamed("contract", "symbol")
    f = walkforward.rolling_folds(b, "200 minutes", "100 minutes", 7).toPandas()
    first = f[f.fold == 0]
    assert first[first.train].bar_id.tolist() == list(range(1, 201)) and first[~first.train].bar_id.min() == 208


@pytest.mark.parametrize("text", ["__import__('os')", "close.x", "close[0]", "close ** 2", "1 < close < 2", "lambda: 1", "f(close)", "shift(close)", "shift(close + 1, 1)", "'a'", "unknown > 1", "close >", "True", "close if 1 else 2"])
def test_unsafe_or_odd_expressions_are_refused(spark, text):
    with pytest.raises(ValueError):
        Compiler(["close"], {"k": 1.0}, ind.series()).column(text)


def test_expression_values(spark):
    df = spark.createDataFrame([("s", "1m", datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=i), x, y) for i, (x, y) in enumerate([(1.0, 0.0), (None, 2.0), (-4.0, 2.0), (0.0, 0.0)])], "symbol string, timeframe string, timestamp_utc timestamp, a double, b double")
    c = Compiler(df.columns, {"a": 99.0, "k": 2.0}, ind.series())
    out = df.select("timestamp_utc", c.column("a / b").alias("q"), c.condition("a != 5").alias("n"), c.condition("a < k and not b > 1").alias("l"), c.column("shift(a, 1)").alias("p"), c.column("shift(a, -1)").alias("f"), c.column("-a + k * 3").alias("m")).orderBy("timestamp_utc").collect()
    assert [r["q"] for r in out] == [float("inf"), None, -2.0, None]
    assert [r["n"] for r in out] == [True] * 4 and [r["l"] for r in out] == [True, False, False, True]
    assert [r["p"] for r in out] == [None, 1.0, None, -4.0] and [r["f"] for r in out] == [None, -4.0, 0.0, None] and out[0]["m"] == 5.0


def test_dispatch_is_exclusive(spark):
    b = frame(spark, walk(30))
    for bad in ({}, {"entry": {"long": {}}, "template": "always-flat"}, {"template": "nowhere"}):
        with pytest.raises(ValueError):
            strategies.dispatch(b, bad)
    assert strategies.dispatch(b, {"template": "always-flat"}).where("signal <> 0").count() == 0
    assert strategies.lint(b, {"template": "always-flat"}) == ["no bar gives a signal"]
    with pytest.raises(ValueError):
        strategies.TEMPLATES["vwap-reversion"](b, {})
    r = spark.range(1).select(strategies.position_size(25_000, 0.01, F.lit(2.0), 50.0).alias("a"), strategies.position_size(25_000, 0.01, F.lit(0.5), 50.0).alias("b"), strategies.position_size(0, 0.01, F.lit(1.0), 50.0).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (2, 10, 0)


def test_a_strategys_own_columns(spark):
    rows = walk(12)
    for i, r in enumerate(rows):
        r[6:10] = [100.0 + i, 100.9 + i, 99.9 + i, 100.5 + i]
    b = frame(spark, rows).drop("symbol").withColumnRenamed("contract", "symbol").withColumns({"signal": F.when(F.col("bar_id").isin(2, 8), 1).otherwise(0), "stop": F.lit(50.0), "target": F.lit(None).cast("double")})
    rules = Rules(tick_size=0.0, slippage_ticks=0.0, commission_per_side=0.0, point_value=1.0, eod_flat=False, max_scale_ins=1)
    got = simulate(b.withColumns({"size": F.when(F.col("bar_id") == 2, 3).otherwise(0), "leave": F.when(F.col("bar_id") == 5, 1).otherwise(0)}), rules).collect()
    # three contracts in at bar 3, out by the rule at bar 6; the signal of size zero is suppressed
    assert [(r["quantity"], r["entry_price"], r["exit_price"], r["exit_reason"], r["net_pnl_usd"]) for r in got] == [(3, 102.0, 105.0, "rule", 9.0)]
    more = b.withColumns({"atr_14": F.lit(1.0), "more": F.when(F.col("bar_id") == 4, 1).otherwise(0), "point_value": F.lit(10.0), "commission_per_side": F.lit(0.5)})
    got = sorted(simulate(more, rules).collect(), key=lambda r: (r["entry_ts"], r["leg"]))
    assert [r["entry_price"] for r in got if r["leg"] == 1] == [104.0] and got[0]["commission_usd"] == 1.0 and got[0]["pnl_usd"] == got[0]["pnl_points"] * 10


def test_sweeps_record_what_fails(spark):
    from tickloom.operators.walkforward import sweep, sweep_id, sweep_record

    grid, failures = [{"a": 1}, {"a": 2}], []

    def broken(f, k):
        raise ValueError("no such knob")

    assert sweep(frame(spark, walk(5)), grid, broken, Rules(), failures).count() == 0
    rec = sweep_record(spark, grid, failures).collect()
    assert [r["status"] for r in rec] == ["failed", "failed"] and rec[0]["error"] == "no such knob" and rec[0]["sweep_id"] == sweep_id(grid) != sweep_id(grid[:1])
    with pytest.raises(ValueError):
        sweep(frame(spark, walk(5)), grid, broken, Rules())
