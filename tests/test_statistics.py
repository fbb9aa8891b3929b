import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import at
from tickloom.functions.special import chi2_sf, expected_best_sharpe, normal_cdf_array
from tickloom.operators import metrics, portfolio, registry, resampling, stationarity

TR = "trade_id string, run_id string, root string, entry_ts timestamp, exit_ts timestamp, net_pnl_usd double, mae_points double, mfe_points double, exit_reason string, slippage_usd double, commission_usd double"


def log(spark, results, run="r"):
    return spark.createDataFrame([(f"{run}{i}", run, "ZZ", at(1440 * i), at(1440 * i + 240), x, 1.0, 2.0, "stop", 2.0, 1.0) for i, x in enumerate(results)], TR)


def test_special_functions():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12 and abs(chi2_sf(31.410432844230918, 20) - 0.05) < 1e-12 and chi2_sf(0, 3) == 1
    assert abs(chi2_sf(0.1, 5) - (1 - 0.00016231661192)) < 1e-8
    assert np.allclose(normal_cdf_array(np.array([0, 1.959963984540054, -3])), [0.5, 0.975, 0.0013498980316301])
    assert expected_best_sharpe(1) == 0 and 1.5 < expected_best_sharpe(10) < 1.6


def test_summary_by_hand(spark):
    x = [100.0, -50.0, -25.0, 0.0, 200.0, -10.0]
    r = metrics.summary(log(spark, x), ["run_id"]).first()
    assert r["total_trades"] == 6 and abs(r["win_rate"] - 2 / 6) < 1e-12 and r["profit_factor"] == 300 / 85 and r["max_consec_losses"] == 3
    assert r["max_drawdown_usd"] == -75 and r["max_drawdown_pct"] == -0.75 and r["drawdown_duration_days"] == 3
    d = np.array(x)
    assert abs(r["sharpe"] - d.mean() / d.std(ddof=1) * math.sqrt(252)) < 1e-9 and abs(r["sortino"] - d.mean() / d[d < 0].std(ddof=1) * math.sqrt(252)) < 1e-9
    assert abs(r["calmar"] - 215 / 5 * 252 / 75) < 1e-9 and abs(r["trades_per_week"] - 6 / (5 / 7)) < 1e-12


def test_summary_edges(spark):
    one = metrics.summary(log(spark, [5.0]), ["run_id"]).first()
    assert one["profit_factor"] is None and one["sharpe"] is None and one["max_drawdown_usd"] == 0 and one["calmar"] is None
    assert metrics.summary(log(spark, [5.0]).limit(0), ["run_id"]).count() == 0
    assert metrics.summary(log(spark, [None, 1.0, -1.0]), ["run_id"]).first()["total_trades"] == 3


def test_drawdowns_and_unrecovered_end(spark):
    d = metrics.drawdowns(log(spark, [10.0, -4.0, 5.0, -8.0, -1.0]), ["run_id"]).orderBy("start_ts").collect()
    assert [(x["depth_usd"], x["points"], x["recovery_ts"] is None) for x in d] == [(4.0, 1, False), (9.0, 2, True)]


def test_equity_over_months_equals_one_window(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200).tolist()
    e = metrics.equity(log(spark, x), ["run_id"]).orderBy("exit_ts").toPandas()
    assert np.allclose(e.equity, np.cumsum(x)) and np.allclose(e.peak, np.maximum.accumulate(np.cumsum(x)))


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    t = spark.createDataFrame(list(enumerate(p)), "test_id int, p double")
    out = metrics.benjamini_hochberg(t, []).orderBy("test_id").collect()
    assert [r["rejected"] for r in out] == [True, True] + [False] * 6
    assert np.allclose([r["adjusted_p"] for r in out], [0.008, 0.032, 0.0672, 0.0672, 0.0672, 0.08, 0.074 * 8 / 7, 0.205])


def test_composite_score(spark):
    r = spark.range(1).select(metrics.composite_score(F.lit(2.0), F.lit(0.2), F.lit(1000)).alias("a"), metrics.composite_score(F.lit(2.0), F.lit(20.0), F.lit(1000)).alias("b"), metrics.composite_score(F.lit(2.0), F.lit(0.2), F.lit(99)).alias("c"), metrics.composite_score(F.lit(2.0), F.lit(1.0), F.lit(1000)).alias("d")).first()
    assert abs(r["a"] - math.log(2) * 0.8 * 2) < 1e-12 and r["a"] == r["b"] and r["c"] is None and r["d"] is None


def test_autocorrelation_and_ljung_box(spark):
    x = np.random.default_rng(1).normal(size=60)
    a = metrics.autocorrelation(log(spark, x.tolist()), ["run_id"], 5)
    got = {r["lag"]: r["acf"] for r in a.collect()}
    y = x - x.mean()
    want = {k: np.mean(y[:-k] * y[k:]) / x.var() for k in range(1, 6)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    q = 60 * 62 * sum(want[k] ** 2 / (60 - k) for k in want)
    r = metrics.ljung_box(a, ["run_id"]).first()
    assert abs(r["q"] - q) < 1e-9 and abs(r["p_value"] - chi2_sf(q, 5)) < 1e-12


def test_bootstrap_repeats_and_brackets(spark):
    t = log(spark, np.random.default_rng(2).normal(1, 2, 80).tolist())
    a = resampling.samples(t, ["run_id"], 200).orderBy("sample").toPandas()
    b = resampling.samples(t.repartition(3), ["run_id"], 200).orderBy("sample").toPandas()
    assert a.equals(b) and len(a) == 200
    i = resampling.intervals(resampling.samples(t, ["run_id"], 200), ["run_id"]).first()
    assert i["expectancy_lo"] < t.agg(F.avg("net_pnl_usd")).first()[0] < i["expectancy_hi"]
    assert resampling.samples(log(spark, [1.0] * 5), ["run_id"], 10).count() == 0
    s = resampling.shuffle_ranks(t, ["run_id"], 100).first()
    assert 0 <= s["rank"] <= 100 and s["median"] <= s["p95"]


def series(kind, n=4000, seed=0):
    e = np.random.default_rng(seed).normal(size=n)
    if kind == "walk":
        return np.cumsum(e)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.9 * x[i - 1] + e[i]
    return x


def test_adf_tells_processes_apart():
    stat, p, _, _ = stationarity.adf(series("ou"))
    assert p < 0.01 and stat < -5
    assert stationarity.adf(series("walk"))[1] > 0.05
    assert stationarity.adf(np.ones(50)) is None and stationarity.adf(np.arange(10.0)) is None
    # the five per cent point of the distribution with a constant is about -2.86
    assert abs(stationarity.adf_p_value(-2.8615) - 0.05) < 1e-3 and abs(stationarity.adf_p_value(-3.4126, "ct") - 0.05) < 1e-3


def test_hurst_and_half_life(spark):
    noise = np.random.default_rng(4).normal(size=8000)
    assert abs(stationarity.dfa(noise)[0] - 0.5) < 0.06 and abs(stationarity.dfa(np.cumsum(noise))[0] - 1.5) < 0.1
    assert 0.45 < stationarity.rescaled_range(noise)[0] < 0.65
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(series("ou"))], "k string, i long, x double")
    h = stationarity.half_life(df, ["k"], ["i"], "x").first()
    assert h["kind"] == "MEAN_REVERTING" and abs(h["half_life"] - math.log(2) / 0.1) < 1.5
    a = stationarity.dfa_relational(df, ["k"], ["i"], "x").first()["exponent"]
    assert abs(a - stationarity.dfa(series("ou"))[0]) < 1e-6
    assert {r["test"] for r in stationarity.tests(df, ["k"], ["i"], "x").collect()} == {"adf", "dfa", "rescaled_range"}


def test_kelly_and_sizing(spark):
    d = spark.createDataFrame([("a", i, 100.0 * (-1) ** i + 30) for i in range(40)] + [("b", i, 10.0) for i in range(0, 40, 2)], "run_id string, i int, pnl double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i"))).drop("i")
    k = {r["run_id"]: r for r in portfolio.kelly(d).collect()}
    r = np.array([100.0 * (-1) ** i + 30 for i in range(40)]) / 1e5
    assert abs(k["a"]["full_kelly"] - r.mean() / r.var(ddof=1)) < 1e-9 and k["b"]["full_kelly"] == 0
    p = portfolio.sized(d, "equal_weight").agg(F.sum("pnl")).first()[0]
    assert abs(p - (40 * 30 + 200) / 2) < 1e-9
    assert portfolio.compare_sizing(d, 5).count() == 4
    with pytest.raises(ValueError):
        portfolio.sized(d, "magic")


def test_positive_folds(spark):
    f = spark.createDataFrame([("a", float(x)) for x in (1, 1, 1, -1)] + [("b", -1.0)] * 3, "run_id string, calmar double")
    p = {r["run_id"]: r["p_value"] for r in registry.positive_folds(f, ["run_id"]).collect()}
    assert abs(p["a"] - 5 / 16) < 1e-12 and abs(p["b"] - 1) < 1e-12


def test_what_the_classifier_rests_on(spark):
    from datetime import timedelta

    from tests.helpers import T0
    from tickloom.operators import learn

    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        x, y = float(rng.normal()), float(rng.normal())
        rows.append((f"t{i}", T0 + timedelta(hours=i), T0 + timedelta(hours=i, minutes=5), 10.0 if x > 0.2 else -10.0, x, y))
    t = spark.createDataFrame(rows, "trade_id string, entry_ts timestamp, exit_ts timestamp, net_pnl_usd double, x double, y double")
    p = {r["trade_id"]: r["win_prob"] for r in learn.win_probabilities(t, ["x", "y"], folds=2, purge=100).collect()}
    assert len(p) == 600 and np.mean([(p[r[0]] > 0.5) == (r[3] > 0) for r in rows if r[0] in p]) > 0.95
    i = {r["feature"]: r["importance"] for r in learn.importance(t, ["x", "y"], folds=1, purge=100, repeats=3).collect()}
    assert i["x"] > 0.3 and abs(i["y"]) < 0.05
    d = sorted((r["value"], r["win_prob"]) for r in learn.partial_dependence(t, ["x", "y"]).collect() if r["feature"] == "x")
    assert d[0][1] < 0.1 and d[-1][1] > 0.9
    assert learn.importance(t.limit(0), ["x"]).count() == 0 and learn.partial_dependence(t.limit(0), ["x"]).count() == 0
