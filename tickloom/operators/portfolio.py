"""Several runs together: aligned days, correlation, sizing, attribution, capital and Kelly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.nulls import ratio
from tickloom.operators.metrics import YEAR_DAYS


def _corr(x: str, y: str, over=None):
    """Pearson correlation, null without spread on either side."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return ratio(at(F.covar_pop(x, y)), at(F.stddev_pop(x)) * at(F.stddev_pop(y)))


def aligned(daily: DataFrame) -> DataFrame:
    """Long (day, run_id, pnl) over every day any run has, zero where a run has none. The grid is days by runs."""
    return daily.select("day").distinct().crossJoin(daily.select("run_id").distinct()).join(daily, ["day", "run_id"], "left").fillna(0.0, ["pnl"])


def combined(daily: DataFrame) -> DataFrame:
    """Portfolio result per day with running equity and drawdown; one row a day, so one window is small."""
    d = daily.groupBy("day").agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy().orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("equity", F.sum("pnl").over(w))
    return d.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") - F.col("peak"))


def correlation(daily: DataFrame, method: str = "pearson") -> DataFrame:
    """(run_a, run_b, corr) of aligned daily results, by moments of a self-join on the day; Spearman over average ranks."""
    d = aligned(daily)
    if method == "spearman":
        w = Window.partitionBy("run_id").orderBy("pnl")
        ties = Window.partitionBy("run_id", "pnl")
        d = d.withColumn("pnl", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)
    a, b = d.select("day", F.col("run_id").alias("run_a"), F.col("pnl").alias("x")), d.select("day", F.col("run_id").alias("run_b"), F.col("pnl").alias("y"))
    return a.join(b, "day").where("run_a < run_b").groupBy("run_a", "run_b").agg(_corr("x", "y").alias("corr"))


def rolling_correlation(daily: DataFrame, run_a: str, run_b: str, n: int = 60) -> DataFrame:
    d = aligned(daily).groupBy("day").agg(F.sum(F.when(F.col("run_id") == run_a, F.col("pnl")).otherwise(0.0)).alias("x"), F.sum(F.when(F.col("run_id") == run_b, F.col("pnl")).otherwise(0.0)).alias("y"))
    w = Window.partitionBy().orderBy("day").rowsBetween(-(n - 1), 0)
    return d.select("day", F.when(F.count("*").over(w) == n, _corr("x", "y", w)).alias("corr"))


def rolling_correlations(daily: DataFrame, n: int = 60) -> DataFrame:
    """(run_a, run_b, day, corr) over the last ``n`` days for every pair of runs."""
    d = aligned(daily)
    a, b = d.select("day", F.col("run_id").alias("run_a"), F.col("pnl").alias("x")), d.select("day", F.col("run_id").alias("run_b"), F.col("pnl").alias("y"))
    w = Window.partitionBy("run_a", "run_b").orderBy("day").rowsBetween(-(n - 1), 0)
    return a.join(b, "day").where("run_a < run_b").select("run_a", "run_b", "day", F.when(F.count("*").over(w) == n, _corr("x", "y", w)).alias("corr"))


def benchmark_correlation(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    return daily.join(benchmark.select("day", F.col("value").alias("b")), "day").groupBy("run_id").agg(_corr("pnl", "b").alias("corr"), F.count("*").alias("days"))


def sized(daily: DataFrame, method: str, lookback: int = 60) -> DataFrame:
    """(day, pnl) of the portfolio under a weighting: equal_weight, vol_target, risk_parity (both inverse volatility) or inverse_dd.

    Weights use days before only; a day on which a run has none falls back to equal weight for that run.
    """
    d = aligned(daily)
    per_day = Window.partitionBy("day")
    d = d.withColumn("__k", F.count("*").over(per_day))
    run = Window.partitionBy("run_id").orderBy("day")
    if method == "equal_weight":
        d = d.withColumn("__w", 1 / F.col("__k"))
    elif method in ("vol_target", "risk_parity"):
        f = run.rowsBetween(-lookback, -1)
        sd = F.when(F.count("pnl").over(f) == lookback, F.stddev_samp("pnl").over(f))
        d = d.withColumn("__i", ratio(F.lit(1.0), sd)).withColumn("__w", F.coalesce(ratio(F.col("__i"), F.sum("__i").over(per_day)), 1 / F.col("__k")))
    elif method == "inverse_dd":
        d = d.withColumn("__c", F.sum("pnl").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        f = run.rowsBetween(-lookback, -1)
        top = F.coalesce(F.when(F.count("__c").over(f) == lookback, F.max("__c").over(f)), F.lit(0.0))
        d = d.withColumn("__i", 1 / (F.abs(F.lag("__c").over(run) - top) + 1))
        d = d.withColumn("__w", F.coalesce(ratio(F.col("__i"), F.sum("__i").over(per_day)), 1 / F.col("__k")))
    else:
        raise ValueError(f"unknown sizing method: {method}")
    return d.groupBy("day").agg(F.sum(F.col("pnl") * F.col("__w")).alias("pnl"))


def compare_sizing(daily: DataFrame, lookback: int = 60) -> DataFrame:
    out = None
    for m in ("equal_weight", "vol_target", "risk_parity", "inverse_dd"):
        c = combined(sized(daily, m, lookback)).agg(F.sum("pnl").alias("final_pnl"), F.max(-F.col("drawdown")).alias("max_dd"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"), F.count("*").alias("n"))
        c = c.select(F.lit(m).alias("method"), "final_pnl", "max_dd", ratio(F.col("final_pnl") / (F.col("n") / YEAR_DAYS), F.col("max_dd")).alias("calmar"), (ratio(F.col("m"), F.col("s")) * F.sqrt(F.lit(float(YEAR_DAYS)))).alias("sharpe"))
        out = c if out is None else out.unionByName(c)
    return out


def drawdown_attribution(daily: DataFrame, least: float = 0.01) -> DataFrame:
    """Portfolio drawdowns of at least ``least`` of the peak, each run's result from the start to the trough and its share of the loss."""
    c = combined(daily)
    w = Window.partitionBy().orderBy("day")
    pct = F.col("drawdown") / F.when(F.col("peak") == 0, 1e-9).otherwise(F.col("peak"))
    c = c.withColumn("dd_pct", pct).withColumn("__below", F.col("dd_pct") < 0).withColumn("__g", F.sum((~F.col("__below")).cast("int")).over(w))
    spells = c.where("__below").groupBy("__g").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.min("dd_pct").alias("max_dd_pct"), F.min_by("day", F.struct("dd_pct", "day")).alias("trough_day")).where(F.abs("max_dd_pct") >= least).drop("__g")
    days = spells.withColumn("day", F.explode(F.sequence("start_day", "trough_day")))
    part = days.join(daily, "day").groupBy("start_day", "trough_day", "end_day", "max_dd_pct", "run_id").agg(F.sum("pnl").alias("loss_usd"))
    total = F.sum("loss_usd").over(Window.partitionBy("start_day"))
    return part.withColumn("total_loss_usd", total).withColumn("share", F.when(F.col("total_loss_usd") < 0, F.col("loss_usd") / F.col("total_loss_usd")).otherwise(0.0))


def capital(trades: DataFrame, keys: list[str], margins: DataFrame, base: float = 100_000.0) -> DataFrame:
    """Return on margin (of the run's first symbol), on peak capital and on the deepest drawdown (null where there was none)."""
    from tickloom.operators.metrics import ORDER, equity

    e = equity(trades, keys).groupBy(*keys).agg(F.min_by("root", F.struct(*ORDER)).alias("symbol"), F.sum("net_pnl_usd").alias("net"), F.max("equity").alias("top"), F.max(-F.col("drawdown")).alias("dd"))
    out = e.join(margins.select("symbol", "margin"), "symbol", "left")
    return out.select(*keys, F.coalesce(ratio(F.col("net"), F.col("margin")), F.lit(0.0)).alias("on_margin"), (F.col("net") / (F.col("top") + base)).alias("on_peak_capital"), F.when(F.col("dd") > 0, F.col("net") / F.col("dd")).alias("on_max_dd"))


def kelly(daily: DataFrame, base: float = 100_000.0, target: float = 0.20) -> DataFrame:
    """Full, half, quarter and drawdown-constrained Kelly fractions of daily returns on fixed capital."""
    d = daily.withColumn("r", F.col("pnl") / base)
    w = Window.partitionBy("run_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("c", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("p", F.max("c").over(w))
    out = d.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.var_samp("r").alias("v"), F.max((F.col("p") - F.col("c")) / F.col("p")).alias("hist_max_dd")).where("n >= 2")
    full = F.when((F.col("v") > 0) & (F.col("m") > 0), F.col("m") / F.col("v")).otherwise(0.0)
    out = out.withColumn("full_kelly", full)
    held = F.when(F.col("hist_max_dd") > 0, F.least(F.col("full_kelly"), target / F.col("hist_max_dd"))).otherwise(F.col("full_kelly"))
    return out.select("run_id", "full_kelly", (F.col("full_kelly") / 2).alias("half_kelly"), (F.col("full_kelly") / 4).alias("quarter_kelly"), held.alias("dd_constrained_kelly"), "hist_max_dd")
