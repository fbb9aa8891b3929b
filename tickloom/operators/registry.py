"""Control-plane queries: manifests and lineage, trials, leaderboards, retention, logs."""

from __future__ import annotations

from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.special import expected_best_sharpe, normal_cdf, sharpe_variance

MANIFEST = """layer string, symbol string, timeframe string, adjustment string, row_count long, date_range struct<start:string,end:string>, sources array<struct<path:string,built_at:string,row_count:long>>,
 parameters map<string,string>, built_at string, code_commit string"""


def stale(manifests: DataFrame) -> DataFrame:
    """Artefacts (path, built_at, sources) with a source that was built later or is not there: (path, source, problem)."""
    s = manifests.select("path", "built_at", F.explode("sources").alias("s")).select("path", "built_at", F.col("s.path").alias("source"))
    b = manifests.select(F.col("path").alias("source"), F.col("built_at").alias("source_built"))
    j = s.join(b, "source", "left")
    problem = F.when(F.col("source_built").isNull(), "missing").when(F.to_timestamp("source_built") > F.to_timestamp("built_at"), "newer")
    return j.withColumn("problem", problem).where("problem is not null").select("path", "source", "problem")


def pinned(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files some manifest cites as a source."""
    cited = manifests.select(F.explode("sources").alias("s")).select(F.col("s.path").alias("path")).distinct()
    return files.join(cited, "path", "left_semi")


def superseded(files: DataFrame, manifests: DataFrame, keys: list[str], latest: str) -> DataFrame:
    """All but the latest file of each key, without those a manifest pins."""
    w = Window.partitionBy(*keys).orderBy(F.col(latest).desc(), "path")
    old = files.withColumn("__r", F.row_number().over(w)).where("__r > 1").drop("__r")
    cited = manifests.select(F.explode("sources").alias("s")).select(F.col("s.path").alias("path")).distinct()
    return old.join(cited, "path", "left_anti")


def keep_runs(runs: DataFrame, keep: int, strategy: str = "strategy_id", when: str = "ts") -> DataFrame:
    """Runs to delete: beyond the last ``keep`` of a strategy, but never the latest or one in validation mode."""
    w = Window.partitionBy(strategy).orderBy(F.col(when).desc(), "run_id")
    return runs.withColumn("__r", F.row_number().over(w)).where((F.col("__r") > F.greatest(F.lit(keep), F.lit(1))) & F.coalesce(F.col("mode") != "validation", F.lit(True))).drop("__r")


def trial_tiers(trials: DataFrame, now: str, hot: int = 180, warm: int = 730) -> DataFrame:
    """Trials by age: hot, warm (to be archived by month) and cold."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date("ts"))
    return trials.withColumn("tier", F.when(age <= hot, "hot").when(age <= warm, "warm").otherwise("cold")).withColumn("archive_month", F.date_format("ts", "yyyy-MM"))


def where_all(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows equal to every key=value as text; a missing value never matches."""
    conds = [F.coalesce(F.col(k).cast("string") == v, F.lit(False)) for k, v in filters.items()]
    return df.where(reduce(lambda a, b: a & b, conds, F.lit(True)))


def leaderboard(trials: DataFrame, filters: dict[str, str], by: str, descending: bool = True, limit: int = 20, tie: str = "run_id") -> DataFrame:
    """Filtered and sorted, missing values last in either direction."""
    c = F.nanvl(F.col(by).cast("double"), F.lit(None).cast("double"))
    return where_all(trials, filters).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie).limit(limit)


def count_trials(trials: DataFrame, strategy: str | None = None, group: str | None = None) -> int:
    cond = F.lit(False)
    if strategy:
        cond = cond | (F.col("strategy_id") == strategy)
    if group:
        cond = cond | (F.col("trial_group") == group)
    return trials.where(cond).count()


def migrate(trials: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Old records to the present fields: missing fields and nulls get their defaults."""
    return trials.withColumns({k: F.coalesce(F.col(k), v) if k in trials.columns else v for k, v in defaults.items()})


def merge(old: DataFrame, new: DataFrame, key: str = "run_id", when: str = "ts") -> DataFrame:
    """The registry after appending ``new``: one record per key, the latest; records of either side may lack fields of the other."""
    both = old.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(when).desc_nulls_last(), F.col("__s").desc())
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__s")


def diff(old: DataFrame, new: DataFrame, fields: list[str], key: str = "run_id") -> DataFrame:
    """(key, change, field): records added and removed, and the fields that changed in those of both."""
    a, b = (d.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(n)) for d, n in ((old, "o"), (new, "n")))
    j = a.join(b, key, "full")
    moved = F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    what = F.when(F.col("o").isNull(), F.array(F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("field"))))
    what = what.when(F.col("n").isNull(), F.array(F.struct(F.lit("removed").alias("change"), F.lit(None).cast("string").alias("field"))))
    what = what.otherwise(F.transform(moved, lambda f: F.struct(F.lit("changed").alias("change"), f.alias("field"))))
    return j.select(key, F.explode(what).alias("w")).select(key, "w.*")


def orphans(trials: DataFrame, sweeps: DataFrame, on: str = "sweep_id") -> DataFrame:
    """Trials of a sweep that is no longer there; a trial without one belongs to none and stays."""
    return trials.where(F.col(on).isNotNull()).join(sweeps.select(on).distinct(), on, "left_anti")


def deflated_sharpe(trials: DataFrame, cohort: str = "cohort_label") -> DataFrame:
    """Per cohort of at least two trials: its best Sharpe and the probability that it beats the best of as many lucky ones."""
    best = trials.where(F.col(cohort).isNotNull() & F.col("sharpe").isNotNull()).groupBy(cohort).agg(F.count("*").alias("trials"), F.max_by(F.struct("sharpe", "n_obs", "skewness", "kurtosis_pearson"), F.struct("sharpe", "run_id")).alias("b")).where("trials >= 2")
    b = best.select(cohort, "trials", "b.sharpe", F.coalesce("b.n_obs", F.lit(252)).alias("n"), F.coalesce("b.skewness", F.lit(0.0)).alias("s"), F.coalesce("b.kurtosis_pearson", F.lit(3.0)).alias("k"))

    @F.pandas_udf("double")
    def bench(n: pd.Series) -> pd.Series:
        return n.map(lambda v: expected_best_sharpe(int(v)))

    v = sharpe_variance(F.col("n"), F.col("sharpe"), F.col("s"), F.col("k"))
    return b.withColumn("benchmark", bench("trials")).withColumn("dsr", normal_cdf((F.col("sharpe") - F.col("benchmark")) / F.sqrt(v)))


def positive_folds(folds: DataFrame, keys: list[str], metric: str = "calmar") -> DataFrame:
    """Folds above zero and the chance of as many or more by coin flips: an exact binomial tail as a sum over a sequence."""
    f = folds.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(metric) > 0).alias("k"))
    choose = "aggregate(sequence(1, cast(i as int)), cast(1 as double), (a, j) -> if(i = 0, a, a * (n - i + j) / j))"
    tail = F.expr(f"aggregate(transform(sequence(k, n), i -> if(i = 0, cast(1 as double), {choose})), cast(0 as double), (a, x) -> a + x) / power(2, n)")
    return f.withColumn("p_value", tail)


def read_logs(events: DataFrame, *, run_id: str | None = None, equal: dict[str, str] | None = None, errors_only: bool = False, since: str | None = None) -> DataFrame:
    """Log events by predicate; those whose time cannot be read are kept whatever ``since`` says."""
    out = events
    if run_id:
        out = out.where(F.coalesce(F.col("run_id") == run_id, F.lit(False)))
    if equal:
        out = where_all(out, equal)
    if errors_only:
        out = out.where(F.lower("level").isin("error", "critical", "exception"))
    if since:
        out = out.where(F.coalesce(F.try_to_timestamp("timestamp") >= F.lit(since).cast("timestamp"), F.lit(True)))
    return out
