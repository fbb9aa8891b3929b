"""Folds and sweeps: many backtests as one job keyed by (run, symbol, fold)."""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.ranks import month_of, places
from tickloom.operators.simulate import SCHEMA, Rules, simulate


def contiguous_folds(bars: DataFrame, folds: int, gap: int, embargo: int, keys: list[str] | None = None) -> DataFrame:
    """Adds ``fold`` by row number: (N - (gap + embargo)(F - 1)) // F rows each, the last to the end; rows between folds are dropped."""
    keys = keys or ["symbol"]
    b = places(bars, keys, ["timestamp_utc"], month_of("timestamp_utc"), total="__total").withColumn("__n", F.col("__n") - 1)
    usable = F.col("__total") - (gap + embargo) * (folds - 1)
    b = b.where(usable >= 10 * folds).withColumn("__s", F.floor(usable / folds))
    step = F.col("__s") + gap + embargo
    start = lambda k: k * step + (embargo if k else 0)
    fold = F.lit(None).cast("int")
    for k in range(folds):
        end = F.col("__total") if k == folds - 1 else start(k) + F.col("__s")
        fold = F.when((F.col("__n") >= start(k)) & (F.col("__n") < end), k).otherwise(fold)
    return b.withColumn("fold", fold).where("fold is not null").drop("__n", "__total", "__s")


def rolling_folds(bars: DataFrame, train: str, test: str, embargo: int, keys: list[str] | None = None, least_train: int = 100, least_test: int = 10) -> DataFrame:
    """Rows with (fold, train): calendar windows such as '18 months' and '6 months', ``embargo`` bars dropped from each test start.

    Windows start at each key's first bar and step by ``test``; rows meet their few windows in an equi-join on the key with a range filter.
    """
    keys = keys or ["symbol"]
    span = bars.groupBy(*keys).agg(F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("z"))
    tr, te = F.expr(f"INTERVAL {train}"), F.expr(f"INTERVAL {test}")
    plan = span.where(F.col("z") > F.col("a") + tr).select(*keys, F.posexplode(F.sequence("a", F.col("z") - tr, te)).alias("fold", "train_start"))
    plan = plan.withColumn("test_start", F.col("train_start") + tr).withColumn("test_end", F.col("test_start") + te)
    rows = bars.join(plan, keys).where("timestamp_utc >= train_start and timestamp_utc < test_end").withColumn("train", F.col("timestamp_utc") < F.col("test_start"))
    w = Window.partitionBy(*keys, "fold", "train")
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy("timestamp_utc"))).where(F.col("train") | (F.col("__i") > embargo))
    rows = rows.withColumns({"__t": F.count_if("train").over(Window.partitionBy(*keys, "fold")), "__e": F.count_if(~F.col("train")).over(Window.partitionBy(*keys, "fold"))})
    return rows.where((F.col("__t") >= least_train) & (F.col("__e") >= least_test)).drop("__i", "__t", "__e", "train_start", "test_start", "test_end")


def expand(grid: dict[str, list]) -> list[dict]:
    """The cartesian product of parameter lists, in order of the names."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def sweep_id(variants: list[dict]) -> str:
    """A name of the sweep that depends on its variants alone."""
    return hashlib.sha256(json.dumps(variants, sort_keys=True, default=str).encode()).hexdigest()[:12]


def sweep(features: DataFrame, variants: list[dict], signals, rules: Rules, failures: list[dict] | None = None) -> DataFrame:
    """Trades of every variant in ONE job: ``signals(features, knobs)`` gives a signal frame; run_id names the variant.

    Features are read once (checkpoint them if costly); variants differ by columns only and are simulated as separate groups. A variant whose
    signals cannot be made is recorded in ``failures`` if that is given and left out, else it fails the sweep.
    """
    frames = None
    names = ["symbol", "timestamp_utc", "open", "high", "low", "close", "buy_volume", "sell_volume", "signal", "stop", "target"]
    for i, knobs in enumerate(variants):
        run = f"v{i:04d}"
        try:
            f = signals(features, knobs).select(*names).withColumn("run_id", F.lit(run))
        except (ValueError, AnalysisException) as e:
            if failures is None:
                raise
            failures.append({"run_id": run, "error": str(e).splitlines()[0]})
            continue
        frames = f if frames is None else frames.unionByName(f)
    if frames is None:
        return features.sparkSession.createDataFrame([], SCHEMA)
    return simulate(frames, rules)


def sweep_record(spark: SparkSession, variants: list[dict], failures: list[dict]) -> DataFrame:
    """(sweep_id, run_id, knobs, status, error): one row per variant, whether or not it ran."""
    failed = {f["run_id"]: f["error"] for f in failures}
    rows = [(sweep_id(variants), r := f"v{i:04d}", json.dumps(k, sort_keys=True), "failed" if r in failed else "ok", failed.get(r)) for i, k in enumerate(variants)]
    return spark.createDataFrame(rows, "sweep_id string, run_id string, knobs string, status string, error string")
