"""Bootstrap and shuffling of trade results.

Draws are made per (key, sample) by a hash, so they repeat everywhere and no generator state is shared: element i of a sample
is the trade whose rank is hash(sample, i) mod n. Samples are rows of their own, spread over the cluster; the results of a
key go along as one array, whose length is that of its trade log.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.metrics import ORDER, YEAR_DAYS

METRICS = ["sharpe", "calmar", "win_rate", "expectancy", "profit_factor", "sortino"]


def _measures(x: np.ndarray, days: float) -> np.ndarray:
    """Six measures of each row of per-trade results."""
    with np.errstate(all="ignore"):
        mean, sd = x.mean(axis=1), x.std(axis=1, ddof=1)
        neg = np.where(x < 0, x, np.nan)
        cum = np.cumsum(x, axis=1)
        dd = (np.maximum.accumulate(cum, axis=1) - cum).max(axis=1)
        wins, losses = np.where(x > 0, x, 0).sum(axis=1), -np.where(x <= 0, x, 0).sum(axis=1)
        count = (~np.isnan(neg)).sum(axis=1)
        centre = np.where(count > 0, np.nansum(neg, axis=1) / np.maximum(count, 1), 0.0)
        down = np.where(count >= 2, np.sqrt(np.nansum((neg - centre[:, None]) ** 2, axis=1) / np.maximum(count - 1, 1)), np.nan)
        root = np.sqrt(YEAR_DAYS)
        out = np.column_stack([mean / sd * root, cum[:, -1] / days * YEAR_DAYS / dd, (x > 0).mean(axis=1), mean, wins / losses, mean / down * root])
    out[~np.isfinite(out)] = np.nan
    return out


def _sampler(seed: int, shuffle: bool):
    """The measures of a block of samples at once, each drawn by its own seed."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            keys = names[: names.index("first")]
            schema = pa.schema([(k, pa.string()) for k in keys] + [("sample", pa.int64())] + [(m, pa.float64()) for m in [*METRICS, "max_drawdown"]])
            for i in range(batch.num_rows):
                one = lambda c: batch.column(c)[i]  # noqa: B023, E731
                x = one("pnl").values.to_numpy(zero_copy_only=False)
                numbers = np.arange(one("first").as_py(), one("first").as_py() + one("size").as_py())
                # a long log is drawn a few samples at a time
                step = max(1, 4_000_000 // max(len(x), 1))
                for a in range(0, len(numbers), step):
                    part = numbers[a : a + step]
                    y = np.stack([np.random.default_rng([seed, s]).permutation(x) if shuffle else x[np.random.default_rng([seed, s]).integers(0, len(x), len(x))] for s in part.tolist()])
                    m = _measures(y, max(one("days").as_py(), 1.0))
                    cum = np.cumsum(y, axis=1)
                    cols = [pa.array([one(k).as_py()] * len(part), pa.string()) for k in keys] + [pa.array(part, pa.int64()), *[pa.array(m[:, j], from_pandas=True) for j in range(len(METRICS))], pa.array((np.maximum.accumulate(cum, axis=1) - cum).max(axis=1))]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def samples(trades: DataFrame, keys: list[str], n: int = 1000, seed: int = 42, shuffle: bool = False, least: int = 10, block: int = 250) -> DataFrame:
    """(keys, sample, six measures, max_drawdown) of ``n`` resamples per key with at least ``least`` trades; keys are text.

    A key's log travels once for each block of samples and is drawn from in place.
    """
    logs = trades.where(F.col("net_pnl_usd").isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "net_pnl_usd"))), lambda s: s["net_pnl_usd"]).alias("pnl"), ((F.unix_micros(F.max("exit_ts")) - F.unix_micros(F.min("entry_ts"))) / 86_400_000_000).alias("days"))
    logs = logs.where(F.size("pnl") >= least)
    each = logs.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(block))).alias("first"), "pnl", "days").withColumn("size", F.least(F.lit(block), F.lit(n) - F.col("first"))).repartition(*keys, "first")
    schema = ", ".join([f"{k} string" for k in keys] + ["sample long"] + [f"{m} double" for m in [*METRICS, "max_drawdown"]])
    return each.mapInArrow(_sampler(seed, shuffle), schema)


def intervals(sampled: DataFrame, keys: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    out = []
    for m in METRICS:
        out += [F.percentile(m, F.lit(lo)).alias(f"{m}_lo"), F.percentile(m, F.lit(hi)).alias(f"{m}_hi")]
    return sampled.groupBy(*keys).agg(*out)


def shuffle_ranks(trades: DataFrame, keys: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Where the real deepest drawdown stands among shuffled orders of the same results: mean of weak and strict percentile."""
    real = samples(trades, keys, 1, seed, least=10).select(*keys)
    from tickloom.operators.metrics import equity

    actual = equity(trades, keys).groupBy(*keys).agg(F.max(-F.col("drawdown")).alias("actual"))
    s = samples(trades, keys, n, seed, shuffle=True).join(actual, keys)
    rank = F.avg(F.when(F.col("max_drawdown") < F.col("actual"), 100.0).when(F.col("max_drawdown") == F.col("actual"), 50.0).otherwise(0.0))
    return s.groupBy(*keys).agg(F.first("actual").alias("actual"), F.percentile("max_drawdown", F.lit(0.5)).alias("median"), F.percentile("max_drawdown", F.lit(0.95)).alias("p95"), rank.alias("rank")).join(real, keys, "left_semi")


def _means(seed: int, hashed: bool):
    """Mean of every sample of a block; missing results are left out of it."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            keys = names[: names.index("first")]
            for r in batch.to_pylist():
                x = np.array([np.nan if v is None else v for v in r["pnl"]])
                i, numbers, means = np.arange(len(x), dtype="int64"), range(r["first"], r["first"] + r["size"]), []
                for s in numbers:
                    picks = (1103515245 * (s * len(x) + i + seed) + 12345) % 2147483648 % len(x) if hashed else np.random.default_rng([seed, s]).integers(0, len(x), len(x))
                    y = x[picks]
                    y = y[~np.isnan(y)]
                    means.append(float(y.mean()) if len(y) else None)
                schema = pa.schema([(k, pa.string()) for k in keys] + [("sample", pa.int32()), ("mean", pa.float64())])
                yield pa.RecordBatch.from_pydict({k: [r[k]] * r["size"] for k in keys} | {"sample": list(numbers), "mean": means}, schema=schema)

    return run


def _mean_samples(trades: DataFrame, keys: list[str], n: int, seed: int, hashed: bool, block: int = 250) -> DataFrame:
    """(keys, sample, mean) of ``n`` resamples per key; a key's log travels once for each block of samples."""
    logs = trades.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "net_pnl_usd"))), lambda s: s["net_pnl_usd"]).alias("pnl"))
    each = logs.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(block))).alias("first"), "pnl").withColumn("size", F.least(F.lit(block), F.lit(n) - F.col("first"))).repartition(*keys, "first")
    return each.mapInArrow(_means(seed, hashed), ", ".join([f"{k} string" for k in keys] + ["sample int", "mean double"]))


def hash_bootstrap_means(trades: DataFrame, keys: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap means by integer arithmetic alone, which any SQL engine can repeat: row i of sample s is trade (1103515245 (s n + i + seed) + 12345) mod 2^31 mod n."""
    return _mean_samples(trades, keys, n, seed, True)


def generic_bootstrap(trades: DataFrame, keys: list[str], n: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys, point, lo, hi): the mean result of a key and the interval of its resampled means."""
    point = trades.groupBy(*keys).agg(F.avg("net_pnl_usd").alias("point"))
    a = (1 - ci) / 2
    i = _mean_samples(trades, keys, n, seed, False).groupBy(*keys).agg(F.percentile("mean", F.lit(a)).alias("lo"), F.percentile("mean", F.lit(1 - a)).alias("hi"))
    return point.join(i, keys)
