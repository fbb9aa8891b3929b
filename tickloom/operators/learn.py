"""Learned views of trade logs: a winner classifier with purged expanding folds, and clusters with their marks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.metrics import ORDER
from tickloom.operators.ranks import places
from tickloom.runtime import durable


def _stages(features: list[str], trees: int) -> Pipeline:
    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol="label", maxIter=trees, maxDepth=3, seed=42)])


def folds_of(trades: DataFrame, folds: int, purge: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """(fold, train, test): expanding folds in order of exit, ``purge`` trades left out before each test; folds that cannot be learnt are left out."""
    t = places(trades.where("exit_ts is not null"), [], ORDER, F.to_date("exit_ts")).withColumn("__n", F.col("__n") - 1).withColumn("label", (F.col("net_pnl_usd") > 0).cast("double"))
    t = durable(t)
    total = t.count()
    out = []
    for k in range(1, folds + 1):
        start, end = total * k // (folds + 1), total * (k + 1) // (folds + 1)
        train, test = t.where(F.col("__n") < start - purge), t.where((F.col("__n") >= start) & (F.col("__n") < end))
        if train.select("label").distinct().count() == 2:
            out.append((k, train, test))
    return out


def win_probabilities(trades: DataFrame, features: list[str], folds: int = 5, purge: int = 100, trees: int = 20) -> DataFrame:
    """(trade_id, fold, win_prob) out of sample: each fold is scored by boosted trees fitted on all trades before it, less ``purge``."""
    out = None
    for k, train, test in folds_of(trades, folds, purge):
        scored = _stages(features, trees).fit(train).transform(test).select("trade_id", F.lit(k).alias("fold"), vector_to_array("probability")[1].alias("win_prob"))
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else trades.sparkSession.createDataFrame([], "trade_id string, fold int, win_prob double")


def importance(trades: DataFrame, features: list[str], folds: int = 5, purge: int = 100, trees: int = 20, repeats: int = 5) -> DataFrame:
    """(fold, feature, importance): how much accuracy on unseen trades falls if a feature's values change places.

    A row takes the value of the row whose place is a random one of the fold's permutation: an equi-join on places, for every feature and
    repeat in one job. A feature that says nothing has an importance of about zero.
    """
    out = None
    for k, train, test in folds_of(trades, folds, purge):
        model = _stages(features, trees).fit(train)
        base = test.select("label", *features, F.col("__n").alias("__i"))
        tries = base.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        # the j-th row by place meets the j-th by hash: a permutation per repeat
        ranked = tries.withColumns({"__a": F.rank().over(Window.partitionBy("__r").orderBy("__i")), "__b": F.row_number().over(Window.partitionBy("__r").orderBy(F.xxhash64("__i", "__r"), "__i"))})
        other = ranked.select("__r", F.col("__b").alias("__a"), F.struct(*features).alias("__o"))
        both = ranked.join(other, ["__r", "__a"])
        moved = both.withColumn("feature", F.explode(F.array(*map(F.lit, ["", *features]))))
        moved = moved.withColumns({f: F.when(F.col("feature") == f, F.col(f"__o.{f}")).otherwise(F.col(f)) for f in features})
        hit = model.transform(moved).groupBy("feature").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"))
        whole = hit.where("feature = ''").select(F.col("right").alias("base"))
        part = hit.where("feature <> ''").join(F.broadcast(whole.limit(1))).select(F.lit(k).alias("fold"), "feature", (F.col("base") - F.col("right")).alias("importance"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else trades.sparkSession.createDataFrame([], "fold int, feature string, importance double")


def partial_dependence(trades: DataFrame, features: list[str], trees: int = 20, grid: int = 10) -> DataFrame:
    """(feature, value, win_prob): the mean probability of a win with a feature set to each of its quantiles and all else as it is."""
    t = durable(trades.withColumn("label", (F.col("net_pnl_usd") > 0).cast("double")).select("label", *features))
    if t.select("label").distinct().count() < 2:
        return trades.sparkSession.createDataFrame([], "feature string, value double, win_prob double")
    model = _stages(features, trees).fit(t)
    cuts = [i / (grid - 1) for i in range(grid)]
    at = t.agg(*[F.array_distinct(F.percentile_approx(f, cuts, 10_000)).alias(f) for f in features]).first().asDict()
    points = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("value")) for f in features for v in at[f] or []])
    rows = t.withColumn("__p", F.explode(points)).select("*", "__p.feature", "__p.value")
    rows = rows.withColumns({f: F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f)) for f in features})
    return model.transform(rows).groupBy("feature", "value").agg(F.avg(vector_to_array("probability")[1]).alias("win_prob"))


def clusters(trades: DataFrame, features: list[str], k: int = 4) -> DataFrame:
    """Trades with a ``cluster``, by bisecting k-means over imputed and standardised features."""
    filled = [f"{f}__f" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), BisectingKMeans(featuresCol="__x", predictionCol="cluster", k=k, seed=42)]
    return Pipeline(stages=stages).fit(trades).transform(trades).drop("__v", "__x", *filled)


def cluster_marks(clustered: DataFrame, features: list[str], top: int = 3) -> DataFrame:
    """Per cluster its size, result and the features whose mean stands furthest from the rest's, in standard deviations of all."""
    long = clustered.select("cluster", "net_pnl_usd", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e")).select("cluster", "net_pnl_usd", "e.*")
    part = long.groupBy("cluster", "feature").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    whole = long.groupBy("feature").agg(F.count("v").alias("n_all"), F.sum("v").alias("s_all"), F.stddev_pop("v").alias("sd"))
    d = part.join(whole, "feature").withColumn("gap", (F.col("s") / F.nullif(F.col("n"), F.lit(0)) - (F.col("s_all") - F.col("s")) / F.nullif(F.col("n_all") - F.col("n"), F.lit(0))) / F.nullif(F.col("sd"), F.lit(0.0)))
    w = Window.partitionBy("cluster").orderBy(F.abs("gap").desc_nulls_last(), "feature")
    marks = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    size = clustered.groupBy("cluster").agg(F.count("*").alias("trades"), F.avg("net_pnl_usd").alias("mean_pnl"), F.avg((F.col("net_pnl_usd") > 0).cast("double")).alias("win_rate"))
    return marks.select("cluster", "rank", "feature", "gap").join(size, "cluster")
