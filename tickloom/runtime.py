"""Session set-up, table access and durable checkpoints shared by all operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC and make sure a checkpoint folder is known.

    The folder is the one the cluster names in ``spark.checkpoint.dir`` (shared by all executors). Only where that is
    unset, as in local tests, a folder of this machine is used.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Python workers get the functions of this package by value: it need not be installed on them.
    cloudpickle.register_pickle_by_value(sys.modules["tickloom"])
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tickloom-"))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a checkpoint that outlives executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one use below the checkpoint folder, which all executors share."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def barrier(df: DataFrame) -> DataFrame:
    """The same rows and columns, behind a generator.

    Catalyst moves predicates below projections by writing the projected expressions into them, which for columns built
    upon each other grows exponentially. It does not move them below a generator's output, and the generator stays
    within whole-stage code generation.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
