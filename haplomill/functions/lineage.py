"""Cutting the lineage of iterated plans, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 1 << 18  # keys that are sent to every task


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. Only where all runs on one machine and none is named, as in
    tests, a local one; on a cluster that would be another folder for each machine, so none is made."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="haplomill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by key over all cores: groups whose rows are few but whose work is long are not put
    together by their size."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is one of `keys`: few keys go to the rows, so that a large table is filtered
    where it is read; many meet them in a shuffle."""
    found = cut(keys.select(key).distinct())
    few = found.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(found) if few else found, key, "left_semi").select(*rows.columns)
