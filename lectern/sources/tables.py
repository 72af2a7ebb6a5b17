"""Tables written between the steps of a query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of its own only where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-lectern-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table that is worked out once: a checkpoint in the folder of spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a folder of its own is taken.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out anew if it has fewer tasks than the cluster has cores, as one small file of one row group has.

    A table of more files or row groups than cores is left as it is, so nothing large is ever shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
