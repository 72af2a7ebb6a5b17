"""Shared pieces: tables written between steps, and key columns that survive nulls and repeats."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract of this package: runs of anything but ASCII white space.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-lectern-")
        atexit.register(shutil.rmtree, found[7:], True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*tables: DataFrame) -> None:
    """Remove tables that keep() wrote, once nothing lazy reads them any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """doc_id (null: the smallest long) and a hash of the text: rows that share both are the same document twice."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("_th"),
    ]
