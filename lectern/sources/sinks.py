"""Tables of results: written with what describes them, and loaded under the contract that they were written by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def without(df: DataFrame, prefixes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df without columns of the given names or beginnings."""
    return df.select(*[c for c in df.columns if c not in names and not c.startswith(tuple(prefixes))])


def write_features(features: DataFrame, path: str, order: Sequence[str], meaning: dict[str, str], metadata: dict) -> None:
    """A feature table by dataset (only its own datasets are replaced), its columns in order, with definitions and metadata."""
    spark = features.sparkSession
    features.select("dataset", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(f"{path}/features")
    spark.createDataFrame(list(meaning.items()), "feature string, definition string").write.mode("overwrite").parquet(f"{path}/definitions")
    spark.createDataFrame([(k, str(v)) for k, v in metadata.items()], "key string, value string").withColumn("written", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/metadata")


def definitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/definitions")


def load_features(spark: SparkSession, path: str, columns: Sequence[str], identities: DataFrame) -> DataFrame:
    """The table at path if it has the identities (dataset, task_id, sha), each once with its hash, the columns, and only
    finite or missing values; else an error that names what is wrong."""
    f = spark.read.parquet(f"{path}/features")
    missing = [c for c in columns if c not in f.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    key = ["dataset", "task_id"]
    both = f.groupBy(*key).agg(F.count("*").alias("n"), F.min("sha").alias("sha")).join(identities.withColumnRenamed("sha", "_want"), key, "full_outer")
    infinite = sum((F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)).cast("int") for c in columns), F.lit(0))
    r = both.agg(F.count_if(F.col("n").isNull()).alias("absent"), F.count_if(F.col("_want").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("sha") != F.col("_want")).alias("changed")).first().asDict()
    r["infinite"] = f.agg(F.count_if(infinite > 0)).first()[0]
    if any(r.values()):
        raise ValueError(f"{path} breaks its contract: {r}")
    return f


def write_vectors(vectors: DataFrame, path: str, parameters: dict[str, str]) -> None:
    """Vectors by label, and the parameters that they were made with."""
    vectors.write.mode("overwrite").partitionBy("label").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame(list(parameters.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/parameters")


def write_losses(features: DataFrame | None, failures: DataFrame, path: str) -> None:
    """Measures as a table, failures (doc_id, reason) appended to those of earlier runs."""
    if features is not None:
        features.write.mode("overwrite").parquet(f"{path}/features")
    failures.write.mode("append").json(f"{path}/failures")


def loss_state(spark: SparkSession, path: str, corpus: DataFrame) -> DataFrame:
    """One row: measured rows, failures, and whether every item of the corpus is one or the other."""
    f, bad = spark.read.parquet(f"{path}/features").select("doc_id"), spark.read.schema("doc_id long, reason string").json(f"{path}/failures").select("doc_id").distinct()
    left = corpus.join(f.unionByName(bad), "doc_id", "left_anti").agg(F.count("*").alias("open"))
    return f.agg(F.count("*").alias("rows")).crossJoin(bad.agg(F.count("*").alias("failures"))).crossJoin(left).select("rows", "failures", (F.col("open") == 0).alias("complete"))


def write_results(results: DataFrame, path: str) -> None:
    """Results (dataset, score, error, more) as a JSON object a row, by dataset, and a summary for each dataset."""
    results.write.mode("overwrite").partitionBy("dataset").json(f"{path}/items")
    summary = results.groupBy("dataset").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count("error").alias("errors"))
    summary.write.mode("overwrite").json(f"{path}/summary")


def export_catalog(samples: DataFrame, path: str) -> None:
    """Samples as JSON; labels of controlled ones are left out."""
    samples.withColumn("label", F.when(~F.col("controlled"), F.col("label"))).drop("controlled").write.mode("overwrite").json(path)


def export_snapshot(samples: DataFrame, keys: Sequence[str], features: dict[str, Column], regions: Column, scores: dict[str, Column], path: str) -> None:
    """Samples as JSON with their features and scores as maps, and the regions that their features rest on."""
    pairs = lambda d: F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*d.values()))
    samples.select(*keys, pairs(features).alias("features"), regions.alias("regions"), pairs(scores).alias("scores")).write.mode("overwrite").json(path)


def curve(points: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """(k, a column for each dataset) from (k, dataset, value), with a row of zeros at k = 0 if there is none."""
    wide = points.groupBy("k").pivot("dataset", list(datasets)).agg(F.first("value"))
    origin = wide.sparkSession.createDataFrame([(0, *[0.0] * len(datasets))], "k int, " + ", ".join(f"`{d}` double" for d in datasets))
    return wide.unionByName(origin.join(wide.select("k"), "k", "left_anti"))


def schema_audit(df: DataFrame, name: str, expected: dict[str, str]) -> DataFrame:
    """(table, column, expected, found, state, rows): a table's columns against the types expected of them."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    state = lambda c, t: "missing" if c not in found else "ok" if found[c] == t else "type"
    rows = [(name, c, t, found.get(c, "missing"), state(c, t)) for c, t in expected.items()]
    out = df.sparkSession.createDataFrame(rows, "table string, column string, expected string, found string, state string")
    return out.crossJoin(df.agg(F.count("*").alias("rows")))
