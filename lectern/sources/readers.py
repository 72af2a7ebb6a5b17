"""Readers of rated corpora, each to (dataset, task_id, content, readability_score); bad rows go to a table of their own.

Schemas are explicit; formats differ, the relation doesn't, so corpora union by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalar import expected_rating

ORDINAL = {"low": 0.0, "normal": 0.5, "medium": 0.5, "high": 1.0}
JSON_ROW = "name string, code_snippet string, score double, item_id string, code string, readability string, dataset string, source_id string, generator_model string"


def ordinal(label: Column) -> Column:
    """low, normal or medium, high as 0, 0.5, 1; anything else null."""
    out = F.lit(None).cast("double")
    for k, v in ORDINAL.items():
        out = F.when(F.lower(label) == k, v).otherwise(out)
    return out


def json_rows(raw: DataFrame, dataset: str) -> DataFrame:
    """Rows of either JSON schema: a name, text and score, or an id made of its parts and a verbal label."""
    task = F.coalesce("name", "item_id", F.concat_ws("__", "dataset", "source_id", "generator_model"))
    return raw.select(F.lit(dataset).alias("dataset"), task.alias("task_id"), F.coalesce("code_snippet", "code").alias("content"), F.coalesce("score", ordinal(F.col("readability"))).alias("readability_score"))


def json_lines(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return json_rows(spark.read.schema(JSON_ROW).json(path), dataset)


def json_array(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """One array of objects whose code has escaped line ends and quotes."""
    raw = spark.read.schema("task_id string, code string, readability_score double").json(path, multiLine=True)
    return raw.select(F.lit(dataset).alias("dataset"), "task_id", unescaped(F.col("code")).alias("content"), "readability_score")


def unescaped(c: Column) -> Column:
    for a, b in (("\\r\\n", "\n"), ("\\n", "\n"), ('\\"', '"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def votes(matrix: DataFrame, rater: str, columns: list[str], item: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """A matrix of raters by items as (item, score, votes, low, high); blank and unreadable cells don't count."""
    long = matrix.select(rater, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([rater], columns, "item", "vote")
    return vote_scores(long.withColumn("item", item(F.col("item"))), "item")


def vote_scores(long: DataFrame, item: str) -> DataFrame:
    """(item, score, votes, low, high) from (item, vote); blank and unreadable votes don't count."""
    v = long.withColumn("vote", F.trim("vote").try_cast("double")).where("vote is not null")
    return v.groupBy(item).agg(F.avg("vote").alias("score"), F.count("*").alias("votes"), F.min("vote").alias("low"), F.max("vote").alias("high"))


def vote_matrix(spark: SparkSession, path: str, items: int, header: bool) -> DataFrame:
    """Votes from a CSV matrix: without a header a rater, a course and the items' columns; with one, SnippetN columns."""
    if header:
        raw = spark.read.csv(path, header=True)
        columns = [c for c in raw.columns if c.lower().startswith("snippet")]
        return votes(raw, raw.columns[0], columns, lambda c: F.regexp_extract(c, r"(\d+)$", 1))
    names = ["rater", "course", *map(str, range(1, items + 1))]
    return votes(spark.read.schema(", ".join(f"`{c}` string" for c in names)).csv(path), "rater", names[2:])


def vote_counts(raw: DataFrame) -> DataFrame:
    """(task_id, readability_score): the readable share of the votes; null without any."""
    total = F.col("readable") + F.col("unreadable")
    return raw.select(F.col("snip_id").alias("task_id"), F.when(total > 0, F.col("readable") / total).alias("readability_score"))


def probabilities(raw: DataFrame, dataset: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, task_id, readability_score) from probability vectors; an id that several paths share gets the path's hash."""
    from pyspark.sql import Window

    many = F.count("*").over(Window.partitionBy("task")) > 1
    task = F.when(many, F.concat("task", F.lit("#"), F.left(F.sha2(F.col("path").cast("binary"), 256), F.lit(12)))).otherwise(F.col("task"))
    return raw.select(F.lit(dataset).alias("dataset"), task.alias("task_id"), expected_rating(F.col("readability")).alias("readability_score"), *carry)


def text_files(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Whole files as items, their names as ids."""
    f = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("task_id"))
    return f.select(F.lit(dataset).alias("dataset"), "task_id", F.col("value").alias("content"), F.lit(None).cast("double").alias("readability_score"))


def scored_texts(scores: DataFrame, texts: DataFrame) -> DataFrame:
    """Scores with their texts; a score without a text is an error, found before anything is returned."""
    lost = scores.join(texts, "task_id", "left_anti")
    if lost.take(1):
        raise ValueError(f"no text for {[r['task_id'] for r in lost.select('task_id').take(5)]}")
    return scores.join(texts, "task_id")


READERS: dict[str, Callable[..., DataFrame]] = {"json_lines": json_lines, "json_array": json_array, "text_files": text_files}


def corpus(spark: SparkSession, parts: list[tuple[str, str, str]]) -> DataFrame:
    """The union of corpora given as (reader, path, dataset)."""
    out = None
    for reader, path, dataset in parts:
        own = READERS[reader](spark, path, dataset)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the others with a reason: no id, no text."""
    reason = F.when(F.col("task_id").isNull() | (F.col("task_id") == ""), "no id").when(F.col("content").isNull(), "no text")
    r = rows.withColumn("reason", reason)
    return r.where("reason is null").drop("reason"), r.where("reason is not null")


ARCHIVE_ROW = "schema_version int, model string, run int, dataset string, task_id string, source_sha256 string, human_readability_score double, llm_readability_score double, explanation string, token_usage struct<input: long>"


def archived_runs(spark: SparkSession, path: str) -> DataFrame:
    """Records of judged items, compressed or not, under their schema; rows without a required field are left out."""
    return spark.read.schema(ARCHIVE_ROW).json(path).where("model is not null and run is not null and dataset is not null and task_id is not null")


def arff(spark: SparkSession, path: str, columns: list[str], prefix: str, label: str) -> DataFrame:
    """The data of a file with comments and a declared header: columns of a prefix as numbers, and the class."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^\\s*(?:[%@].*)?$"))
    parts = F.split("value", ",")
    at = {c: i for i, c in enumerate(columns)}
    numbers = [F.get(parts, F.lit(at[c])).try_cast("double").alias(c) for c in columns if c.startswith(prefix)]
    return lines.select(*numbers, F.trim(F.get(parts, F.lit(at[label]))).alias(label))


def manifest_problems(manifest: DataFrame, modules: list[str]) -> DataFrame:
    """(row's columns, problem): rows of a manifest (path, position, module) that break a rule, once for each."""
    rules = {
        "outside the root": F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").startswith("/"),
        "no file": F.col("path").isNull() | F.col("path").endswith("/"),
        "negative position": F.col("position").isNull() | (F.col("position") < 0),
        "unknown module": F.col("module").isNull() | ~F.col("module").isin(*modules),
    }
    met = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return manifest.select("*", F.explode(met).alias("problem"))


def manifest_corpus(texts: DataFrame, manifest: DataFrame, dataset: str) -> DataFrame:
    """Variants with their texts and where they come from: manifest (variant_id, base_sample_id, local_path, content_sha256)
    joined to texts (path, content); a text whose hash is not the declared one is an error."""
    from lectern.functions.scalar import fingerprint

    j = manifest.join(texts.withColumnRenamed("path", "local_path"), "local_path")
    wrong = j.where(fingerprint(F.col("content")) != F.col("content_sha256"))
    if wrong.take(1):
        raise ValueError(f"texts of {[r['variant_id'] for r in wrong.select('variant_id').take(5)]} are not those that were declared")
    return j.select(F.lit(dataset).alias("dataset"), F.col("variant_id").alias("task_id"), "content", F.lit(None).cast("double").alias("readability_score"), F.struct("base_sample_id", "local_path").alias("provenance"))


def groups(spark: SparkSession, path: str, manifest: DataFrame, key: str) -> DataFrame:
    """(group_id, files, known) of the rows under a folder of groups: how many a manifest (key, known) knows."""
    found = spark.read.parquet(path).select(key, "group_id")
    return found.join(manifest, key, "left").groupBy("group_id").agg(F.count("*").alias("files"), F.count("known").alias("known"))


def layout(names: list[str]) -> str:
    """The reader that a corpus's file names call for."""
    if any(n.endswith((".jsonl", ".jsonl.gz")) for n in names):
        return "json_lines"
    if any(n.endswith(".json") for n in names):
        return "json_array"
    return "text_files"


def load(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A corpus by the reader that its files call for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.getFileStatus(folder).isDirectory() else [folder.getName()]
    return READERS[layout(names)](spark, path, dataset)
