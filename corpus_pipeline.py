"""A training corpus from raw documents, in five stages; each takes what the one before it kept.

Every stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents (doc_id, text,
lang, source, n_chars and any others, whatever their names); the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import personal_data
from lectern.llm.common import keep, text_key
from lectern.llm.mixing import mix
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import pack
from lectern.llm.quality import judge
from lectern.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge(docs).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Rows without a doc_id count as having the smallest. Where several unlike texts of a group share the smallest, that
    with the smallest hash stays; of rows repeated whole one stays.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).where("first")
    kept = kept.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.col("text_hash").alias("_th")).distinct()
    rows = docs.select(*text_key(), F.struct("*").alias("_row"))
    return rows.join(kept.hint("merge"), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kinds; n_chars follows."""
    found = personal_data.find(docs)
    text = personal_data.redacted(F.col("row.text"), F.col("spans"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")), carry=("_row",))
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal), ("mixing", mixing), ("packing", packing)]

#: The minhash, mixing and packing stages can't be written in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
