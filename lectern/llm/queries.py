"""The queries of this package: thin digests over each operator, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import oracles, personal_data
from lectern.llm.byte_repeats import earlier_passages
from lectern.llm.common import read_table
from lectern.llm.exact_dedup import exact_groups
from lectern.llm.filter_audit import filter_interactions
from lectern.llm.html_text import extract
from lectern.llm.language_id import train_and_identify
from lectern.llm.mixing import mix
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import pack
from lectern.llm.quality import judge
from lectern.llm.resampling import resample
from lectern.llm.top_k import top_k
from lectern.llm.word_repeats import repeated_passages


def tokenizer_path(name: str) -> str:
    """Where the environment keeps the public tokenizers' files, on every executor alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80).drop("text_hash", "first")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_identify(spark, read_table(spark, sf_dir, "documents"), folds=5)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), length=4096, end=1)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"), window=35).drop("spans")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earlier_passages(read_table(spark, sf_dir, "documents"), window=100).drop("spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(read_table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    base = F.sha2(personal_data.joined(of(personal_data.KINDS)).cast("binary"), 256)
    return found.select("row.doc_id", *counts, base.alias("base_sha256"), personal_data.joined(F.col("spans")).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).drop("first_id")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25, buckets=10_000, seed=7, least=20)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_minhash_near_dedup, op3_language_id, op4_mix_sources, op5_exact_top_k, op6_best_fit_packing, op7_substring_dedup, op8_suffix_array_dedup, op9_quality_rules, op10_personal_data, op11_filter_audit, op12_exact_dedup, op13_importance_resampling)}
ORACLE: dict[str, str] = {
    "op5_exact_top_k": oracles.TOP_K,
    "op7_substring_dedup": oracles.WORD_REPEATS,
    "op8_suffix_array_dedup": oracles.BYTE_REPEATS,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op12_exact_dedup": oracles.EXACT_GROUPS,
}
