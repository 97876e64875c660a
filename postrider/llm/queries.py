"""The registered queries of the training-data operators: thin layers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mailview import table
from . import chat, decontamination, host_rules, mixing, pii, quality, resampling, secrets, simhash, substring_dedup, token_counts, url_filter, vector_codes


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op2_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *count, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["base"])
    of_base = F.transform(base, lambda s: s["kind"])
    count = [(F.size(of_base) - F.size(F.array_remove(of_base, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return pii.find_pii(docs).select("doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontamination.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resampling.resample(docs.select("doc_id", "text"), target.select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.add_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_knn_quality, op2_random_secrets, op3_suffix_trees, op4_tool_call_links, op5_semi_markov_pii, op6_host_rules, op7_url_vocabulary, op8_hierarchical_mix,
        op9_wu_manber, op10_simhash_pivots, op11_importance_resampling, op12_token_counts, op13_partial_distance,
    )
    return {f.__name__: f for f in every}
