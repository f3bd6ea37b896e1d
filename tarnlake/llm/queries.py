"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, langid, licenses, near_dedup, packing, quality, suffix_dedup, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.predict(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir).select("doc_id", "text"), carry_text=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.host_rules(_documents(spark, sf_dir).select("doc_id", "source", "text"), carry_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.format_pairs(chat.last_reply_pairs(turns), "conv_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_documents(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), words=4)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_license_scan, op4_quality_rules, op5_chat_format, op6_packing, op7_minhash, op8_suffix_dedup, op9_bpe, op10_language_id)}
ORACLES: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE, "op4_quality_rules": quality.ORACLE, "op5_chat_format": chat.ORACLE}
