"""The registered queries of the corpus operators: thin digests over the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import ann, decontamination, html_extract, language, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_html_extract": op5_html_extract,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_ngram_join": op8_ngram_join,
    "op9_sharding": op9_sharding,
    "op10_ann": op10_ann,
}

ORACLES: dict[str, str] = {
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
}
