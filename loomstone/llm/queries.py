"""The registered queries of the ten corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import decontamination, html_extract, jaccard_join, language_id, license_scan, oracles, packing, quality_rules, shared, sharding, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(spark, _table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shared.only(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return quality_rules.judge_documents(documents, shared.only(_table(spark, sf_dir, "labels"), "doc_id", "quality"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, _table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaked(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.only(_table(spark, sf_dir, "pages"), "page_id", "url")
    return url_filter.filter_urls(spark, pages, url_filter.RULES, url_filter.BLOCKED_HOSTS).drop("url")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_groups(spark, shared.only(_table(spark, sf_dir, "documents"), "doc_id", "text"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.only(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return html_extract.extract(spark, pages)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shared.only(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return license_scan.scan(documents, ["doc_id"])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(spark, _table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_sharding": op3_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_url_filter": op5_url_filter,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_html_extract": op7_html_extract,
        "op8_license_scan": op8_license_scan,
        "op9_language_id": op9_language_id,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": oracles.sharding_sql(),
        "op5_url_filter": url_filter.oracle_sql(),
        "op6_jaccard_join": oracles.jaccard_sql(),
        "op8_license_scan": oracles.license_sql(),
    }
