"""The queries of this subpackage, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_simhash, op02_quality, op03_linededup, op04_mixing, op05_html, op06_language, op07_toxicity, op08_decontamination, op09_licenses, op10_secrets


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op01_simhash.near_duplicates(_documents(spark, folder))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return op02_quality.retained(_documents(spark, folder), _table(spark, folder, "labels"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return op08_decontamination.contaminated(_documents(spark, folder), _table(spark, folder, "benchmark"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return op04_mixing.mixed(_documents(spark, folder))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op03_linededup.deduplicated(_documents(spark, folder))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return op06_language.identified(_documents(spark, folder))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return op09_licenses.scanned(_documents(spark, folder))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return op10_secrets.secrets(_documents(spark, folder), _table(spark, folder, "labels"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return op07_toxicity.toxic(_documents(spark, folder), _table(spark, folder, "labels"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return op05_html.extracted(_table(spark, folder, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_rules, op8_decontamination, op4_mixing, op3_line_dedup, op6_language_id, op9_license_scan, op10_secret_scan, op7_toxicity, op5_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": op03_linededup.ORACLE_SQL.format(docs="documents"), "op4_mixing": op04_mixing.ORACLE_SQL.format(docs="documents"), "op9_license_scan": op09_licenses.ORACLE_SQL.replace("{docs}", "documents")}
