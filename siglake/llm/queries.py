"""The thin contract queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.llm import decontamination, langid, license_scan, packing, quality, secret_scan, simhash, suffix_dedup, token_counts, url_filter
from siglake.llm.common import own_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda x: x["k"] < 3)

    def count(k: int) -> Column:
        return F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spelled(F.col("secrets")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of its own for each call, so that a run always encodes all distinct texts."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), own_path(spark, "token-store"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents")).drop("used", "gap")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_license_scan, op4_token_counts, op5_simhash, op6_best_fit_packing, op7_url_filter, op8_suffix_dedup, op9_decontamination, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.sql()}
