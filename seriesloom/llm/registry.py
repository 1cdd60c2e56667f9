"""The corpus queries: name -> function of (spark, sf_dir), and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import digest, lexicon, licenses, max_sketches, packing, quality_rules, rule_ensemble, sharding, simhash, substrings, target_sampling, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.round_trip(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketches.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_report(table(spark, sf_dir, "documents"))


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.sampled_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_simhash": op2_simhash,
        "op3_packing": op3_packing,
        "op4_sharding": op4_sharding,
        "op5_warc": op5_warc,
        "op6_bpe": op6_bpe,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_license_scan": op8_license_scan,
        "op9_quality_rules": op9_quality_rules,
        "op10_fingerprints": op10_fingerprints,
        "op11_lexical_search": op11_lexical_search,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_target_sampling": op13_target_sampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_quality_rules": quality_rules.oracle_sql(),
        "op11_lexical_search": max_sketches.oracle_sql(),
        "op12_substring_dedup": substrings.oracle_sql(),
        "op13_target_sampling": target_sampling.oracle_sql(),
    }
