"""The corpus operators over their whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantspark.llm import conversations, decision_list, elkan, licenses, mixing, ngram_lm, packing, pivots, rule_ensemble, secrets, sharding, simhash, url_rules
from quantspark.llm.sql import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"))


def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_corpus(table(spark, sf_dir, "documents"))[0]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.labelled_pages(pages, table(spark, sf_dir, "labels")))


def op4_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op10_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster_digest(table(spark, sf_dir, "embeddings")).drop("calculated")


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classifier_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sum_of_squares_packing,
        op2_elias_fano_lm,
        op3_url_rules,
        op4_pivot_dedup,
        op5_quality_rules,
        op6_secret_scan,
        op7_source_mix,
        op8_simhash_dedup,
        op9_license_scan,
        op10_label_shards,
        op11_elkan_clusters,
        op12_rule_ensemble,
        op13_conversation_repair,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
