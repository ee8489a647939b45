"""The corpus pipeline: quality rules, near-duplicates, secrets, source weights, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents. Null ids, repeated rows
and further columns are taken as they are, texts of any length whole; an empty table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantspark.llm import decision_list, mixing, packing, secrets, simhash
from quantspark.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned decision list reject. Null texts have no words and go."""
    return decision_list.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id, null ids last."""
    return simhash.keep_one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark. Null texts stay null."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them; null is a source like any other."""
    return mixing.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. A document that the mix took twice is packed twice; null texts are
    empty ones."""
    return packing.pack_digest(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Learned rules, SimHash components and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each returns is written to the shared folder and read again; what the stage before
    it wrote is deleted then, the last table when the driver ends."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{number}-{name}")
        if before:
            scratch.drop(before)
        before = f"{number}-{name}"
    return docs
