"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  `run` writes each
stage's rows to the shared folder and reads them again, so a stage never reaches back further than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import near_copies, packing, quality_rules, rule_ensemble
from seriesloom.llm.shared import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted to the labels, scores at 0.5 or more."""
    return rule_ensemble.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's and source's fences."""
    return quality_rules.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word Jaccard of 0.8 or more.

    The op2 query's fingerprints (four words, 64 bits, 4 of them) miss most of these; the stage's have 256 bits, and
    each link is checked exactly before it unites anything.
    """
    return near_copies.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into training sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("SimHash near-dedup", near_duplicates), ("best-fit packing", pack)]

#: SQL expresses neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = kept if "cut_path" in vars(kept) else cut(kept, "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
