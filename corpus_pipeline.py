"""A corpus pipeline over `documents`: five stages, each one an operator of lamina.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes what a stage returns as Parquet in the shared folder and gives the next
one what it reads back, so that work done survives a lost executor.

  quality_classifier   drops documents that the importance resampling rejects
  quality_rules        drops documents that the current policy of the rule ledger rejects
  near_dedup           keeps the document with the lowest doc_id of each class of near copies
  secret_scan          replaces all secrets found in the texts
  packing              cuts the texts into token pieces and packs them into sequences

Nulls, repeated rows, empty tables and extra columns: as in the operators; extra columns go along
until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import importance, neardup, packing, rules, secrets
from lamina.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.keep(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
#: SQL can't express the trained classifier and the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
