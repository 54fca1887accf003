"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import automaton, chat, importance, neardup, packing, rules, secrets, sharding, tokenfile, topk
from .common import staged, table
from .oracles import ORACLES

#: Shards 0 to 15; every fourth one holds twice as much.
WEIGHTS = [1.0, 1.0, 1.0, 2.0] * 4
#: A conversation whose texts hold control strings of the template, besides those of the table.
CONFLICT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(CONFLICT, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(staged(chat.format_conversations(rows), "chat"))


def op4_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), WEIGHTS)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ledger(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_importance_resampling, op2_token_file, op3_chat_round_trip, op4_bagminhash_near_dedup, op5_best_fit_packing,
        op6_secret_scan, op7_rendezvous_shards, op8_bpe_automaton, op9_impact_top_k, op10_rule_ledger,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
