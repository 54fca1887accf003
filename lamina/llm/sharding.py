"""Sharding by rendezvous hashing, by DataFrame expressions only.

Each shard draws a number from a record's key; the record goes to the shard with the lowest
-ln(u) / weight. The draw of a shard doesn't depend on the other shards, so one more shard takes
records only into itself, about its share of them, and a removed one gives up only its own.

A record's key is its doc_id (a null id has the key "-"). Repeated rows share a key and so a
shard, but have slots of their own, in order of the checksum and size of their texts. A null text has size 1
and the checksum of nothing; long texts are read once, for both. Extra columns aren't read, and an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_in_group

SPAN = 1 << 52


def draw(key: Column, shard: Column) -> Column:
    """An integer from 1 to SPAN, by key and shard."""
    digest = F.md5(F.concat_ws("/", key, shard.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among weighted shards 0, 1, ...; ties go to the lower shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard has a weight above 0")
    if len(set(weights)) == 1:  # the highest draw is the lowest -ln(u) / weight
        best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct((-draw(key, s)).alias("cost"), s.alias("s"))))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
        cost = lambda p: (F.lit(math.log(SPAN)) - F.ln(draw(key, p["s"]).cast("double"))) / p["w"]
        best = F.array_min(F.transform(pairs, lambda p: F.struct(cost(p).alias("cost"), p["s"].alias("s"))))
    return best["s"].cast("int")


def shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (0, 1, ... in each shard) and grown_shard (the
    shard under `grown`, by default with one more shard of the first one's weight).

    Slots are numbered by many tasks for each shard; no text is shuffled."""
    text, key = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, grown or [*weights, weights[0]]).alias("grown_shard"),
    )
    if buckets is None:
        buckets = max(16, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = dense_rank_in_group(rows, ["shard"], ["doc_id", "text_crc32", "size"], F.col("doc_id"), "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
