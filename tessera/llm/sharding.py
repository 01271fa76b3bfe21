"""Sharding by weighted rendezvous hashing, in Spark's own expressions.

Every row draws for each shard a number from the hash of its key and the shard,
``-weight / ln(u)``, and goes to the shard with the largest (the lowest shard
among equals). A further shard takes a row only if its own draw is the largest,
so rows move into new shards alone; removing a shard moves its rows alone.

Defined cases: null keys are one key; equal keys share a shard; equal rows stay
separate rows with slots of their own; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, persist_table


def _draw(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)  # 53 bits: exact as a double
    return -F.lit(float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53)))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key; ``weights[s]`` is the share of shard ``s`` (a weight of 0: never chosen)."""
    best = F.greatest(*[F.struct(_draw(key, s, w).alias("draw"), F.lit(-s).alias("less")) for s, w in enumerate(weights) if w > 0],
                      F.struct(F.lit(-1.0).alias("draw"), F.lit(0).alias("less")))
    return -best["less"]


def sharded(df: DataFrame, key: str, weights: list[float], more: float = 1.0) -> DataFrame:
    """Adds ``shard`` and ``grown_shard``: the shard, and the one if a shard of weight ``more`` is added."""
    return df.withColumn("shard", shard_of(F.col(key), weights)).withColumn("grown_shard", shard_of(F.col(key), [*weights, more]))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = sharded(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law")), "doc_id", [1.0] * shards)
    return numbered(persist_table(rows, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
