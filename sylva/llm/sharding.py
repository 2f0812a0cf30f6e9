"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from the key alone, ``-ln(u(key, shard)) / weight``, and the least draw wins. A new shard can
only win records for itself, so a growing shard count moves the new shard's share and nothing else.

Only DataFrame functions are used. Slots (0, 1, 2, ... within a shard) come from two small steps instead of one sort of a
whole shard in one task: rows are ranked inside hash buckets of a shard, and a prefix sum over the bucket counts, whose
number is bounded by MAX_CELLS or 16 a shard, gives each bucket's offset.

Defined cases: a NULL key hashes like the empty string; NULL text has size 8 and CRC 0; rows with equal keys go to the
same shard and get slots of their own (ordered by CRC and size; equal rows are interchangeable); an empty table gives an
empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names

LAW = "key"
MAX_CELLS = 32_768
_HEX = 13
_RANGE = float(16**_HEX)


def _draw(key: Column, salt: str) -> Column:
    """A stable 52-bit number of a key string."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, _HEX), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard number of a key column; shards of weight 0 win nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct((-F.log((_draw(key, str(s)) + F.lit(0.5)) / _RANGE) / F.lit(float(w))).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``df`` with shard, and grown_shard for the longer list of weights ``grown`` (else NULL)."""
    return df.withColumns({"shard": shard_of(F.col(key), weights), "grown_shard": shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")})


def add_slots(df: DataFrame, key: str, order: Sequence[str], n_shards: int) -> DataFrame:
    """``df`` (with shard) plus slot: gapless from 0 in each shard, ordered by bucket, key and ``order``."""
    buckets = max(16, MAX_CELLS // max(1, n_shards))
    bucket, ahead_of, rank = free_names(df, "_bucket", "_offset", "_rank")
    df = df.withColumn(bucket, _draw(F.coalesce(F.col(key).cast("string"), F.lit("")), "slot") % buckets)
    ahead = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("rows")).select("shard", bucket, F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias(ahead_of))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key, *order)))
    # at most buckets x n_shards rows, whatever the input
    return ranked.join(F.broadcast(offsets), ["shard", bucket]).withColumn("slot", F.col(ahead_of) + F.col(rank) - 1).drop(bucket, rank, ahead_of)


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; text is read for
    the sizes of the slots' buckets and for the rows, and isn't shuffled."""
    weights = list(weights or [1.0] * n_shards)
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit(LAW).alias("law"),
    )
    placed = assign_shards(sized, "doc_id", weights, [*weights, 1.0])
    return add_slots(placed, "doc_id", ["text_crc32", "size"], n_shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
