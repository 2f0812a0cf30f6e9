"""Exact deduplication over an extendible-hash index on shared files.

The 64-bit hash of the normalised text addresses a directory of 2**depth cells; cells that share a bucket share its range
of the index files. A bucket with more than ``capacity`` hashes is split on its next bit, and the directory doubles when a
split needs a bit it doesn't have. Whether a bucket splits depends on the hashes alone, so the directory is derived from
counts by hash prefix, level by level, as a table in the shared folder. It has at most 2**MOST_LEVELS cells, which hashes
of distinct texts don't need below 10**11 records; a bucket that is overfull there stays whole and right.

Owner tasks take contiguous ranges of (bucket, hash). Hashes that occur once are chains of one. Where a hash repeats, the
normalised texts themselves go to its owner, which compares them byte by byte, finds the row that stays and the size of
each group of equal texts, and chains the groups of one hash in the order of their bytes. Copies are combined in each task
before anything moves and again under a few salts, so a text that fills a third of the table costs its owner SALTS records,
and texts that don't repeat never move.

Rows find their bucket by the directory and their place in the chain of their hash by length and SHA-256. Frequent records go by broadcast (at most HOT_RECORDS
records can have 1/HOT_RECORDS of all rows each); all others by a shuffled join in which no key can have more rows.

Defined cases: NULL counts as the empty text; of equal texts the row with the smallest doc_id stays (a NULL doc_id only if
all are NULL), and of rows that share that doc_id, too, exactly one; an empty table gives an empty result; extra columns
are ignored by ``group_copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, by_ids, semi_counted, spool

CAPACITY = 8_192
HOT_RECORDS = 2_000
#: Records in which a text reaches its owner, at most.
SALTS = 32
#: Levels counted at first beyond those that even buckets would need; more are added while a bucket is overfull.
SPARE_LEVELS = 4
MOST_LEVELS = 26
RECORD = ["bucket", "hash", "n_bytes", "sha"]


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, hash, n_bytes, sha) of every row; ``row`` tells equal rows apart once it is written."""
    text = normalise(F.col("text"))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"))


def prefix(hash_: Column, depth: int) -> Column:
    """The top ``depth`` bits of the hash."""
    return F.shiftrightunsigned(hash_, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(hashes: DataFrame, capacity: int = CAPACITY, most: int = MOST_LEVELS) -> tuple[int, DataFrame]:
    """Depth and cells (cell, bucket) of the directory of distinct ``hashes`` (hash); a bucket's number is its first cell.

    A prefix is a bucket if its hashes fit and those of the prefix that is one bit shorter don't."""
    levels = min(most, max(0, math.ceil(math.log2(max(1, hashes.count()) / capacity))) + SPARE_LEVELS)
    while True:
        fine = hashes.groupBy(prefix(F.col("hash"), levels).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        every = fine.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "p", "n")
        counts = spool(every.groupBy("level", F.expr(f"shiftright(p, {levels} - level)").alias("q")).agg(F.sum("n").alias("n")), "prefixes")
        if levels >= most or counts.where((F.col("level") == levels) & (F.col("n") > capacity)).isEmpty():
            break
        levels = min(most, levels + SPARE_LEVELS)
    above = counts.where(F.col("n") > capacity).select((F.col("level") + 1).alias("level"), F.col("q").alias("parent"))
    fits = counts.where((F.col("n") <= capacity) | (F.col("level") == levels)).withColumn("parent", F.shiftright("q", 1))
    buckets = spool(fits.where("level = 0").select("level", "q").unionByName(fits.where("level > 0").join(above, ["level", "parent"]).select("level", "q")), "buckets")
    depth = buckets.agg(F.max("level")).first()[0] or 0
    first = F.expr(f"shiftleft(q, {depth} - level)")
    cells = buckets.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - level)") - 1)).alias("cell"), first.alias("bucket"))
    return depth, spool(cells, "directory")


def addressed(rows: DataFrame, depth: int, directory: DataFrame) -> DataFrame:
    """``rows`` (hash, ...) with the bucket that the directory names."""
    return by_ids(rows.withColumn("cell", prefix(F.col("hash"), depth)), directory, "cell", "inner").drop("cell")


def combined(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(hash, text, keep_id, n) of the texts whose hash repeats: copies that lie in one task are one record, and those of a
    text that is everywhere meet in SALTS records before they go to an owner."""
    texts = docs.select("doc_id", normalise(F.col("text")).alias("text")).withColumn("hash", F.xxhash64("text"))
    same = semi_counted(texts, repeated, ["hash"], "rows").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return same.groupBy("hash", "text", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).drop("salt")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame, DataFrame]:
    """Depth and directory, and the index (bucket, hash, chain, n_bytes, sha, keep_id, group_size) read from shared files.

    Each owner task has a range of (bucket, hash). It compares the texts of a hash byte by byte: equal ones become one
    record, which gets the row that stays and the size of the group, and the records of one hash are its chain, in the
    order of their bytes. A hash that occurs once is a chain of one and needs no text."""
    met = spool(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("keep_id"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha")), "met")
    depth, directory = build_directory(met.select("hash"), capacity)
    once = met.where("rows = 1").select("hash", F.lit(None).cast("string").alias("text"), "keep_id", F.col("rows").alias("n"), "n_bytes", "sha")
    again = combined(docs, met.where("rows > 1").select("hash", "rows")).withColumns({"n_bytes": F.lit(None).cast("int"), "sha": F.lit(None).cast("binary")})
    owners = min(2_000, max(1, directory.select("bucket").distinct().count()))
    owned = addressed(once.unionByName(again), depth, directory).repartitionByRange(owners, "bucket", "hash")
    same = owned.groupBy("bucket", "hash", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"))
    chain = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("text"))
    known = same.select("bucket", "hash", chain.alias("chain"), F.coalesce("n_bytes", F.octet_length("text")).alias("n_bytes"), F.coalesce("sha", F.unhex(F.sha2("text", 256))).alias("sha"), "keep_id", "group_size")
    return depth, directory, spool(known, "index")


def group_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    rows = spool(fingerprints(docs), "fingerprints")
    depth, directory, index = build_index(docs, rows, capacity)
    rows = addressed(rows, depth, directory)
    share = max(2, index.agg(F.sum("group_size")).first()[0] or 0) / HOT_RECORDS
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    hot = index.where(F.col("group_size") >= share)  # at most HOT_RECORDS rows
    often = rows.join(F.broadcast(hot), RECORD)
    first = often.where(stays).groupBy(*RECORD).agg(F.min("row").alias("first"))
    often = often.join(F.broadcast(first), RECORD).withColumn("kept", F.col("row") == F.col("first")).drop("first")
    others = rows.join(F.broadcast(hot.select(*RECORD)), RECORD, "left_anti").join(index.where(F.col("group_size") < share), RECORD)
    order = Window.partitionBy("bucket", "hash", "chain").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    others = others.withColumn("kept", F.row_number().over(order) == 1)
    return often.unionByName(others.select(*often.columns)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
