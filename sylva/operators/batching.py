"""Size-bounded batches of a work list."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.containment import small
from sylva.sources.tables import running, stored


def batch_ids(specs: DataFrame, max_bytes: int, max_rows: int, shards: int = 64) -> DataFrame:
    """``specs`` (seq, spec) with (shard, batch): in each shard the running byte sum and row number are divided by the
    limits, and a batch is the rows that share both quotients (whose sum names it, as both only rise); so it holds at
    most max_rows rows, and max_bytes plus one row. Shards are contiguous ranges of seq, so order is kept, and each is
    summed in a task of its own: no window runs over the whole list."""
    ends = specs.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    lo, width = ends["lo"] or 0, max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // shards))
    at = specs.withColumn("shard", F.floor((F.col("seq") - lo) / width).cast("int")).withColumn("bytes", F.octet_length("spec") + 1)
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used, rows = F.coalesce(F.sum("bytes").over(before), F.lit(0)), F.row_number().over(Window.partitionBy("shard").orderBy("seq")) - 1
    return at.withColumn("batch", (F.floor(used / max_bytes) + F.floor(rows / max_rows)).cast("int")).drop("bytes")


def pack_batches(specs: DataFrame, max_bytes: int, max_rows: int, shards: int = 64) -> DataFrame:
    """The fewest batches under both limits in each shard: a batch ends where the next row would break a limit; a row
    above the limit is alone. The reset makes the sum sequential, so each shard goes through an Arrow stream in order."""
    sized = batch_ids(specs, max_bytes, max_rows, shards).drop("batch")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, batch, size, rows = None, 0, 0, 0
        for part in batches:
            ids = []
            for s, spec in zip(part["shard"], part["spec"], strict=True):
                n = len(spec.encode()) + 1
                if s != shard:
                    shard, batch, size, rows = s, 0, 0, 0
                elif rows and (size + n > max_bytes or rows >= max_rows):
                    batch, size, rows = batch + 1, 0, 0
                size, rows = size + n, rows + 1
                ids.append(batch)
            yield part.assign(batch=pd.Series(ids, index=part.index, dtype="int32"))

    ordered = sized.repartition("shard").sortWithinPartitions("shard", "seq").select("seq", "spec", "shard")
    return ordered.mapInPandas(pack, "seq long, spec string, shard int, batch int")


def balanced_batches(specs: DataFrame, max_bytes: int, max_rows: int, min_batches: int, shards: int = 64) -> DataFrame:
    """``batch_ids`` with limits lowered so that there are at least ``min_batches`` batches, if the list has enough rows."""
    t = specs.agg(F.sum(F.octet_length("spec") + 1).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, min(min_batches, t["n"] or 1))
    return batch_ids(specs, min(max_bytes, max(1, -(-(t["b"] or 1) // n))), min(max_rows, max(1, -(-(t["n"] or 1) // n))), shards)


def _successors(numbered: DataFrame, max_bytes: int, max_rows: int, n: int, range_rows: int) -> DataFrame:
    """(i, next) of ``numbered`` (i from 0, bytes, upto: running bytes with the row): where the batch that begins at row i
    ends, and the next begins. A batch ends before the first row whose running sum passes the limit; how many rows
    don't is a count in the merged order of running sums and limits."""
    sums = numbered.select(F.col("upto").alias("at"), F.lit(0).alias("kind"), "i", F.lit(1).cast("long").alias("row"))
    limits = numbered.select((F.col("upto") - F.col("bytes") + max_bytes).alias("at"), F.lit(1).alias("kind"), "i", F.lit(0).cast("long").alias("row"))
    merged = running(sums.unionByName(limits), ["at", "kind", "i"], "fit", "row", 2 * n, range_rows)
    ends = merged.where("kind = 1").select("i", F.greatest(F.col("i") + 1, F.least(F.col("fit"), F.col("i") + max_rows)).alias("next"))
    return ends.where(F.col("next") < n)


def fewest_batches(specs: DataFrame, max_bytes: int, max_rows: int, min_batches: int = 1, range_rows: int = 100_000) -> DataFrame:
    """``specs`` (seq: distinct, spec) with batch, numbered from 0: the fewest batches of the whole list in its order under
    both limits; a row above the byte limit is alone. If they are fewer than ``min_batches``, the limits are lowered to an
    even share, so that there are at least as many (of as many rows).

    Where a batch ends depends on where it begins, so the sum is sequential; but the successor of every row is known at
    once, and pointer doubling finds the begins that the first row leads to: a round doubles the known begins and the
    length of the jumps. No task sees more than a range of the list."""
    n = specs.count()
    if not n:
        return specs.withColumn("batch", F.lit(0).cast("long"))
    sized = specs.withColumn("bytes", F.octet_length("spec").cast("long") + 1)
    numbered = running(running(sized, ["seq"], "upto", "bytes", n, range_rows), ["seq"], "i", None, n, range_rows).withColumn("i", F.col("i") - 1)
    numbered = stored(numbered, "batch-rows")
    begins = _begins(numbered, max_bytes, max_rows, n, range_rows)
    if begins.count() < min(min_batches, n):
        total = numbered.agg(F.max("upto")).first()[0]
        begins = _begins(numbered, min(max_bytes, max(1, -(-total // min_batches))), min(max_rows, max(1, n // min_batches)), n, range_rows)
    marked = numbered.join(small(begins.withColumn("begin", F.lit(1).cast("long"))), "i", "left").fillna(0, ["begin"])
    return running(marked, ["i"], "batch", "begin", n, range_rows).select(*specs.columns, (F.col("batch") - 1).alias("batch"))


def _begins(numbered: DataFrame, max_bytes: int, max_rows: int, n: int, range_rows: int) -> DataFrame:
    """(i): the rows at which batches begin, from row 0 on."""
    jumps = stored(_successors(numbered, max_bytes, max_rows, n, range_rows), "jumps")
    begins = stored(numbered.where("i = 0").select("i"), "begins")
    while not jumps.isEmpty():
        begins = stored(begins.unionByName(jumps.join(small(begins), "i", "left_semi").select(F.col("next").alias("i"))), "begins")
        jumps = stored(jumps.join(jumps.select(F.col("i").alias("next"), F.col("next").alias("after")), "next").select("i", F.col("after").alias("next")), "jumps")
    return begins
