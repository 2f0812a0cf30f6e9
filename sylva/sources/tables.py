"""Tables between the steps of a plan: written where every executor sees them, and numbered without one long task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range that one task sums, about.
RANGE_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local master without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-sylva-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs a re-read; the files go with the
    application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or 32 MB in this session, so that a Python worker's memory doesn't follow the
    table or the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def running(df: DataFrame, order: list, into: str, value: str | None = None, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with column ``into``: the running sum of ``value`` (1 a row if None) up to and with each row in the order.

    The table is cut into ranges of the order, each summed in a task of its own; only the sums of the ranges, one row each,
    meet. The order must tell rows apart. ``rows`` is the number of rows, if it is known."""
    n = df.count() if rows is None else rows
    one = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    ranged = df.withColumn("_one", one).repartitionByRange(max(1, -(-n // range_rows)), *order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_one").alias("_sum"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead")), "offsets")  # one row a range
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_in", F.sum("_one").over(inside)).join(F.broadcast(offsets), "_range")
    return out.withColumn(into, F.col("_ahead") + F.col("_in")).drop("_one", "_range", "_in", "_ahead")
