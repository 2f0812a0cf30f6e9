"""Helpers shared by the training-data operators: shared-folder spooling and size-checked semi joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only after a count shows that its rows take at most this many bytes in a hash table.
BROADCAST_BYTES = 64 << 20
#: What a row and a value take there, about; strings, binaries, arrays and structs count as WIDE.
ROW_BYTES, VALUE_BYTES, WIDE_BYTES = 16, 8, 40


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where none is set, a local master gets a temporary one, as
    in tests; on a cluster that is an error, as executors wouldn't see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-sylva-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files that every executor
    sees, so a lost executor costs a re-read and not a recomputation. The files go by ``release``, at the latest when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def release(*spools: DataFrame | None) -> None:
    """Delete the files of spooled tables that nothing will read again: not the tables of a plan still to run."""
    for df in spools:
        path = getattr(df, "_spooled", None)
        if path:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def broadcast_rows(df: DataFrame) -> int:
    """How many rows of ``df`` may be broadcast, by the width of its columns."""
    width = ROW_BYTES + sum(VALUE_BYTES if f.dataType.typeName() in ("long", "integer", "double", "boolean", "short", "byte", "float") else WIDE_BYTES for f in df.schema.fields)
    return BROADCAST_BYTES // width


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Join of ``df`` (wide rows) with ``ids`` (a few numbers a row) on ``key``, NULL matching nothing.

    ``ids`` must be cheap to read (a spooled table). It is broadcast when it is counted to fit; beyond that it is an
    ordinary shuffled join with the same result."""
    if ids.count() <= broadcast_rows(ids):
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


#: In a counted join at most so many keys can be hot.
HOT_KEYS = 2_000


def _hot_and_rest(table: DataFrame, count: str) -> tuple[DataFrame, DataFrame]:
    share = (table.agg(F.sum(count)).first()[0] or 0) / HOT_KEYS
    return F.broadcast(table.where(F.col(count) > share)), table.where(F.col(count) <= share)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and knows in column ``count`` how many rows each key
    has. Keys with at least 1/HOT_KEYS of all rows, of which there can't be more than HOT_KEYS, go by broadcast; so in
    the shuffled join no key has more rows than that. A table that is counted to fit goes by broadcast as a whole. Both
    sides are read twice: pass spooled or cheap tables of a few numbers a row."""
    if table.count() <= broadcast_rows(table):
        return rows.join(F.broadcast(table), keys)
    hot, rest = _hot_and_rest(table, count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def semi_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The rows whose key is in ``table``, split like ``join_counted``."""
    if table.count() <= broadcast_rows(table.select(*keys)):
        return rows.join(F.broadcast(table.select(*keys)), keys, "left_semi")
    hot, rest = _hot_and_rest(table, count)
    often = rows.join(hot.select(*keys), keys, "left_semi")
    return often.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest.select(*keys), keys, "left_semi"))


def words_of(text: Column) -> Column:
    """Number of maximal runs of non-white-space characters; NULL counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, longer by underscores where ``df`` has a column of that name in any case: for columns that go again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or 32 MB, so that a Python worker's memory doesn't follow text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
