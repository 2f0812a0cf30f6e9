"""The fingerprint cache by increments: what a batch writes and what a lookup reads follows the batch and not the cache.

Entries lie in data directories, one a batch, in buckets by a hash of the path. A list names the live directories of each
bucket, oldest first, and lists are numbered: the newest is the cache. A batch writes its directory, then its list under a
temporary name, and renames it, so a crash at any point leaves the version before, and a half-written directory is in no list.
Buckets with many directories are merged as part of a batch. One writer at a time; readers need no lock, as files that a
list names stay until ``drop_unused`` finds them unused for long enough.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import schemas

#: Buckets of a new cache; directories of a bucket from which on it is merged.
BUCKETS, MOST = 64, 8
_ENTRY = f"{schemas.DIGEST_CACHE}, batch long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, modification time in ms) of what a directory holds; none if it isn't there."""
    store, at = _fs(spark, path)
    return [(c.getPath().getName(), c.getModificationTime()) for c in store.listStatus(at)] if store.exists(at) else []


def _lists(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[:-5]) for name, _ in _names(spark, f"{path}/lists") if name.endswith(".json") and name[:-5].isdigit())


def _read_list(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.option("wholetext", "true").text(f"{path}/lists/{number:010d}.json").collect()))


def _newest(spark: SparkSession, path: str) -> dict:
    """The newest list: number, buckets, batches (names of the last ones published), next (order of the next batch), live
    ((bucket, directory) pairs)."""
    numbers = _lists(spark, path)
    return {"number": numbers[-1], **_read_list(spark, path, numbers[-1])} if numbers else {"number": 0, "buckets": None, "batches": [], "next": 0, "live": []}


def version(spark: SparkSession, path: str) -> int:
    """The number of the newest list, 0 without any."""
    return _newest(spark, path)["number"]


def live_files(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(bucket, directory) of what the newest list names."""
    return [tuple(x) for x in _newest(spark, path)["live"]]


def bucket(path_key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path_key), F.lit(buckets)).cast("int")


def bucket_of(spark: SparkSession, path_key: str, buckets: int) -> int:
    return spark.range(1).select(bucket(F.lit(path_key), buckets)).first()[0]


def _entries(spark: SparkSession, path: str, live: list[tuple[int, str]]) -> DataFrame:
    """The newest entry of each path in these parts of the cache."""
    if not live:
        return spark.createDataFrame([], _ENTRY)
    at = [f"{path}/data/{name}/bucket={b}" for b, name in live]
    rows = spark.read.schema(_ENTRY).parquet(*at)
    best = rows.groupBy("path_key").agg(F.max_by(F.struct("size", "mtime", "digest", "batch"), F.struct("batch", "mtime", "size", "digest")).alias("r"))
    return best.select("path_key", "r.*")


def read_cache(spark: SparkSession, path: str, pending: DataFrame | None = None) -> DataFrame:
    """DIGEST_CACHE rows of the newest version. With ``pending`` (path_key), only the buckets of these paths are read, which
    may hold other paths, too."""
    now = _newest(spark, path)
    live = [tuple(x) for x in now["live"]]
    if pending is not None and live:
        asked = {r["b"] for r in pending.select(bucket(F.col("path_key"), now["buckets"]).alias("b")).distinct().collect()}  # the number of buckets at most
        live = [x for x in live if x[0] in asked]
    return _entries(spark, path, live).select("path_key", "size", "mtime", "digest")


def append_cache(fresh: DataFrame, path: str, batch: str, buckets: int = BUCKETS, most: int = MOST) -> bool:
    """Publish ``fresh`` (DIGEST_CACHE) as batch of that name, newer than all before; of several rows of a path the one of
    the latest mtime stays, rows without a path go. A batch that is published already, or empty, changes nothing. Buckets
    that would have more than ``most`` directories are merged with this batch."""
    spark = fresh.sparkSession
    now = _newest(spark, path)
    if batch in now["batches"]:
        return False
    if now["buckets"] not in (None, buckets):
        raise ValueError(f"the cache has {now['buckets']} buckets, not {buckets}")
    order = now["next"]
    last = fresh.where("path_key IS NOT NULL").groupBy("path_key").agg(F.max_by(F.struct("size", "mtime", "digest"), F.struct("mtime", "size", "digest")).alias("r"))
    rows = last.select("path_key", "r.*", F.lit(order).cast("long").alias("batch")).withColumn("bucket", bucket(F.col("path_key"), buckets))
    live = [tuple(x) for x in now["live"]]
    added = _write(rows, path)
    if not added:
        return False
    live += added
    held: dict[int, list[str]] = {}
    for b, name in live:
        held.setdefault(b, []).append(name)
    full = {b for b, names in held.items() if len(names) > most}
    if full:
        old = [x for x in live if x[0] in full]
        live = [x for x in live if x[0] not in full] + _write(_entries(spark, path, old).withColumn("bucket", bucket(F.col("path_key"), buckets)), path)
    _publish(spark, path, now["number"] + 1, {"buckets": buckets, "batches": [*now["batches"], batch][-100:], "next": order + 1, "live": live})
    return True


def _write(rows: DataFrame, path: str) -> list[tuple[int, str]]:
    """Write rows (with bucket) as a data directory; the (bucket, directory) pairs that it has."""
    spark, name = rows.sparkSession, f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:12]}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    return sorted((int(n.split("=")[1]), name) for n, _ in _names(spark, f"{path}/data/{name}") if n.startswith("bucket="))


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    store, final = _fs(spark, f"{path}/lists/{number:010d}.json")
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/.tmp-{uuid.uuid4().hex}")
    out = store.create(temporary, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if store.exists(final) or not store.rename(temporary, final):
        store.delete(temporary, False)
        raise RuntimeError(f"another writer published list {number} of {path}")


def drop_unused(spark: SparkSession, path: str, keep: int = 3, older_than_s: int = 3_600) -> int:
    """Delete all but the newest ``keep`` lists, and data that no list left names, once they are older than any reader and
    writer; the number of data directories deleted."""
    numbers = _lists(spark, path)
    before = time.time() * 1000 - older_than_s * 1000
    ages = dict(_names(spark, f"{path}/lists"))
    for n in numbers[:-keep]:
        if ages[f"{n:010d}.json"] <= before:
            store, at = _fs(spark, f"{path}/lists/{n:010d}.json")
            store.delete(at, False)
    named = {name for n in _lists(spark, path) for _, name in _read_list(spark, path, n)["live"]}
    gone = [name for name, age in _names(spark, f"{path}/data") if name not in named and age <= before]
    for name in gone:
        store, at = _fs(spark, f"{path}/data/{name}")
        store.delete(at, True)
    return len(gone)
