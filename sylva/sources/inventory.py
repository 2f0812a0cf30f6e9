"""Inventories of files, and the fingerprint cache."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sylva import schemas
from sylva.functions.paths import path_key
from sylva.operators.guards import refuse_if_any
from sylva.sources.content import local_path
from sylva.sources.walk import walk

_LISTED = {"path": "path", "length": "size", "modificationTime": "mtime"}


def _listing(spark: SparkSession, paths: list[str], recursive: bool, glob: str = "*") -> DataFrame:
    """binaryFile rows without content: the column is pruned, so no file is opened."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").option("pathGlobFilter", glob)
    listed = read.load(paths).select(*[F.col(k).alias(v) for k, v in _LISTED.items()])
    return listed.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _present(spark: SparkSession, paths: list[str], files_only: bool = False) -> list[str]:
    """The paths that exist. What is there but can't be read is an error of the listing, not an absence."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        at = fs.Path(p)
        store = at.getFileSystem(conf)
        if store.exists(at) and not (files_only and not store.getFileStatus(at).isFile()):
            there.append(p)
    return there


def scan_inventory(spark: SparkSession, roots: list[str], policy: str = "unix", excluded: list[str] = (), glob: str | None = None, pruned: DataFrame | None = None) -> DataFrame:
    """Workspace rows of all files below the roots; a root that doesn't exist is zero files. Nothing below a path in
    ``excluded`` or a directory in ``pruned`` (dir_key) is listed, at any depth; ``glob`` restricts file names. A directory
    that can't be listed refuses the inventory. ``sources.walk`` gives directories and totals, too. Trees of 10**7 files and
    more in an object store are better read from an inventory table (``read_inventory``)."""
    if any(local_path(r) is None for r in roots) and not excluded and pruned is None:  # another store, all of it: Spark's own listing
        there = _present(spark, roots)
        listed = _listing(spark, there, True, glob or "*") if there else None
        return empty(spark, schemas.WORKSPACE) if listed is None else listed.select("path", path_key(F.col("path"), policy).alias("path_key"), "size", "mtime", F.lit(False).alias("filtered"))
    out = spark.createDataFrame([(kind, x.rstrip("/")) for x in excluded for kind in ("dir", "file")], "kind string, path string")
    walked = walk(spark, roots, out.withColumn("key", path_key(F.col("path"), policy)), pruned, policy)
    refuse_if_any(walked.errors, "unreadable_directory", F.concat_ws(": ", "path", "error"))
    name = F.element_at(F.split("path", "/"), -1)
    return walked.files if glob is None else walked.files.where(name.rlike(_glob_pattern(glob)))


def _glob_pattern(glob: str) -> str:
    """A file name pattern (``*``, ``?``, ``[...]``) as a regular expression."""
    return "^" + fnmatch.translate(glob).removesuffix(r"\Z").removesuffix(r"\z") + "$"


def scan_single_files(spark: SparkSession, paths: list[str], policy: str = "unix") -> DataFrame:
    """Workspace rows of single files; a missing file or a directory in its place gives no row."""
    there = _present(spark, paths, files_only=True)
    if not there:
        return empty(spark, schemas.WORKSPACE)
    return _listing(spark, there, True).select("path", path_key(F.col("path"), policy).alias("path_key"), "size", "mtime", F.lit(False).alias("filtered"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WORKSPACE).parquet(path)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(time, name) of the complete versions of a cache, oldest first: a directory counts once its _SUCCESS is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    done = [(c.getPath(), fs.Path(c.getPath(), "_SUCCESS")) for c in store.listStatus(root) if c.isDirectory()]
    return sorted((store.getFileStatus(mark).getModificationTime(), p.getName()) for p, mark in done if store.exists(mark))


def load_digest_cache(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(cache, warning): the newest complete version; an unreadable cache is a warning and an empty table."""
    try:
        versions = _versions(spark, path)
        if not versions:
            return empty(spark, schemas.DIGEST_CACHE), f"digest cache not readable, starting empty: no complete version in {path}"
        return spark.read.schema(schemas.DIGEST_CACHE).parquet(f"{path}/{versions[-1][1]}"), None
    except AnalysisException as e:
        return empty(spark, schemas.DIGEST_CACHE), f"digest cache not readable, starting empty: {str(e)[:200]}"


def save_digest_cache(cache: DataFrame, path: str, version: str, dirty: bool = True, keep: int = 2) -> bool:
    """Write a version directory of its own; it is published by its _SUCCESS file, which Spark writes last, so a failed write
    leaves the version before in use. All but the newest ``keep`` complete versions go. Nothing is written if nothing is new."""
    if not dirty:
        return False
    spark = cache.sparkSession
    cache.select("path_key", "size", "mtime", "digest").write.mode("overwrite").parquet(f"{path}/{version}")
    for _, old in _versions(spark, path)[:-keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return True


def merge_digest_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by path: a fresh row replaces the cached one; of several fresh rows the latest mtime stays."""
    both = cache.select("path_key", "size", "mtime", "digest", F.lit(0).alias("new")).unionByName(fresh.select("path_key", "size", "mtime", "digest", F.lit(1).alias("new")))
    best = both.groupBy("path_key").agg(F.max_by(F.struct("size", "mtime", "digest"), F.struct("new", "mtime", "size", "digest")).alias("r"))
    return best.select("path_key", "r.size", "r.mtime", "r.digest")
