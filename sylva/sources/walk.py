"""A walk over directory trees that never opens what is excluded, level by level.

The directories of a level are a table; tasks list them, and what they hold decides the next level after the excluded
and pruned directories were taken out by a join on keys. So no listing call is made below an excluded directory, wherever
it lies, and the driver never holds more than the number of rows of a level.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions.paths import path_key
from sylva.operators.containment import drop_covered, small
from sylva.sources.content import local_path
from sylva.sources.tables import stored

#: Directories that a task lists.
LISTED = 256
_ENTRY = "parent string, kind string, path string, size long, mtime_us long, error string"


@dataclass
class Walk:
    """files: WORKSPACE rows. directories: (path, path_key, files, bytes) of every directory that was listed, empty ones
    too, with what lies in it directly. errors: (path, error) of what couldn't be listed. listings: calls made."""

    files: DataFrame
    directories: DataFrame
    errors: DataFrame
    listings: int


def _entries(path: str) -> Iterator[tuple]:
    """(kind, path, size, mtime in microseconds) of what a directory holds. A link is a file, whatever it points to."""
    at = local_path(path)
    if at is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        for info in store.get_file_info(fs.FileSelector(inner)):
            kind = "dir" if info.type == fs.FileType.Directory else "file"
            yield kind, f"{path.rstrip('/')}/{info.base_name}", info.size or 0, (info.mtime_ns or 0) // 1000
        return
    with os.scandir(at) as found:
        for entry in found:
            child = f"{path.rstrip('/')}/{entry.name}"
            if entry.is_dir(follow_symlinks=False):
                yield "dir", child, 0, 0
            else:
                facts = entry.stat(follow_symlinks=False)
                yield "file", child, facts.st_size, facts.st_mtime_ns // 1000


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["parent", "kind", "path", "size", "mtime_us", "error"]
    for batch in batches:
        for path in batch["path"]:
            try:
                rows = [(path, *entry, None) for entry in _entries(path)]
            except OSError as e:
                # a root that isn't there and a directory that went since its parent was listed hold nothing
                kind = "absent" if isinstance(e, (FileNotFoundError, NotADirectoryError)) else "error"
                rows = [(path, kind, path, None, None, f"{type(e).__name__}: {e.strerror or e}")]
            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "mtime_us": "Int64"})


def walk(spark: SparkSession, roots: list[str], excluded: DataFrame | None = None, pruned: DataFrame | None = None, policy: str = "unix") -> Walk:
    """Everything below the roots (a missing root holds nothing, repeated and nested roots count once). ``excluded``: entries
    (kind, key), which are left out with all below them; ``pruned``: directories (dir_key), likewise."""
    none = spark.createDataFrame([], "kind string, key string")
    out = (excluded if excluded is not None else none).select("kind", "key")
    if pruned is not None:
        out = out.unionByName(pruned.select(F.lit("dir").alias("kind"), F.col("dir_key").alias("key")))
    out = stored(out.distinct(), "walk-out")
    gone = {kind: small(out.where(f"kind = '{kind}'").select(F.col("key").alias("path_key"))) for kind in ("dir", "file")}
    first = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string").distinct().withColumn("path_key", path_key(F.col("path"), policy))
    level = stored(drop_covered(first.dropDuplicates(["path_key"]), out, "path_key"), "walk-level")
    seen: list[DataFrame] = []
    listed: list[DataFrame] = []
    calls = 0
    while n := level.count():
        calls += n
        listed.append(level)
        found = level.repartition(-(-n // LISTED)).select("path").mapInPandas(_list, _ENTRY)
        found = stored(found.withColumn("path_key", path_key(F.col("path"), policy)), "walk-found")
        kept = found.where("kind = 'file'").join(gone["file"], "path_key", "left_anti")
        seen += [kept.select(found.columns), found.where("kind IN ('error', 'absent')")]
        below = found.where("kind = 'dir'").join(gone["dir"], "path_key", "left_anti").select("path", "path_key")
        # a root below another root was listed as such
        level = stored(below.join(small(first.select("path_key")), "path_key", "left_anti") if len(roots) > 1 else below, "walk-level")
    found = reduce(DataFrame.unionByName, seen, spark.createDataFrame([], f"{_ENTRY}, path_key string"))
    files = found.where("kind = 'file'")
    inside = files.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    directories = reduce(DataFrame.unionByName, listed, spark.createDataFrame([], "path string, path_key string"))
    errors = found.where("kind = 'error'").select("path", "error")
    directories = directories.join(inside, "path", "left").join(found.where("kind IN ('error', 'absent')").select("path"), "path", "left_anti").fillna(0, ["files", "bytes"])
    workspace = files.select("path", "path_key", "size", F.timestamp_micros("mtime_us").alias("mtime"), F.lit(False).alias("filtered"))
    return Walk(workspace, directories, errors, calls)


def totals(walked: Walk) -> DataFrame:
    """One row (files, directories, bytes) of a walk."""
    sums = walked.directories.agg(F.sum("files").alias("files"), F.count(F.lit(1)).alias("directories"), F.sum("bytes").alias("bytes"))
    return sums.fillna(0)
