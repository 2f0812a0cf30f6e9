"""Scopes: what a run works on, from a scope document, targets and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import schemas
from sylva.functions.paths import canonical_path, path_key, separator, strip_recursive_suffix
from sylva.operators.containment import drop_covered, dropped_targets, intersect, topmost
from sylva.operators.guards import PlanRefused, refuse_if_any

_ENTRY = ["kind", "path", "key"]


def entries(spark: SparkSession, rows: list[tuple[str, str]], root: str, policy: str = "unix") -> DataFrame:
    """Entry rows (kind, path, key) of (kind, path) pairs given on the spot, relative to ``root`` or absolute."""
    return resolve_entries(spark.createDataFrame(rows, "kind string, path string"), root, policy)


def resolve_entries(given: DataFrame, root: str, policy: str = "unix") -> DataFrame:
    """Entries with canonical paths and keys; ``.`` is the root."""
    path = canonical_path(F.when(F.col("path") == ".", F.lit(root)).otherwise(F.col("path")), root, policy)
    return given.select("kind", path.alias("path")).withColumn("key", path_key(F.col("path"), policy))


def parse_targets(arguments: DataFrame, directories: DataFrame, root: str, policy: str = "unix") -> DataFrame:
    """(path, kind, key, depot) of command-line paths: ``//...`` is a depot path; a trailing ``...`` means a directory;
    else the type of what is there counts, and a missing path is a file. ``directories``: (dir_key)."""
    raw = F.col("path")
    depot = F.startswith(raw, F.lit("//"))
    bare = strip_recursive_suffix(raw)
    said = bare != raw
    local = canonical_path(bare, root, policy)
    at = arguments.select(depot.alias("depot"), said.alias("said"), F.when(depot, F.regexp_replace(bare, "/+$", "")).otherwise(local).alias("path"))
    at = at.withColumn("key", F.when(F.col("depot"), F.col("path")).otherwise(path_key(F.col("path"), policy)))
    there = directories.select(F.col("dir_key").alias("key")).distinct().withColumn("_dir", F.lit(True))
    at = at.join(there, "key", "left")
    return at.select("path", F.when(F.col("said") | F.coalesce("_dir", F.lit(False)), "dir").otherwise("file").alias("kind"), "key", "depot")


def build_scope(
    spark: SparkSession,
    root: str,
    config: DataFrame | None = None,
    include_given: bool = False,
    targets: DataFrame | None = None,
    excludes: DataFrame | None = None,
    scope_file: str | None = None,
    policy: str = "unix",
) -> DataFrame:
    """Scope rows (role, kind, path, key), or PlanRefused.

    ``config``: entries (role, kind, path) of the scope document, None without one; ``include_given`` False means the
    whole root. include = document and targets, both narrowed to their overlap; exclude = document and run together, and
    always wins. The scope file itself is an implicit exclusion."""
    sep = separator(policy)
    if config is None and targets is None:
        raise PlanRefused("no_path", ["a run takes its paths from a scope document or from its own list, and has neither"], 0)
    nothing = spark.createDataFrame([], "kind string, path string, key string")
    excluded = excludes.select(*_ENTRY) if excludes is not None else nothing
    base = None
    if config is not None:
        own = resolve_entries(config.where("role = 'exclude'"), root, policy)
        excluded = own.unionByName(excluded)
        base = resolve_entries(config.where("role = 'include'"), root, policy) if include_given else entries(spark, [("dir", ".")], root, policy)
    excluded = excluded.groupBy("key").agg(F.first(F.struct("kind", "path")).alias("r")).select("r.kind", "r.path", "key")
    implicit = nothing
    if config is not None and scope_file is not None:
        implicit = entries(spark, [("file", scope_file)], root, policy)
    if base is None:
        include = targets.select(*_ENTRY)
    elif targets is None:
        include = base
    else:
        include = intersect(base, targets.select(*_ENTRY), sep)
    include = topmost(drop_covered(include, excluded.unionByName(implicit), "key", sep), sep)
    if include.isEmpty():
        shown = [f"{r['kind']} {r['path']}" for r in (base if base is not None else nothing).limit(10).collect()] or ["include <empty>"]
        raise PlanRefused("no_overlap", ["no path of the run's list is in the scope document", *shown], 0)
    if targets is not None:
        lost = dropped_targets(targets.select(*_ENTRY), include, excluded.unionByName(implicit), sep)
        refuse_if_any(lost, "dropped_targets", F.col("path"))
    part = lambda df, role: df.select(F.lit(role).alias("role"), *_ENTRY)
    return part(include, "include").unionByName(part(excluded, "exclude")).unionByName(part(implicit, "implicit")).to(spark.createDataFrame([], schemas.SCOPE).schema)


def sorted_scope(scope: DataFrame) -> DataFrame:
    return scope.orderBy("role", "key")
