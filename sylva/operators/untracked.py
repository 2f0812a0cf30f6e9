"""Local files that the store doesn't track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.guards import PlanRefused, refuse_if_any
from sylva.operators.ignore import ignored_paths


def untracked_candidates(workspace: DataFrame, depot: DataFrame, scope_file_key: str | None = None) -> DataFrame:
    """Files without a record of their key, less the scope file. A hash anti-join: linear in both sides."""
    rows = workspace.join(depot.select(F.col("client_key").alias("path_key")).distinct(), "path_key", "left_anti")
    return rows if scope_file_key is None else rows.where(F.col("path_key") != scope_file_key)


def map_paths(paths: DataFrame, view_map: DataFrame, strict: bool = False) -> DataFrame:
    """``paths`` with depot_file (NULL without mapping) and unmapped (NULL without record); strict: a path without record
    refuses the run."""
    at = paths.join(view_map.select("path_key", "depot_file", "unmapped"), "path_key", "left")
    if strict:
        refuse_if_any(at.where("unmapped IS NULL"), "no_mapping", F.col("path_key"))
    return at


def cross_check(mapped: DataFrame, depot: DataFrame) -> DataFrame:
    """``mapped`` with verdict: outside_view, view_excluded, tracked (the exact depot path has a record) or untracked."""
    held = depot.select("depot_file").distinct().withColumn("_held", F.lit(True))
    at = mapped.join(held, "depot_file", "left")
    verdict = F.when(F.col("depot_file").isNull(), "outside_view").when(F.col("unmapped"), "view_excluded").when(F.col("_held"), "tracked").otherwise("untracked")
    return at.withColumn("verdict", verdict).drop("_held")


def cross_check_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("untracked", "tracked", "outside_view", "view_excluded")])


def discover_untracked(workspace: DataFrame, depot: DataFrame, verdicts: DataFrame, view_map: DataFrame, scope_file_key: str | None = None) -> DataFrame:
    """Untracked files that may go: the ignore check, which is strict, comes before the mapping, and mapped paths are
    checked against exact depot paths. An empty depot is refused: then everything would be untracked."""
    if depot.isEmpty():
        raise PlanRefused("empty_depot", [], 0)
    found = untracked_candidates(workspace, depot, scope_file_key)
    ignored, bad = ignored_paths(found, verdicts, strict=True)
    refuse_if_any(bad, "verdict_completeness", F.col("path"))
    mapped = map_paths(found.join(ignored, "path", "left_anti"), view_map)
    return cross_check(mapped, depot).where("verdict = 'untracked'").drop("verdict", "unmapped")


def translate_depot_paths(targets: DataFrame, view_map: DataFrame, strict: bool = False) -> DataFrame:
    """Depot-path targets (depot_file, kind) as local entries. Lenient: a target without mapping is dropped; strict: it
    refuses the run."""
    at = targets.join(view_map.where("NOT unmapped").select("depot_file", F.col("path_key").alias("key")), "depot_file", "left")
    if strict:
        refuse_if_any(at.where("key IS NULL"), "unmapped_target", F.col("depot_file"))
    return at.where("key IS NOT NULL").select("kind", F.col("key").alias("path"), "key")
