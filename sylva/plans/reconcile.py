"""The engine's entry point: tables in, a plan out. It never changes a file."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import schemas
from sylva.functions.paths import path_key, separator
from sylva.operators import audit, containment, feed, guards, ignore, pruning, snapshots, untracked
from sylva.operators.guards import PlanRefused, refuse_errors, refuse_if_any
from sylva.plans import classify
from sylva.sources import content
from sylva.sources.tables import stored

MODES = ("open", "clean", "sync")


@dataclass
class Tables:
    """Inputs (see ``sylva.schemas``). What is None is an empty table; ``digests`` are (client_key, computed) of files
    whose content was read, or ``content`` (client_key, content) to compute them from. ``pruned`` are directories known to
    be ignored; or ``rule_lines`` (the store's rule report) and ``ignore_lines`` (its answers about directories), from
    which they are found."""

    depot: DataFrame
    workspace: DataFrame
    have: DataFrame | None = None
    revisions: DataFrame | None = None
    digest_cache: DataFrame | None = None
    view_map: DataFrame | None = None
    verdicts: DataFrame | None = None
    scope: DataFrame | None = None
    digests: DataFrame | None = None
    content: DataFrame | None = None
    feed: DataFrame | None = None
    opened: DataFrame | None = None
    pruned: DataFrame | None = None
    rule_lines: DataFrame | None = None
    ignore_lines: DataFrame | None = None


@dataclass
class PlanResult:
    plan: DataFrame
    conflicts: DataFrame
    side: dict[str, DataFrame] = field(default_factory=dict)
    summary: DataFrame | None = None
    up_to_date: bool | None = None


def _or_empty(spark: SparkSession, df: DataFrame | None, schema: str) -> DataFrame:
    return df if df is not None else spark.createDataFrame([], schema)


def _check_options(mode: str, force: bool, delete_untracked: bool, as_of: int | None, verify_all: bool, excludes: bool) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if force and mode != "sync":
        raise ValueError("force needs mode sync")
    if delete_untracked and not force:
        raise ValueError("delete_untracked needs a forced sync")
    if verify_all and not force:
        raise ValueError("verify_all needs a forced sync")
    if as_of is not None and (mode != "sync" or as_of < 1):
        raise ValueError("as_of needs mode sync and a change of 1 or more")
    if excludes and mode == "sync" and not force:
        raise ValueError("exclusions of a run need force in mode sync")


def reconcile(
    spark: SparkSession,
    tables: Tables,
    mode: str = "open",
    force: bool = False,
    as_of: int | None = None,
    delete_untracked: bool = False,
    verify_all: bool = False,
    native_parity: bool = False,
    scope_entries: int = 2,
    policy: str = "unix",
    scope_file: str | None = None,
    applied: bool = False,
    run_excludes: bool = False,
    prune: bool = True,
    roots: tuple[str, ...] = (),
    ignore_file: str | None = pruning.IGNORE_FILE,
    read_files: bool = False,
) -> PlanResult:
    """Compare the snapshots and return the plan of a mode.

    open: what brings the store up to date. clean: what brings the disk back to what was synced. sync with force: what
    brings the disk to the head or to a change; without force: the store's own preview, scope-checked. Refusals raise
    PlanRefused before anything is returned.

    Ignore verdicts: open and clean take a file with a positive verdict as ignored, and what lies below a directory in
    ``pruned`` as absent unless the store tracks it. A forced sync doesn't look at them until it deletes: then every
    file to delete needs exactly one verdict, or the run is refused, and those that a verdict covers are left alone.

    ``prune`` looks for ignored directories below ``roots`` (directory keys) if the tables hold a rule report and answers.
    ``read_files`` reads the files that size, time and cache leave open where they are, in tasks and in constant memory."""
    _check_options(mode, force, delete_untracked, as_of, verify_all, run_excludes)
    if as_of is not None and force and tables.revisions is None:
        raise ValueError("as_of of a forced sync needs revisions, as the head isn't what was asked for")
    sep = separator(policy)
    depot = snapshots.dedupe_records(tables.depot, scope_entries)
    if mode == "sync" and tables.revisions is not None:
        target = snapshots.snapshot_as_of(tables.revisions, as_of)
    else:
        target = snapshots.head_target(depot)
    workspace = tables.workspace
    matched = _match_scope(tables.scope, depot, workspace, sep)
    if tables.scope is not None:
        depot = containment.scope_exclude(containment.scope_filter(depot, tables.scope, "client_key", sep), tables.scope, "client_key", sep)
        workspace = containment.scope_exclude(containment.scope_filter(workspace, tables.scope, "path_key", sep), tables.scope, "path_key", sep)
        if mode == "sync" and force:  # judged by the same scope, or paths outside would count as found
            target = target.join(depot.select("depot_file").distinct(), "depot_file", "left_semi")
    found = None
    if mode != "sync":
        if tables.pruned is None and tables.rule_lines is not None and tables.ignore_lines is not None:
            found = _find_pruned(workspace, tables, roots, prune, ignore_file, sep)
        workspace = _without_ignored(workspace, depot, tables, sep, found.pruned if found else tables.pruned)
    if mode == "sync" and not force:
        return _normal_sync(spark, tables, target, policy, applied)
    if tables.revisions is not None:
        depot = snapshots.refresh_baselines(depot, tables.revisions)
    rows = classify.classify_sync(depot, workspace, target) if mode == "sync" else classify.classify_open(depot, workspace)
    if mode == "sync":
        guards.empty_target_guard(target, depot)
    rows = stored(rows, "classified")  # guards, plan and reports read it
    refuse_errors(rows, "classification")
    if mode == "sync":
        rows = _sync_guards(rows, depot, target, tables.verdicts)
    side = {s: classify.side_report(rows, s) for s in ("unsynced", "archived", "handoff")}
    done = rows if mode != "clean" else classify.project_clean(rows)
    have, cache = _or_empty(spark, tables.have, schemas.HAVE), _or_empty(spark, tables.digest_cache, schemas.DIGEST_CACHE)
    computed = tables.digests
    if computed is None and tables.content is not None:
        todo = classify.needs_content(done.where("pending IS NOT NULL"), have, cache, verify_all).where("NOT unchanged AND found IS NULL")
        computed = classify.fresh_digests(todo, tables.content)
    elif computed is None and read_files:
        todo = classify.needs_content(done.where("pending IS NOT NULL"), have, cache, verify_all).where("NOT unchanged AND found IS NULL")
        computed, unread = _read_digests(todo, workspace)
        refuse_if_any(unread, "unreadable_file", F.concat_ws(": ", "path", "error"))
    pending_as = "pending" if mode != "clean" else None
    done = _resolve(done, have, cache, _or_empty(spark, computed, "client_key string, computed string"), verify_all, pending_as)
    refuse_errors(done, "digests")
    if mode == "open" and native_parity:
        done = classify.native_parity(done)
    if mode == "open" and tables.view_map is not None:
        done = classify.map_new_paths(done, tables.view_map)
        refuse_errors(done, "no_mapping")
    plan = classify.to_plan(done, mode, applied, force)
    if delete_untracked:
        plan = plan.unionByName(_untracked(tables, workspace, depot, scope_file, policy, applied))
    conflicts = spark.createDataFrame([], schemas.CONFLICTS)
    if found:
        facts = [(found.candidates, found.questions, found.fallback)]
        side |= {"pruned": found.pruned, "pruning": spark.createDataFrame(facts, "candidates long, questions long, fallback string")}
    side |= {"unmatched": matched[1], **({"timestamps": audit.timestamp_stats(rows.where("pending IS NOT NULL"), have), "risks": audit.risk_counts(rows, workspace)} if mode == "sync" else {})}
    return PlanResult(plan, conflicts, side, audit.summarize(plan, conflicts, mode, scope_matched=matched[0], unmatched=matched[2], applied=applied, force=force))


def _resolve(rows: DataFrame, have: DataFrame, cache: DataFrame, computed: DataFrame, verify_all: bool, open_words: str | None) -> DataFrame:
    """Digest funnel; in clean mode a changed file is reverted."""
    done = classify.resolve_digests(rows, have, cache, computed, verify_all)
    return done if open_words else done.withColumn("class", F.when(F.col("class") == "edit", "revert").otherwise(F.col("class")))


def _match_scope(scope: DataFrame | None, depot: DataFrame, workspace: DataFrame, sep: str) -> tuple[int | None, DataFrame | None, int]:
    """(matched include entries, those that match nothing, their number); refused if there are entries and all miss."""
    if scope is None:
        return None, None, 0
    missed = containment.unmatched_entries(scope, depot, workspace, sep).select("kind", "path", "key")
    n, unmatched = scope.where("role = 'include'").count(), missed.count()
    if n and n == unmatched:
        refuse_if_any(missed, "no_entry_matched", F.col("path"))
    return n - unmatched, missed, unmatched


def _find_pruned(workspace: DataFrame, tables: Tables, roots: tuple[str, ...], prune: bool, ignore_file: str | None, sep: str) -> pruning.Pruning:
    """Ignored directories below the roots, by the recorded answers."""
    listed = [containment.list_directories(workspace, r, pruning.IGNORE_FILE, sep=sep) for r in roots or ("",)]
    directories = reduce(DataFrame.unionByName, listed).groupBy("dir_key").agg(F.min("depth").alias("depth"), F.bool_or("nested_ignore").alias("nested_ignore"))
    return pruning.plan_pruning(directories, tables.rule_lines, pruning.answers_from(tables.ignore_lines), ignore_file, prune, sep=sep)


def _read_digests(todo: DataFrame, workspace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((client_key, computed), (path, error)) of files that must be read, at their own paths."""
    at = todo.select("client_key", "head_type").join(workspace.select(F.col("path_key").alias("client_key"), "path", "size"), "client_key")
    read = stored(content.fingerprint_files(at), "fingerprints")
    computed = at.select("client_key", "path").distinct().join(read.where("error IS NULL"), "path").select("client_key", "computed")
    return computed, read.where("error IS NOT NULL").select("path", "error")


def _without_ignored(workspace: DataFrame, depot: DataFrame, tables: Tables, sep: str, pruned: DataFrame | None) -> DataFrame:
    """``workspace`` without what lies in pruned directories that hold no tracked file, and with filtered set by verdicts."""
    if pruned is not None:
        held = containment.tracked_pruned_dirs(pruned, depot, sep)
        workspace = containment.prune_dirs(workspace, pruned.join(held, "dir_key", "left_anti"), "path_key", sep)
    if tables.verdicts is None:
        return workspace
    before = workspace.select("path_key", F.col("filtered").alias("_before")).where("_before")  # what is marked already stays so
    judged = ignore.apply_file_ignores(workspace, tables.verdicts).join(before, "path_key", "left")
    return judged.withColumn("filtered", F.col("filtered") | F.coalesce("_before", F.lit(False))).select(*workspace.columns)


def _sync_guards(rows: DataFrame, depot: DataFrame, target: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """``rows`` less the deletions that an ignore verdict covers; a deletion without exactly one verdict refuses the run."""
    counts = guards.first_download_counts(rows, depot).first()
    if counts["refuse"]:
        raise PlanRefused("first_download", [], counts["never_synced"])
    doomed = rows.where(F.col("class") == "delete")
    safe, unjudged = guards.protect_deletes(doomed, _or_empty(rows.sparkSession, verdicts, schemas.IGNORE_VERDICTS))
    refuse_if_any(unjudged, "verdict_completeness", F.col("client_file"))
    refuse_if_any(guards.case_conflicts(safe, depot, target), "case_conflict", F.col("depot_file"))
    return rows.where(~F.coalesce(F.col("class") == "delete", F.lit(False))).unionByName(safe)


def _untracked(tables: Tables, workspace: DataFrame, depot: DataFrame, scope_file: str | None, policy: str, applied: bool) -> DataFrame:
    spark = workspace.sparkSession
    key = None if scope_file is None else spark.range(1).select(path_key(F.lit(scope_file), policy)).first()[0]
    found = untracked.discover_untracked(workspace, depot, _or_empty(spark, tables.verdicts, schemas.IGNORE_VERDICTS), _or_empty(spark, tables.view_map, schemas.VIEW_MAP), key)
    none = F.lit(None).cast("string")
    return found.select(
        F.lit("sync").alias("mode"), F.lit("untracked").alias("class"), F.lit("deleting").alias("action"), "depot_file", F.col("path").alias("client_file"), F.lit(None).cast("long").alias("rev"),
        F.lit(applied).alias("applied"), F.lit(True).alias("force"), none.alias("stage"), none.alias("native_action"), none.alias("handoff"),
    )


def _normal_sync(spark: SparkSession, tables: Tables, target: DataFrame, policy: str, applied: bool) -> PlanResult:
    if tables.feed is None:
        raise ValueError("a sync without force needs the store's preview feed")
    opened = _or_empty(spark, tables.opened, "seq long, depot_file string, client_file string, have_rev long")
    found, refused = feed.classify_feed(tables.feed, opened, target, tables.scope, policy)
    none = F.lit(None).cast("string")
    plan = found.select(
        F.lit("sync").alias("mode"), "class", F.lit(None).cast("string").alias("action"), "depot_file", "client_file", "rev", F.lit(applied).alias("applied"), F.lit(False).alias("force"),
        none.alias("stage"), "native_action", none.alias("handoff"),
    )
    plan = plan.withColumn("action", classify.action_for(F.col("mode"), F.col("class")))
    conflicts = refused.select("reason", F.when(F.col("reason") == "delete_modified", "not deleted").otherwise("not updated").alias("action"), "depot_file", "client_file", "rev", none.alias("stage"), F.lit(applied).alias("applied"))
    # a run whose files are all refused is conclusive (ok), but not up to date: files differ and weren't touched
    return PlanResult(plan, conflicts, {}, audit.summarize(plan, conflicts, "sync", applied=applied), feed.is_up_to_date(found, refused))
