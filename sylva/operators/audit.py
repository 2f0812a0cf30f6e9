"""Summaries, run-log checks, and comparisons of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.digests import unchanged_since_sync
from sylva.functions.messages import percent_skipped, split_positions
from sylva.functions.paths import ancestors, client_syntax, parent_dir
from sylva.operators.containment import small
from sylva.operators.guards import refuse_if_any
from sylva.sources.tables import stored


def class_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def summarize(plan: DataFrame, conflicts: DataFrame, mode: str, ok: bool = True, reason: str | None = None, scope_matched: int | None = None, unmatched: int = 0, applied: bool = False, force: bool = False) -> DataFrame:
    """One row: counts of classes that have files, their total, conflicts beside it. Handed-off files aren't counted;
    scope_matched NULL means unknown, not none."""
    per = class_counts(plan.where("class <> 'handoff'"))
    counted = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    refused = conflicts.agg(F.count(F.lit(1)).alias("conflicts"))
    return counted.crossJoin(refused).select(
        F.lit("summary").alias("kind"), F.lit(mode).alias("mode"), F.lit(ok).alias("ok"), F.lit(applied).alias("applied"), F.lit(force).alias("force"), "total", "counts", "conflicts",
        F.lit(scope_matched).cast("long").alias("scopeMatched"), F.lit(unmatched).alias("unmatched"), F.lit(None if ok else reason or "error").cast("string").alias("reason"),
    )


def inventory_totals(inventory: DataFrame, sep: str = "/") -> DataFrame:
    """One row (files, bytes, dirs): directories that hold a file or a directory of one."""
    per = _by_parent(inventory, sep)
    dirs = per.select(F.explode(ancestors(F.col("up"), sep)).alias("d")).distinct().agg(F.count(F.lit(1)).alias("dirs"))
    return per.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).crossJoin(dirs)


def _by_parent(inventory: DataFrame, sep: str) -> DataFrame:
    """(up, files, bytes) of each directory that holds a file: paths are reduced before any is exploded."""
    return inventory.groupBy(parent_dir(F.col("path_key"), sep).alias("up")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def inventory_totals_by_entry(inventory: DataFrame, entries: DataFrame, sep: str = "/") -> DataFrame:
    """(key, files, bytes) of each directory entry and of all (key NULL)."""
    own = _by_parent(inventory, sep)
    up = own.select("files", "bytes", F.explode(ancestors(F.col("up"), sep)).alias("key"))
    per = up.join(small(entries.where("kind = 'dir'").select("key").distinct()), "key").groupBy("key").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return per.unionByName(own.agg(F.lit(None).cast("string").alias("key"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")))


def timestamp_stats(pending: DataFrame, have: DataFrame) -> DataFrame:
    """(group, candidates, skipped, percent) of pending comparisons; the row without group is all of them."""
    at = pending.join(have.select(F.col("path_key").alias("client_key"), "sync_time"), "client_key", "left").withColumn("skip", unchanged_since_sync(F.col("mtime"), F.col("sync_time")))
    per = at.rollup(F.col("pending").alias("group")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("skip").alias("skipped"))
    return per.withColumn("percent", percent_skipped(F.col("skipped"), F.col("candidates")))


def hash_stats(funnel: DataFrame) -> DataFrame:
    """One row (files, cache_hits, bytes_hashed) of a digest funnel (size, unchanged, found)."""
    todo = funnel.where("NOT unchanged")
    return todo.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("found").isNotNull()).alias("cache_hits"), F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("disk_size"))), F.lit(0)).alias("bytes_hashed"))


def command_tally(log: DataFrame) -> DataFrame:
    """(run_id, command, calls); command NULL is the run's total."""
    rows = log.where(F.col("command").isNotNull())
    per = rows.groupBy("run_id", "command").agg(F.count(F.lit(1)).alias("calls"))
    return per.unionByName(per.groupBy("run_id").agg(F.lit(None).cast("string").alias("command"), F.sum("calls").alias("calls")).select("run_id", "command", "calls"))


def running_call_count(log: DataFrame) -> DataFrame:
    """``log`` with calls_so_far: commands up to and with each row of its run; 0 before the first."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("calls_so_far", F.sum(F.when(F.col("command").isNotNull(), 1).otherwise(0)).over(w))


def degraded_paths(files: DataFrame, root: str, client: str, policy: str = "unix") -> DataFrame:
    """One row (degraded, example): files that client syntax can't name, and the first of them."""
    _, bad = client_syntax(F.col("path"), root, client, policy)
    return files.agg(F.count_if(bad).alias("degraded"), F.min_by(F.when(bad, F.col("path")), F.when(bad, F.col("seq"))).alias("example"))


def risk_counts(plan: DataFrame, workspace: DataFrame) -> DataFrame:
    """One row: planned updates over files that were never synced, and planned deletions of such."""
    here = workspace.select(F.col("path_key").alias("client_key"), F.lit(True).alias("here"))
    at = plan.join(here, "client_key", "left")
    never = F.col("have_rev").isNull() & F.col("here")
    return at.agg(F.count_if(never & (F.col("class") == "update")).alias("never_synced_updates"), F.count_if(never & (F.col("class") == "delete")).alias("never_synced_deletes"))


def multiset_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows differs, with both numbers; NULL is a key like others."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.select(*keys, one.alias("n_a"), none.alias("n_b")).unionByName(b.select(*keys, none.alias("n_a"), one.alias("n_b")))
    return both.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).where("n_a <> n_b")


#: Bits by which ranges of hashes get finer, from level to level.
LEVEL_BITS = 8


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with _h, 64 bits of all columns; where a NULL stands counts."""
    return df.select(*columns, F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())]).alias("_h"))


def _range_sums(df: DataFrame, side: str, bits: int) -> DataFrame:
    """(range, n, low, high) of the hash ranges of so many bits: sums that don't depend on order and count repeats. They
    combine before the shuffle, so a task sends a row a range at most."""
    low, high = F.col("_h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("_h", 32)
    return df.groupBy(F.shiftrightunsigned("_h", 64 - bits).alias("range")).agg(F.count(F.lit(1)).alias(f"n_{side}"), F.sum(low).alias(f"low_{side}"), F.sum(high).alias(f"high_{side}"))


def changed_rows(a: DataFrame, b: DataFrame, levels: int = 3) -> DataFrame:
    """Rows (all columns of ``a``) that the two tables don't have equally often, with n_a and n_b: ``multiset_diff`` by a tree
    of hashes. Sums by hash range are compared level by level; rows of ranges that agree are never shuffled, so what moves
    follows the difference. Both tables are read once a level and once at the end. Ranges that differ pass as equal with a
    chance of about 2**-64 each."""
    columns = a.columns
    a, b = _hashed(a, columns), _hashed(b, columns)
    left = [(a, "a"), (b, "b")]
    for level in range(1, levels + 1):
        bits = level * LEVEL_BITS
        sums = [_range_sums(x, side, bits) for x, side in left]
        differ = F.expr("n_a IS DISTINCT FROM n_b OR low_a IS DISTINCT FROM low_b OR high_a IS DISTINCT FROM high_b")
        ranges = stored(sums[0].join(sums[1], "range", "full").where(differ).select("range", F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))).alias("n")), "ranges")
        found = ranges.agg(F.count(F.lit(1)), F.max("n")).first()
        at = small(ranges.select("range"))
        left = [(x.withColumn("range", F.shiftrightunsigned("_h", 64 - bits)).join(at, "range", "left_semi").drop("range"), side) for x, side in ((a, "a"), (b, "b"))]
        if not found[0] or found[1] <= 2:
            break
    return multiset_diff(left[0][0], left[1][0], columns)


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """The tables have the same rows equally often: only sums by hash range are shuffled."""
    if set(a.columns) != set(b.columns):
        return False
    return changed_rows(a, b.select(*a.columns), 1).isEmpty()


def failures_by_group(results: DataFrame) -> DataFrame:
    """(class, failed, first_error): every group is tried; what failed is counted by group, with the first message."""
    bad = results.where(F.col("error").isNotNull())
    return bad.groupBy("class").agg(F.count(F.lit(1)).alias("failed"), F.min_by("error", "seq").alias("first_error"))


def unacknowledged(specs: DataFrame, lines: DataFrame) -> DataFrame:
    """Specs that no answer line names. A line acknowledges the longest known spec that ends before `` - ``. Answers none of
    which names a known spec can't be read, and refuse the run: sending all specs again wouldn't help."""
    read = lines.select("value", F.explode(split_positions(F.col("value"))).alias("spec")).join(specs.select("spec").distinct(), "spec", "left_semi")
    named = read.groupBy("value").agg(F.max_by("spec", F.length("spec")).alias("spec")).select("spec").distinct()
    if not specs.isEmpty() and not lines.isEmpty() and named.isEmpty():
        refuse_if_any(lines, "unreadable_answers", F.col("value"))
    return specs.join(named, "spec", "left_anti")


def native_coverage(plan: DataFrame, native: DataFrame) -> DataFrame:
    """(side, class, client_file): what only one of two plans has."""
    a, b = plan.select("class", "client_file").distinct(), native.select("class", "client_file").distinct()
    only = lambda x, y, side: x.join(y, ["class", "client_file"], "left_anti").select(F.lit(side).alias("side"), "class", "client_file")
    return only(a, b, "plan").unionByName(only(b, a, "native"))


def validate_run_log(log: DataFrame) -> DataFrame:
    """(run_id, verdict) of each run: trusted only if its summary came with ok, its counts add up to its total and to its
    file records, conflicts and calls agree, the call count rises by one from 0, and no step goes back."""
    per = log.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "summary").alias("summaries"),
        F.bool_and(F.when(F.col("kind") == "summary", F.col("ok"))).alias("ok"),
        F.max(F.when(F.col("kind") == "summary", F.struct("total", "conflicts", "p4Calls"))).alias("s"),
        F.max(F.when(F.col("kind") == "summary", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda x, y: x + y))).alias("counted"),
        F.count_if((F.col("kind") == "file") & (F.coalesce("class", F.lit("")) != "handoff")).alias("files"),
        F.count_if(F.col("kind") == "conflict").alias("conflicts"),
        F.count_if(F.col("kind") == "p4CommandCount").alias("events"),
        F.count_distinct(F.when(F.col("kind") == "p4CommandCount", F.col("count"))).alias("counts_seen"),
        F.min(F.when(F.col("kind") == "p4CommandCount", F.col("count"))).alias("least"),
        F.max(F.when(F.col("kind") == "p4CommandCount", F.col("count"))).alias("most"),
    )
    order = Window.partitionBy("run_id", "kind").orderBy("seq")
    back = log.where(F.col("kind").isin("progress", "p4CommandCount")).withColumn("now", F.when(F.col("kind") == "progress", F.col("step")).otherwise(F.col("count"))).withColumn("before", F.lag("now").over(order))
    wrong = back.where((F.col("now") < F.col("before")) | ((F.col("kind") == "p4CommandCount") & (F.col("now") == F.col("before")))).select("run_id", F.lit(True).alias("back")).distinct()
    s = F.col("s")
    verdict = (
        F.when(F.col("summaries") == 0, "incomplete").when(F.col("summaries") > 1, "several_summaries").when(~F.coalesce("ok", F.lit(False)), "failed")
        .when((F.coalesce("counted", F.lit(0)) != s["total"]) | (F.col("files") != s["total"]), "counts")
        .when(F.col("conflicts") != F.coalesce(s["conflicts"], F.lit(0)), "conflicts")
        .when(F.coalesce("back", F.lit(False)), "order")
        .when((F.col("events") > 0) & ((F.col("least") != 0) | (F.col("most") != F.coalesce(s["p4Calls"], F.lit(0)))), "calls")
        .otherwise("trusted")
    )
    return per.join(wrong, "run_id", "left").select("run_id", verdict.alias("verdict"))


def trusted_rows(log: DataFrame) -> DataFrame:
    """Rows of trusted runs only."""
    return log.join(validate_run_log(log).where("verdict = 'trusted'"), "run_id", "left_semi")


def progress_goes_back(log: DataFrame) -> DataFrame:
    """Progress rows whose step is below the one before; equal steps are fine."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return log.where("kind = 'progress'").withColumn("before", F.lag("step").over(w)).where("step < before")
