"""The store's own preview of an update: candidates, refusals, deletions and opened files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.kinds import DELETED, native_class
from sylva.functions.messages import classify_feed_record, parse_deleted_notice, parse_refusal
from sylva.functions.paths import path_key
from sylva.operators.containment import drop_covered, keep_covered
from sylva.operators.guards import refuse_if_any
from sylva.operators.snapshots import conflicting_duplicates, dedupe_candidates, dedupe_refusals

_CANDIDATE = ["seq", "class", "native_action", "depot_file", "client_file", "rev", "error"]


def feed_kinds(feed: DataFrame) -> DataFrame:
    return feed.withColumn("record", classify_feed_record(F.col("code"), F.col("severity")))


def feed_candidates(feed: DataFrame) -> DataFrame:
    """Candidates of body records; a record without a path or action, or with a revision that is no number, is an error."""
    class_, wrong = native_class(F.col("action"))
    rev = F.col("rev").try_cast("long")
    missing = F.when(F.col("depotFile").isNull() | F.col("clientFile").isNull() | F.col("action").isNull(), F.lit("a feed record lacks a field"))
    bad_rev = F.when(F.col("rev").isNotNull() & rev.isNull(), F.concat(F.lit("bad revision "), F.col("rev")))
    body = feed_kinds(feed).where("record = 'body'")
    return body.select("seq", class_.alias("class"), F.col("action").alias("native_action"), F.col("depotFile").alias("depot_file"), F.col("clientFile").alias("client_file"), rev.alias("rev"), F.coalesce(missing, bad_rev, wrong).alias("error"))


def notices(feed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refusals, deletions, unexplained) of the feed's notices."""
    read = feed_kinds(feed).where("record = 'notice'").select("seq", "data", parse_refusal(F.col("data")).alias("r"), parse_deleted_notice(F.col("data")).alias("d"))
    refusals = read.where("r IS NOT NULL").select("seq", "r.*")
    deletions = read.where("r IS NULL AND d IS NOT NULL").select("seq", F.lit("delete").alias("class"), F.lit("deleted").alias("native_action"), "d.depot_file", "d.client_file", F.col("d.rev").cast("long").alias("rev"), F.lit(None).cast("string").alias("error"))
    return dedupe_refusals(refusals.select("seq", "reason", "depot_file", "client_file", "rev")), deletions, read.where("r IS NULL AND d IS NULL").select("seq", "data")


def opened_candidates(opened: DataFrame, target: DataFrame) -> DataFrame:
    """Opened files (seq, depot_file, client_file, have_rev) whose have revision the store would move: dropped if there is
    no target revision or have is the target; a deleted target or a missing have is an error."""
    t = target.select("depot_file", F.col("rev").alias("target_rev"), F.col("action").alias("target_action"))
    at = opened.join(t, "depot_file", "left").where(F.col("target_rev").isNotNull() & ~F.col("have_rev").eqNullSafe(F.col("target_rev")))
    error = F.when(F.col("target_action").isin(*DELETED), F.concat(F.lit("opened but deleted at the target: "), F.col("depot_file"))).when(F.col("have_rev").isNull(), F.concat(F.lit("opened without a have revision: "), F.col("depot_file")))
    return at.select("seq", F.lit("resolve").alias("class"), F.lit(None).cast("string").alias("native_action"), "depot_file", "client_file", F.col("target_rev").alias("rev"), error.alias("error"))


def scope_check(candidates: DataFrame, scope: DataFrame, policy: str = "unix", sep: str = "/") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, excluded, outside): excluded candidates are dropped and counted; any outside of the includes is an error."""
    keyed = candidates.withColumn("key", path_key(F.col("client_file"), policy))
    kept = drop_covered(keyed, scope.where("role <> 'include'"), "key", sep)
    inside = keep_covered(kept, scope.where("role = 'include'"), "key", sep)
    excluded = keyed.join(kept.select("key").distinct(), "key", "left_anti")
    outside = kept.join(inside.select("key").distinct(), "key", "left_anti")
    return inside.drop("key"), excluded.drop("key"), outside.drop("key")


def classify_feed(feed: DataFrame, opened: DataFrame, target: DataFrame, scope: DataFrame | None = None, policy: str = "unix") -> tuple[DataFrame, DataFrame]:
    """(candidates, conflicts) of a preview. The run is refused if a record failed, if duplicates
    disagree, if a candidate lies outside of the scope, or if a notice can't be read and no opened file explains it."""
    kinds = feed_kinds(feed)
    refuse_if_any(kinds.where("record = 'failure'"), "feed_failure", F.coalesce("data", "code"), F.col("seq"))
    refusals, deletions, unexplained = notices(feed)
    require_explained(unexplained, opened)
    extra = opened_candidates(opened, target)
    found = feed_candidates(feed).select(*_CANDIDATE).unionByName(deletions.select(*_CANDIDATE)).unionByName(extra.select(*_CANDIDATE))
    refuse_if_any(found.where("error IS NOT NULL"), "feed_record", F.col("error"), F.col("seq"))
    refuse_if_any(conflicting_duplicates(found), "conflicting_duplicates", F.col("depot_file"))
    found = dedupe_candidates(found)
    if scope is not None:
        found, _, outside = scope_check(found, scope, policy)
        refuse_if_any(outside, "outside_scope", F.col("client_file"))
    return found, refusals


def is_up_to_date(candidates: DataFrame, conflicts: DataFrame) -> bool:
    """Nothing to do. Refusals without candidates aren't that: files differ and weren't touched."""
    return candidates.isEmpty() and conflicts.isEmpty()


def require_explained(unexplained: DataFrame, opened: DataFrame) -> None:
    """Notices (seq, data) that can't be read tell of files that the preview doesn't name: those are opened ones. Without
    any opened file the answer is incomplete and refused."""
    if opened.isEmpty():
        refuse_if_any(unexplained, "unexplained_notice", F.col("data"), F.col("seq"))
