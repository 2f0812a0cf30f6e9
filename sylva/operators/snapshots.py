"""Record sets: deduplication by arrival, winners by local path, snapshots as of a change, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.kinds import is_deleted_action


def first_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key by arrival: an aggregate, so rows combine before the shuffle and no key is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def dedupe_records(depot: DataFrame, entries: int = 2) -> DataFrame:
    """First record of each exact depot path; overlapping scope entries report a path twice, a single one can't."""
    return depot if entries == 1 else first_by(depot, ["depot_file"])


def pick_winner(depot: DataFrame) -> DataFrame:
    """Of records that share a local path the one that the path stands for: live before deleted, synced before never
    synced, then the first."""
    rank = F.struct(is_deleted_action(F.col("head_action")).alias("a"), F.col("have_rev").isNull().alias("b"), "seq")
    rest = [c for c in depot.columns if c != "client_key"]
    return depot.groupBy("client_key").agg(F.min_by(F.struct(*rest), rank).alias("_r")).select("client_key", "_r.*").select(*depot.columns)


def mark_winners(depot: DataFrame) -> DataFrame:
    """``depot`` with boolean winner."""
    order = Window.partitionBy("client_key").orderBy(is_deleted_action(F.col("head_action")), F.col("have_rev").isNull(), "seq")
    return depot.withColumn("winner", F.row_number().over(order) == 1)


def resolve_restore(files: DataFrame, depot: DataFrame) -> DataFrame:
    """``files`` (client_key, ...) with depot_file and have_rev of the record that the path stands for, and error: what has
    no record or was never synced can't be restored; refuse the run on any."""
    record = pick_winner(depot).select("client_key", "depot_file", "have_rev")
    error = F.when(F.col("depot_file").isNull(), "no record").when(F.col("have_rev").isNull(), "never synced")
    return files.join(record, "client_key", "left").withColumn("error", error)


def snapshot_as_of(revisions: DataFrame, change: int | None = None) -> DataFrame:
    """Target rows (depot_file, rev, action): of each exact path its latest revision up to a change; None: the head.
    Revisions without number or action don't count."""
    if change is not None and change < 1:
        raise ValueError("a change number is 1 or more")
    rows = revisions.where(F.col("rev").isNotNull() & F.col("action").isNotNull())
    if change is not None:
        rows = rows.where(F.col("change") <= change)
    return rows.groupBy("depot_file").agg(F.max("rev").alias("rev"), F.max_by("action", "rev").alias("action"))


def head_target(depot: DataFrame) -> DataFrame:
    """Target rows of the head, from depot records before their baselines are refreshed."""
    rows = depot.where(F.col("head_rev").isNotNull() & F.col("head_action").isNotNull())
    return first_by(rows.select("seq", "depot_file", F.col("head_rev").alias("rev"), F.col("head_action").alias("action")), ["depot_file"]).drop("seq")


def refresh_baselines(depot: DataFrame, revisions: DataFrame) -> DataFrame:
    """Records that are synced at another revision than the head get type, action, size and digest of the revision they
    have; a path that isn't found exactly is looked up without ASCII case if that is unambiguous."""
    facts = ["head_type", "unsupported_type", "head_action", "file_size", "digest"]
    unsupported = F.col("unsupported_type") if "unsupported_type" in revisions.columns else F.lit(None).cast("string")
    base = revisions.select("depot_file", F.col("rev").alias("have_rev"), F.struct(F.col("head_type"), unsupported.alias("unsupported_type"), F.col("action").alias("head_action"), "file_size", "digest").alias("_base"))
    wanted = depot.where(F.col("have_rev").isNotNull() & ~F.col("have_rev").eqNullSafe(F.col("head_rev"))).select("depot_file", "have_rev").distinct()
    exact = wanted.join(base, ["depot_file", "have_rev"])
    missing = wanted.join(exact.select("depot_file", "have_rev"), ["depot_file", "have_rev"], "left_anti")
    ascii_ = F.col("depot_file").rlike(r"^[\x00-\x7F]*$")
    folded = base.where(ascii_).groupBy(F.lower("depot_file").alias("_low"), "have_rev").agg(F.count(F.lit(1)).alias("n"), F.first("_base").alias("_base")).where("n = 1").drop("n")
    near = missing.where(ascii_).withColumn("_low", F.lower("depot_file")).join(folded, ["_low", "have_rev"]).select("depot_file", "have_rev", "_base")
    found = exact.unionByName(near)
    out = depot.join(found, ["depot_file", "have_rev"], "left")
    for f in facts:
        out = out.withColumn(f, F.when(F.col("_base").isNotNull(), F.col(f"_base.{f}")).otherwise(F.col(f)))
    return out.select(*depot.columns)


def union_inventories(*inventories: DataFrame) -> DataFrame:
    """One inventory of several scope entries: a path that two entries list counts once (they list the same file)."""
    out = inventories[0]
    for more in inventories[1:]:
        out = out.unionByName(more)
    return out.groupBy("path_key").agg(F.min_by(F.struct("path", "size", "mtime", "filtered"), "path").alias("r")).select("r.path", "path_key", "r.size", "r.mtime", "r.filtered")


def sorted_inventory(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy("path_key", "path")


def conflicting_duplicates(candidates: DataFrame) -> DataFrame:
    """Depot files whose duplicate candidates disagree on action, rev or local path."""
    return candidates.groupBy("depot_file").agg(F.count_distinct(F.struct("class", "rev", "client_file")).alias("versions")).where("versions > 1")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """First of identical candidates; check ``conflicting_duplicates`` before."""
    return first_by(candidates, ["depot_file"])


def dedupe_refusals(refusals: DataFrame) -> DataFrame:
    """First of each full identity."""
    return first_by(refusals, ["reason", "depot_file", "client_file", "rev"])
