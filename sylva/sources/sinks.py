"""Sinks: JSON lines in the contract's field names, text listings, and pinned specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.kinds import action_for, class_rank
from sylva.functions.paths import escape_spec

# Group titles of the listings, {} for the count.
TITLES = {
    "open": {
        "add": "Adding {} files in workspace, not in depot or deleted at have revision, but not checked out for add.",
        "edit": "Editing {} files in workspace, changed from have revision, but not checked out for edit.",
        "reopen_edit": "Revert+Editing {} files in workspace, changed from have revision, but checked out for delete.",
        "delete": "Deleting {} files not in workspace, but not checked out for delete.",
        "reopen_delete": "Revert+Deleting {} files not in workspace, but checked out for edit.",
        "revert_add": "Reverting {} files not in workspace, but checked out for add.",
        "revert_edit": "Reverting {} files in workspace, not changed from have revision, but checked out for edit.",
        "revert_delete": "Reverting {} files in workspace, not changed from have revision, but checked out for delete.",
    },
    "clean": {
        "delete": "Deleting {} files in workspace, not in depot or deleted at have revision, but not checked out for add.",
        "revert": "Reverting {} files in workspace, changed from have revision, but not checked out for edit.",
        "restore": "Restoring {} files not in workspace, but not checked out for delete.",
    },
    "sync": {
        "update": "Updating {} files in workspace to the target depot revision.",
        "revert": "Reverting {} files in workspace, changed from the target revision, but not checked out for edit.",
        "restore": "Restoring {} files not in workspace, at the target depot revision.",
        "delete": "Deleting {} files in workspace, not present in the depot at the target revision.",
        "untracked": "Deleting {} untracked files from the workspace.",
    },
    "native": {
        "add": "Writing {} files into the workspace at the depot revision.",
        "update": "Updating {} files in the workspace to the depot revision.",
        "delete": "Removing {} files from the workspace.",
        "resolve": "Handing {} opened files to p4 to move their have revision.",
    },
}


def _json(df: DataFrame, **fields: Column) -> DataFrame:
    """One JSON object a row; NULL fields are absent."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"}).alias("value"))


def plan_lines(plan: DataFrame) -> DataFrame:
    """File records: rev as a string; rev, stage and nativeAction absent where NULL; handed-off rows aren't here."""
    rows = plan.where(F.col("class") != "handoff")
    c = F.col
    return _json(rows, kind=F.lit("file"), mode=c("mode"), action=F.coalesce(c("action"), action_for(c("mode"), c("class"))), **{"class": c("class")}, depotFile=c("depot_file"), clientFile=c("client_file"), rev=c("rev").cast("string"), applied=c("applied"), force=c("force"), stage=c("stage"), nativeAction=c("native_action"))


def conflict_lines(conflicts: DataFrame) -> DataFrame:
    """Conflict records; a file that would be deleted is ``not deleted``, any other ``not updated``."""
    c = F.col
    action = F.when(c("reason") == "delete_modified", "not deleted").otherwise("not updated")
    return _json(conflicts, kind=F.lit("conflict"), reason=c("reason"), action=action, depotFile=c("depot_file"), clientFile=c("client_file"), rev=c("rev").cast("string"), stage=c("stage"), applied=c("applied"))


def handoff_lines(plan: DataFrame) -> DataFrame:
    """Files that only the store can handle: listed, never counted."""
    c = F.col
    rows = plan.where(c("class") == "handoff")
    return _json(rows, kind=F.lit("file"), mode=c("mode"), **{"class": F.lit("handoff")}, action=c("handoff"), depotFile=c("depot_file"), clientFile=c("client_file"), applied=c("applied"), force=c("force"))


def unmatched_lines(entries: DataFrame) -> DataFrame:
    return _json(entries, kind=F.lit("unmatched"), path=F.col("path"), type=F.col("kind"))


def error_lines(spark, message: str) -> DataFrame:
    """One record for a run that failed as a whole."""
    return _json(spark.range(1), kind=F.lit("error"), message=F.lit(message))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("errorifexists").json(path)


def listing(plan: DataFrame, mode: str) -> DataFrame:
    """(class_rank, place, line): a title with its count for each class that has files, then ``Label "path".`` rows in
    path order. Sorting is left to the reader or ``write_listing``."""
    rank = class_rank(F.col("class"), mode)
    rows = plan.where(rank.isNotNull()).select(rank.alias("class_rank"), "class", "client_file")
    label = F.initcap(F.translate("class", "_", " "))
    titles = F.create_map(*[F.lit(x) for k, t in TITLES[mode].items() for x in (k, t)])
    heads = rows.groupBy("class_rank", "class").count().select("class_rank", F.lit("").alias("place"), F.replace(F.element_at(titles, F.col("class")), F.lit("{}"), F.col("count").cast("string")).alias("line"))
    return heads.unionByName(rows.select("class_rank", F.col("client_file").alias("place"), F.concat(label, F.lit(' "'), "client_file", F.lit('".')).alias("line")))


def write_listing(plan: DataFrame, mode: str, path: str) -> None:
    """Range-sorted, so the parts in name order are the listing."""
    listing(plan, mode).orderBy("class_rank", "place").select("line").write.mode("errorifexists").text(path)


def export_specs(plan: DataFrame, as_of: int | None = None) -> DataFrame:
    """``plan`` with spec: ``path#rev``, ``path#none`` for what goes from disk, ``path@change`` where the run is as of a
    change; a row that needs a revision and has none is an error in spec_error."""
    base = escape_spec(F.coalesce("depot_file", "client_file"))
    gone = (F.col("class") == "delete") & F.col("mode").isin("sync", "clean")
    pinned = F.when(F.col("rev").isNotNull(), F.concat(base, F.lit("#"), F.col("rev").cast("string")))
    spec = F.when(gone, F.concat(base, F.lit("#none"))).when(F.col("class").isin("add", "untracked") & (F.col("mode") != "sync"), base)
    spec = spec.when(F.lit(as_of is not None) & (F.col("mode") == "sync"), F.concat(base, F.lit(f"@{as_of}"))).otherwise(pinned)
    return plan.withColumn("spec", spec).withColumn("spec_error", F.when(spec.isNull(), F.concat(F.lit("no revision for "), F.coalesce("depot_file", "client_file"))))


def query_specs(scope: DataFrame, sep: str = "/") -> DataFrame:
    """Specs that a scope asks the store for: ``dir/...`` and escaped files."""
    spec = escape_spec(F.col("path"))
    return scope.where("role = 'include'").select(F.when(F.col("kind") == "dir", F.concat(F.regexp_replace(spec, r"[/\\]+$", ""), F.lit(f"{sep}..."))).otherwise(spec).alias("spec"))
