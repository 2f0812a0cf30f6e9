"""Classification: joined snapshots to one plan row a file, by ordered CASE rules.

Columns of a classified row: class (final), pending (a comparison that needs content), side (report only: handoff,
archived, unsynced), error (the facts contradict themselves). Losers of a shared local path take part in the depot pass;
files are judged against the winner. Every branch of the decision table is one WHEN, in the table's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.digests import digest, missing_fields, unchanged_since_sync
from sylva.functions.kinds import DELETED, action_for, digest_type, is_deleted_action, is_live_action
from sylva.operators.snapshots import mark_winners

ADDING = ("add", "move/add", "branch")
_OUT = ["class", "pending", "side", "error"]


def _decided(rows: DataFrame, *rules: tuple[Column, dict[str, str | Column]]) -> DataFrame:
    """``rows`` with class, pending, side and error from ordered (condition, outcome) rules; the first that holds decides.

    One CASE gives the rule's number, from which the outcomes are read, so conditions are in the plan once."""
    number = None
    for i, (when, _) in enumerate(rules):
        number = F.when(when, F.lit(i)) if number is None else number.when(when, F.lit(i))
    out = {}
    for name in _OUT:
        values = [outcome.get(name) for _, outcome in rules]
        column = F.get(F.array(*[F.lit(None if isinstance(v, Column) else v).cast("string") for v in values]), F.col("_rule"))
        for i, v in enumerate(values):
            if isinstance(v, Column):
                column = F.when(F.col("_rule") == i, v).otherwise(column)
        out[name] = column
    return rows.withColumn("_rule", number).withColumns(out).drop("_rule")


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def depot_pass(depot: DataFrame, workspace: DataFrame) -> DataFrame:
    """Every depot record against the disk. An ignored file still counts as present for delete and reopen_delete."""
    c = F.col
    w = workspace.select(c("path_key").alias("client_key"), c("path").alias("local"), c("size").alias("disk_size"), "mtime", "filtered")
    at = depot.join(w, "client_key", "left")
    on_disk, visible = c("local").isNotNull(), _is(c("local").isNotNull() & ~c("filtered"))
    live = is_live_action(c("head_action"))
    known = c("head_type").isNotNull() & c("file_size").isNotNull()
    missing = F.concat(F.lit("rule 1: "), missing_fields(c("head_type"), c("file_size")))
    no_digest = digest_type(c("head_type")).isNull()
    deleting = _is(c("action").isin(*DELETED))
    return _decided(
        at,
        *(
            (c("unsupported_type").isNotNull(), {"side": "handoff"}),
            (is_deleted_action(c("head_action")), {}),
            (_is(c("head_action") == "archive"), {"side": "archived"}),
            (live & c("have_rev").isNull(), {}),
            (live & deleting & visible & ~known, {"error": missing}),
            (live & deleting & visible & (c("head_type") == "binary") & (c("file_size") != c("disk_size")), {"class": "reopen_edit"}),
            (live & deleting & visible & no_digest, {"error": F.concat(F.lit("rule 1: no digest for type "), c("head_type"))}),
            (live & deleting & visible, {"pending": "revert_delete"}),
            (live & deleting, {}),
            (live & ~on_disk & _is(c("action").isin("edit", "integrate")), {"class": "reopen_delete"}),
            (live & ~on_disk & c("action").isNull(), {"class": "delete"}),
            (live & (c("action").isNull() | c("action").isin("edit", "integrate")), {}),
            (live, {"error": F.concat(F.lit("rule 2: opened for "), c("action"))}),
            (c("head_action").isNull() & _is(c("action").isin(*ADDING)) & ~visible, {"class": "revert_add"}),
            (c("head_action").isNull() & _is(c("action").isin(*ADDING)), {}),
            (c("head_action").isNull(), {"error": F.concat(F.lit("rule 3: no head and opened for "), F.coalesce(c("action"), F.lit("nothing")))}),
            (F.lit(True), {"error": F.concat(F.lit("rule 4: head action "), c("head_action"))}),
        )
    )


def workspace_pass(workspace: DataFrame, winners: DataFrame) -> DataFrame:
    """Every visible file against the record that its path stands for."""
    c = F.col
    w = workspace.where(~F.col("filtered")).select(c("path_key").alias("client_key"), c("path").alias("local"), c("size").alias("disk_size"), "mtime", "filtered")
    at = w.join(winners.withColumn("known", F.lit(True)), "client_key", "left")
    no_type = _is(c("head_type").isin("apple", "resource"))
    known = c("head_type").isNotNull() & c("file_size").isNotNull()
    differs = known & (c("head_type") == "binary") & (c("file_size") != c("disk_size"))
    deleted = is_deleted_action(c("head_action"))
    return _decided(
        at,
        *(
            (c("known").isNull(), {"class": "add"}),
            (c("unsupported_type").isNotNull(), {}),
            (no_type, {"side": "handoff"}),
            (c("head_action").isNull() | (c("head_action") == "archive"), {}),
            (deleted & _is(c("action").isin(*ADDING)), {}),
            (deleted & c("action").isNull(), {"class": "add"}),
            (deleted, {"error": F.concat(F.lit("rule 5: deleted head and opened for "), c("action"))}),
            (c("have_rev").isNull(), {"side": "unsynced"}),
            (_is(c("action") == "integrate") | _is(c("action").isin(*DELETED)), {}),
            (_is(c("action") == "edit") & ~known, {"error": F.concat(F.lit("rule 6: "), missing_fields(c("head_type"), c("file_size")))}),
            (_is(c("action") == "edit") & differs, {}),
            (_is(c("action") == "edit"), {"pending": "revert_edit"}),
            (c("action").isNull() & ~known, {}),
            (c("action").isNull() & differs, {"class": "edit"}),
            (c("action").isNull(), {"pending": "edit"}),
            (F.lit(True), {"error": F.concat(F.lit("rule 7: opened for "), c("action"))}),
        )
    )


_ROW = ["seq", "depot_file", "client_file", "client_key", "head_type", "head_rev", "have_rev", "action", "disk_size", "mtime", "digest", *_OUT]


def classify_open(depot: DataFrame, workspace: DataFrame) -> DataFrame:
    """Classified rows of the open decision table. A record and a file can each report; one row a (file, outcome) stays,
    and it carries the facts of the record that the path stands for."""
    marked = mark_winners(depot)
    first = depot_pass(marked, workspace).where(F.coalesce(*[F.col(x) for x in _OUT]).isNotNull())
    second = workspace_pass(workspace, marked.where("winner").drop("winner")).where(F.coalesce(*[F.col(x) for x in _OUT]).isNotNull())
    second = second.withColumn("client_file", F.coalesce("client_file", "local")).withColumn("winner", F.lit(True))
    both = first.select(*_ROW, "winner").unionByName(second.select(*_ROW, "winner"))
    keys = ["client_key", *_OUT]
    rest = [x for x in both.columns if x not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(~F.col("winner"), "seq")).alias("_r")).select(*keys, "_r.*").drop("winner")


def needs_content(pending: DataFrame, have: DataFrame, cache: DataFrame, verify_all: bool = False) -> DataFrame:
    """Pending rows with ``unchanged`` (by time) and ``found`` (a cached digest of exactly this size and time). What has
    neither must be read. ``verify_all`` trusts neither."""
    at = pending.join(have.select(F.col("path_key").alias("client_key"), "sync_time"), "client_key", "left")
    at = at.withColumn("unchanged", F.lit(False) if verify_all else unchanged_since_sync(F.col("mtime"), F.col("sync_time")))
    hit = cache.select(F.col("path_key").alias("client_key"), F.col("size").alias("disk_size"), "mtime", F.col("digest").alias("found"))
    if verify_all:
        return at.withColumn("found", F.lit(None).cast("string"))
    return at.join(hit, ["client_key", "disk_size", "mtime"], "left")


def fresh_digests(todo: DataFrame, content: DataFrame, link_targets: bool = False) -> DataFrame:
    """(client_key, computed) of rows to read. ``content``: (client_key, content[, link_target])."""
    link = F.col("link_target") if link_targets else None
    return todo.select("client_key", "head_type").distinct().join(content, "client_key").select("client_key", digest(F.col("content"), F.col("head_type"), link).alias("computed"))


def resolve_digests(classified: DataFrame, have: DataFrame, cache: DataFrame, computed: DataFrame, verify_all: bool = False) -> DataFrame:
    """Final rows: pending comparisons decided by time, then cached digest, then computed digest. ``computed``:
    (client_key, computed) of at least the rows that need it. A comparison without expected or actual digest is an error,
    never equality. All rows go one way, so the classification is computed once; ``have``, ``cache`` and ``computed`` have
    one row a file at most."""
    c = F.col
    waits = c("pending").isNotNull()
    at = needs_content(classified, have, cache, verify_all).join(computed, "client_key", "left")
    actual = F.coalesce("found", "computed")
    same = F.when(c("unchanged"), F.lit(True)).otherwise(actual == c("digest"))
    verdict = (
        F.when((c("pending") == "edit") & ~same, "edit")
        .when((c("pending") == "revert_edit") & same, "revert_edit")
        .when((c("pending") == "revert_delete") & same, "revert_delete")
        .when((c("pending") == "revert_delete") & ~same, "reopen_edit")
        .when((c("pending") == "revert") & ~same, "revert")
    )
    wrong = F.when(~c("unchanged") & c("digest").isNull(), F.lit("no expected digest")).when(~c("unchanged") & actual.isNull(), F.lit("content not read"))
    done = at.withColumns({"class": F.when(~waits, c("class")).when(wrong.isNull(), verdict), "error": F.when(waits, wrong).otherwise(c("error"))})
    return done.where(~waits | c("class").isNotNull() | c("error").isNotNull()).select(*classified.columns)


def classify_sync(depot: DataFrame, workspace: DataFrame, target: DataFrame) -> DataFrame:
    """Classified rows of a forced sync, per depot record, first rule wins; the target is looked up by exact path."""
    c = F.col
    w = workspace.select(c("path_key").alias("client_key"), c("path").alias("local"), c("size").alias("disk_size"), "mtime", "filtered")
    t = target.select("depot_file", c("rev").alias("target_rev"), c("action").alias("target_action"))
    at = mark_winners(depot).join(t, "depot_file", "left").join(w, "client_key", "left")
    on_disk = c("local").isNotNull()
    gone = c("target_rev").isNull() | is_deleted_action(c("target_action"))
    known = c("head_type").isNotNull() & c("file_size").isNotNull()
    out = _decided(
        at,
        *(
            (c("action").isNotNull(), {}),
            (~c("winner"), {}),
            (c("unsupported_type").isNotNull(), {"side": "handoff"}),
            (gone & on_disk, {"class": "delete"}),
            (gone, {}),
            (_is(c("target_action") == "archive"), {"side": "archived"}),
            (~on_disk, {"class": "restore"}),
            (~c("have_rev").eqNullSafe(c("target_rev")), {"class": "update"}),
            (~known, {"error": missing_fields(c("head_type"), c("file_size"))}),
            (_is(c("head_type") == "binary") & (c("file_size") != c("disk_size")), {"class": "revert"}),
            (digest_type(c("head_type")).isNull(), {"side": "handoff"}),
            (F.lit(True), {"pending": "revert"}),
        )
    )
    return out.where(F.coalesce(*[F.col(x) for x in _OUT]).isNotNull()).select(*_ROW, "target_rev")


def project_clean(open_rows: DataFrame) -> DataFrame:
    """Open classes to what brings the disk back: add becomes delete, edit revert, delete restore; the rest is dropped.
    Rows opened in the store drop out before any content is read for them."""
    to = F.create_map(*[F.lit(x) for x in ("add", "delete", "edit", "revert", "delete", "restore")])
    rows = open_rows.where(F.coalesce(F.col("pending"), F.lit("edit")) == "edit")
    return rows.withColumn("class", F.element_at(to, F.col("class"))).where(F.coalesce("class", "pending", "side", "error").isNotNull())


def native_parity(open_rows: DataFrame) -> DataFrame:
    """Without the revert groups: revert_add and revert_edit go, revert_delete becomes reopen_edit."""
    rows = open_rows.where(~F.coalesce(F.col("class").isin("revert_add", "revert_edit"), F.lit(False)))
    return rows.withColumn("class", F.when(F.col("class") == "revert_delete", "reopen_edit").otherwise(F.col("class")))


def map_new_paths(rows: DataFrame, view_map: DataFrame) -> DataFrame:
    """Adds with their depot path: unmapped paths go, a path without mapping is an error when the plan is applied."""
    v = view_map.select(F.col("path_key").alias("client_key"), F.col("depot_file").alias("mapped"), "unmapped")
    adds = rows.where(F.col("class") == "add").join(v, "client_key", "left").where(~F.coalesce("unmapped", F.lit(False)))
    adds = adds.withColumns({"error": F.coalesce("error", F.when(F.coalesce("depot_file", "mapped").isNull(), F.lit("no mapping"))), "depot_file": F.coalesce("depot_file", "mapped")})
    return rows.where(~F.coalesce(F.col("class") == "add", F.lit(False))).unionByName(adds.select(*rows.columns))


def to_plan(rows: DataFrame, mode: str, applied: bool = False, force: bool = False) -> DataFrame:
    """Plan rows; files that only the store can handle are class handoff and name what it should do with them."""
    c = F.col
    verb = {"open": "reconcile", "clean": "clean", "sync": "sync"}[mode]
    handed = c("side") == "handoff"
    class_ = F.when(handed, "handoff").otherwise(c("class"))
    rev = c("target_rev") if "target_rev" in rows.columns else c("have_rev")
    return rows.where(class_.isNotNull()).select(
        F.lit(mode).alias("mode"), class_.alias("class"), F.when(handed, F.lit(verb)).otherwise(action_for(F.lit(mode), class_)).alias("action"), "depot_file", "client_file",
        F.when(~class_.isin("add", "untracked") | (F.lit(mode) == "clean") & (class_ == "restore"), rev).alias("rev"), F.lit(applied).alias("applied"), F.lit(force).alias("force"),
        F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("native_action"), F.when(handed, F.lit(verb)).alias("handoff"),
    )


def side_report(rows: DataFrame, side: str) -> DataFrame:
    """Files that are reported without a change: unsynced, archived or handoff."""
    return rows.where(F.col("side") == side).select("depot_file", "client_file")
