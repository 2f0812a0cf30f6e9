"""Registered queries of the engine, each with DuckDB SQL that says the same independently.

Every query runs an operator of the library over snapshots derived from whole given tables (``sylva.fixtures``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import fixtures
from sylva.functions import digests, kinds, messages, paths
from sylva.operators import audit, batching, containment, feed, guards, ignore, pruning, scope, snapshots, untracked
from sylva.plans import classify
from sylva.plans.reconcile import PlanResult, Tables, reconcile
from sylva.sources import content, inventory, records, sinks
from sylva.sources.tables import running, small_batches, stored

TABLES = ("documents", "orders", "lineitem", "events", "pages", "customer")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Snapshots:
    """The derived tables of one scale directory, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, views: list[str], statement: str) -> DataFrame:
        for name in TABLES:
            if any(name in fixtures.VIEWS[v] for v in fixtures.needed(views)):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(fixtures.with_views(views, statement))

    def view(self, name: str) -> DataFrame:
        return self.sql([f"fx_{name}"], f"SELECT * FROM fx_{name}")

    @property
    def depot(self) -> DataFrame:
        head, unsupported = kinds.parse_file_type(F.col("raw_type"))
        return self.view("depot").withColumns({"head_type": head, "unsupported_type": unsupported}).drop("raw_type")

    @property
    def workspace(self) -> DataFrame:
        return self.view("workspace").withColumn("mtime", F.timestamp_seconds("mtime_s")).drop("mtime_s")

    @property
    def computed(self) -> DataFrame:
        return self.view("workspace").select(F.col("path_key").alias("client_key"), F.col("digest").alias("computed"))

    @property
    def no_cache(self) -> DataFrame:
        return inventory.empty(self.spark, "path_key string, size long, mtime timestamp, digest string")


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a function of Snapshots under its name, with its oracle."""

    def register(f: Callable[[Snapshots], DataFrame]) -> Callable[[Snapshots], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Snapshots(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = fixtures.with_views(list(views), sql) if views else sql
        return f

    return register


# ---- classification ---------------------------------------------------------------------------------------------------

_TYPED = """SELECT d.*, CASE WHEN raw_type = 'futuretype' THEN raw_type END AS unsupported_type,
  CASE WHEN raw_type LIKE 'binary%' THEN 'binary' WHEN raw_type LIKE 'text%' THEN 'text' WHEN raw_type LIKE 'utf16%' THEN 'utf16' WHEN raw_type LIKE 'apple%' THEN 'apple' END AS head_type FROM fx_depot d"""
_OPEN = f"""dep AS ({_TYPED}),
p1 AS (SELECT d.depot_file, d.client_file, d.client_key, d.have_rev, d.digest, w.digest AS actual, w.mtime_s,
  CASE WHEN unsupported_type IS NOT NULL THEN 'side handoff' WHEN head_action = 'delete' THEN NULL WHEN head_action = 'archive' THEN 'side archived'
       WHEN head_action = 'edit' AND have_rev IS NULL THEN NULL
       WHEN head_action = 'edit' AND action = 'delete' AND w.path IS NOT NULL AND NOT w.filtered THEN CASE WHEN head_type = 'binary' AND file_size <> w.size THEN 'class reopen_edit' ELSE 'pending revert_delete' END
       WHEN head_action = 'edit' AND action = 'delete' THEN NULL
       WHEN head_action = 'edit' AND w.path IS NULL AND action = 'edit' THEN 'class reopen_delete'
       WHEN head_action = 'edit' AND w.path IS NULL AND action IS NULL THEN 'class delete'
       WHEN head_action IS NULL AND action = 'add' AND (w.path IS NULL OR w.filtered) THEN 'class revert_add' END AS outcome
  FROM dep d LEFT JOIN fx_workspace w ON w.path_key = d.client_key),
p2 AS (SELECT d.depot_file, coalesce(d.client_file, w.path) AS client_file, w.path_key AS client_key, d.have_rev, d.digest, w.digest AS actual, w.mtime_s,
  CASE WHEN d.client_key IS NULL THEN 'class add' WHEN unsupported_type IS NOT NULL THEN NULL WHEN head_type = 'apple' THEN 'side handoff'
       WHEN head_action IS NULL OR head_action = 'archive' THEN NULL WHEN head_action = 'delete' AND action IS NULL THEN 'class add'
       WHEN have_rev IS NULL THEN 'side unsynced' WHEN action = 'delete' THEN NULL
       WHEN action = 'edit' THEN CASE WHEN head_type = 'binary' AND file_size <> w.size THEN NULL ELSE 'pending revert_edit' END
       WHEN head_type = 'binary' AND file_size <> w.size THEN 'class edit' ELSE 'pending edit' END AS outcome
  FROM fx_workspace w LEFT JOIN dep d ON w.path_key = d.client_key WHERE NOT w.filtered),
classified AS (SELECT * FROM p1 WHERE outcome IS NOT NULL UNION SELECT * FROM p2 WHERE outcome IS NOT NULL),
timed AS (SELECT c.*, coalesce(abs(c.mtime_s - h.sync_time) <= 1, false) OR c.actual = c.digest AS same FROM classified c LEFT JOIN fx_have h ON h.path_key = c.client_key),
decided AS (SELECT *, CASE outcome WHEN 'pending edit' THEN CASE WHEN NOT same THEN 'edit' END WHEN 'pending revert_edit' THEN CASE WHEN same THEN 'revert_edit' END
  WHEN 'pending revert_delete' THEN CASE WHEN same THEN 'revert_delete' ELSE 'reopen_edit' END ELSE CASE WHEN outcome LIKE 'class %' THEN substr(outcome, 7) END END AS class,
  CASE WHEN outcome LIKE 'side %' THEN substr(outcome, 6) END AS side FROM timed)"""
_SNAPSHOT = ("fx_depot", "fx_workspace", "fx_have")
_WORDS = "CASE WHEN class IN ('reopen_edit') THEN 'edit' WHEN class = 'reopen_delete' THEN 'delete' WHEN class LIKE 'revert%' THEN 'revert' ELSE class END"


def _open_sql(select: str) -> str:
    return fixtures.with_views(list(_SNAPSHOT), "").rstrip() + ",\n" + _OPEN + "\n" + select


def _register_open(name: str, select: str, f: Callable[[Snapshots], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(Snapshots(spark, sf_dir))
    ORACLE_SQL[name] = _open_sql(select)


def open_rows(s: Snapshots) -> DataFrame:
    rows = classify.classify_open(s.depot, s.workspace)
    return classify.resolve_digests(rows, s.view("have"), s.no_cache, s.computed)


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("class", "side").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _open_plan(s: Snapshots, parity: bool = False) -> DataFrame:
    rows = open_rows(s)
    plan = classify.to_plan(classify.native_parity(rows) if parity else rows, "open")
    return plan.where("class <> 'handoff'").select("class", "action", "client_file", "depot_file", "rev")


_register_open("open_class_counts", "SELECT coalesce(class, side) AS class, count(*) AS n FROM decided WHERE class IS NOT NULL OR side IS NOT NULL GROUP BY 1", lambda s: _counts(open_rows(s)))
_register_open(
    "open_plan",
    f"SELECT class, {_WORDS} AS action, client_file, depot_file, CASE WHEN class <> 'add' THEN have_rev END AS rev FROM decided WHERE class IS NOT NULL",
    _open_plan,
)
_register_open(
    "open_plan_native_parity",
    f"SELECT class, {_WORDS} AS action, client_file, depot_file, CASE WHEN class <> 'add' THEN have_rev END AS rev FROM (SELECT client_file, depot_file, have_rev, CASE WHEN class = 'revert_delete' THEN 'reopen_edit' ELSE class END AS class FROM decided WHERE class NOT IN ('revert_add', 'revert_edit')) t",
    partial(_open_plan, parity=True),
)


def _clean_plan(s: Snapshots) -> DataFrame:
    rows = classify.project_clean(classify.classify_open(s.depot, s.workspace))
    rows = classify.resolve_digests(rows, s.view("have"), s.no_cache, s.computed)
    rows = rows.withColumn("class", F.when(F.col("class") == "edit", "revert").otherwise(F.col("class")))
    return classify.to_plan(rows, "clean").where("class <> 'handoff'").select("class", "action", "client_file", "rev")


_register_open(
    "clean_plan",
    "SELECT CASE class WHEN 'add' THEN 'delete' WHEN 'edit' THEN 'revert' ELSE 'restore' END AS class, CASE class WHEN 'add' THEN 'deleting' WHEN 'edit' THEN 'reverting' ELSE 'restoring' END AS action, client_file, have_rev AS rev FROM decided WHERE class IN ('add', 'edit', 'delete')",
    _clean_plan,
)
_register_open(
    "handoff_rows",
    "SELECT 'reconcile' AS handoff, client_file, depot_file FROM decided WHERE side = 'handoff'",
    lambda s: classify.to_plan(open_rows(s), "open").where("class = 'handoff'").select("handoff", "client_file", "depot_file"),
)
_register_open("side_reports", "SELECT side, client_file FROM decided WHERE side IN ('unsynced', 'archived')", lambda s: open_rows(s).where("side IN ('unsynced', 'archived')").select("side", "client_file"))
_register_open(
    "timestamp_stats",
    "SELECT * FROM (SELECT CASE WHEN grouping(outcome) = 0 THEN substr(outcome, 9) END AS \"group\", count(*) AS candidates, count(CASE WHEN abs(mtime_s - sync_time) <= 1 THEN 1 END) AS skipped, CAST(floor(100 * count(CASE WHEN abs(mtime_s - sync_time) <= 1 THEN 1 END) / count(*)) AS BIGINT) AS percent FROM classified c LEFT JOIN fx_have h ON h.path_key = c.client_key WHERE outcome LIKE 'pending%' GROUP BY ROLLUP (outcome)) t",
    lambda s: audit.timestamp_stats(classify.classify_open(s.depot, s.workspace).where("pending IS NOT NULL"), s.view("have")),
)
_register_open(
    "summary_row",
    "SELECT 'open' AS mode, true AS ok, count(*) AS total, count(CASE WHEN class = 'add' THEN 1 END) AS n_add, count(CASE WHEN class = 'edit' THEN 1 END) AS n_edit FROM decided WHERE class IS NOT NULL",
    lambda s: audit.summarize(classify.to_plan(open_rows(s), "open"), inventory.empty(s.spark, "a int"), "open").select("mode", "ok", "total", F.coalesce(F.col("counts")["add"], F.lit(0)).alias("n_add"), F.coalesce(F.col("counts")["edit"], F.lit(0)).alias("n_edit")),
)
_register_open(
    "plan_lines",
    "SELECT class, CASE WHEN class = 'add' THEN NULL ELSE CAST(have_rev AS STRING) END AS rev, client_file AS \"clientFile\" FROM decided WHERE class IS NOT NULL",
    lambda s: sinks.plan_lines(classify.to_plan(open_rows(s), "open")).select(F.get_json_object("value", "$.class").alias("class"), F.get_json_object("value", "$.rev").alias("rev"), F.get_json_object("value", "$.clientFile").alias("clientFile")),
)
_register_open(
    "listing",
    "SELECT initcap_class || ' \"' || client_file || '\".' AS line FROM (SELECT CASE class WHEN 'add' THEN 'Add' WHEN 'edit' THEN 'Edit' WHEN 'delete' THEN 'Delete' WHEN 'reopen_edit' THEN 'Reopen Edit' WHEN 'reopen_delete' THEN 'Reopen Delete' WHEN 'revert_add' THEN 'Revert Add' WHEN 'revert_edit' THEN 'Revert Edit' ELSE 'Revert Delete' END AS initcap_class, client_file FROM decided WHERE class IS NOT NULL) t",
    lambda s: sinks.listing(classify.to_plan(open_rows(s), "open").where("class <> 'handoff'"), "open").where("place <> ''").select("line"),
)
_register_open(
    "hash_stats",
    "SELECT count(*) AS files, 0 AS cache_hits, CAST(coalesce(sum(w.size), 0) AS BIGINT) AS bytes_hashed FROM classified c LEFT JOIN fx_have h ON h.path_key = c.client_key JOIN fx_workspace w ON w.path_key = c.client_key WHERE outcome LIKE 'pending%' AND NOT coalesce(abs(c.mtime_s - h.sync_time) <= 1, false)",
    lambda s: audit.hash_stats(classify.needs_content(classify.classify_open(s.depot, s.workspace).where("pending IS NOT NULL"), s.view("have"), s.no_cache)),
)

_SYNC = f"""dep AS ({_TYPED}),
sync AS (SELECT d.*, t.rev AS target_rev, w.digest AS actual, w.mtime_s, h.sync_time,
  CASE WHEN d.action IS NOT NULL THEN NULL WHEN unsupported_type IS NOT NULL THEN 'side handoff'
       WHEN t.rev IS NULL OR t.action = 'delete' THEN CASE WHEN w.path IS NOT NULL THEN 'class delete' END
       WHEN t.action = 'archive' THEN 'side archived' WHEN w.path IS NULL THEN 'class restore'
       WHEN d.have_rev IS DISTINCT FROM t.rev THEN 'class update' WHEN head_type = 'binary' AND file_size <> w.size THEN 'class revert'
       WHEN head_type = 'apple' THEN 'side handoff' WHEN coalesce(abs(w.mtime_s - h.sync_time) <= 1, false) OR w.digest = d.digest THEN NULL ELSE 'class revert' END AS outcome
  FROM dep d LEFT JOIN fx_target t ON t.depot_file = d.depot_file LEFT JOIN fx_workspace w ON w.path_key = d.client_key LEFT JOIN fx_have h ON h.path_key = d.client_key)"""


def _sync_rows(s: Snapshots, verify_all: bool = False) -> DataFrame:
    rows = classify.classify_sync(s.depot, s.workspace, s.view("target"))
    return classify.resolve_digests(rows, s.view("have"), s.no_cache, s.computed, verify_all)


def _register_sync(name: str, select: str, f: Callable[[Snapshots], DataFrame], base: str = _SYNC) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(Snapshots(spark, sf_dir))
    ORACLE_SQL[name] = fixtures.with_views([*_SNAPSHOT, "fx_target"], "").rstrip() + ",\n" + base + "\n" + select


_register_sync(
    "sync_head_plan",
    "SELECT substr(outcome, 7) AS class, client_file, target_rev AS rev FROM sync WHERE outcome LIKE 'class %'",
    lambda s: classify.to_plan(_sync_rows(s), "sync", force=True).where("class <> 'handoff'").select("class", "client_file", "rev"),
)
_register_sync(
    "sync_verify_all_plan",
    "SELECT substr(outcome, 7) AS class, client_file, target_rev AS rev FROM sync WHERE outcome LIKE 'class %'",
    lambda s: classify.to_plan(_sync_rows(s, True), "sync", force=True).where("class <> 'handoff'").select("class", "client_file", "rev"),
    _SYNC.replace("coalesce(abs(w.mtime_s - h.sync_time) <= 1, false) OR w.digest = d.digest", "w.digest = d.digest"),
)
_register_sync("sync_class_counts", "SELECT substr(outcome, strpos(outcome, ' ') + 1) AS class, count(*) AS n FROM sync WHERE outcome IS NOT NULL GROUP BY 1", lambda s: _counts(_sync_rows(s)))
_register_sync(
    "export_specs",
    "SELECT client_file, CASE WHEN outcome = 'class delete' THEN depot_file || '#none' ELSE depot_file || '#' || target_rev END AS spec FROM sync WHERE outcome LIKE 'class %'",
    lambda s: sinks.export_specs(classify.to_plan(_sync_rows(s), "sync", force=True).where("class <> 'handoff'")).select("client_file", "spec"),
)
_register_sync(
    "unsynced_restore_guard",
    "SELECT count(CASE WHEN outcome = 'class restore' AND have_rev IS NULL THEN 1 END) AS never_synced, count(have_rev) AS synced, false AS refuse FROM sync",
    lambda s: guards.first_download_counts(_sync_rows(s), s.depot),
)
_register_sync(
    "risk_counts",
    "SELECT count(CASE WHEN outcome = 'class update' AND have_rev IS NULL THEN 1 END) AS never_synced_updates, count(CASE WHEN outcome = 'class delete' AND have_rev IS NULL THEN 1 END) AS never_synced_deletes FROM sync",
    lambda s: audit.risk_counts(_sync_rows(s), s.workspace),
)

# ---- snapshots --------------------------------------------------------------------------------------------------------


@query("SELECT client_key, seq, depot_file FROM (SELECT *, row_number() OVER (PARTITION BY client_key ORDER BY coalesce(head_action = 'delete', false), have_rev IS NULL, seq) AS r FROM fx_collisions) t WHERE r = 1", ("fx_collisions",))
def winner_selection(s: Snapshots) -> DataFrame:
    return snapshots.pick_winner(s.view("collisions")).select("client_key", "seq", "depot_file")


@query("SELECT min(seq) AS seq, depot_file FROM (SELECT seq, depot_file FROM fx_collisions UNION ALL SELECT seq + 5, depot_file FROM fx_collisions) t GROUP BY depot_file", ("fx_collisions",))
def dedupe_first(s: Snapshots) -> DataFrame:
    rows = s.view("collisions").select("seq", "depot_file")
    return snapshots.dedupe_records(rows.unionByName(rows.withColumn("seq", F.col("seq") + 5)))


_AS_OF = "SELECT depot_file, rev, action FROM (SELECT *, row_number() OVER (PARTITION BY depot_file ORDER BY rev DESC) AS r FROM fx_revisions WHERE {}) t WHERE r = 1"


@query(_AS_OF.format("change <= 5000"), ("fx_revisions",))
def snapshot_as_of(s: Snapshots) -> DataFrame:
    return snapshots.snapshot_as_of(s.view("revisions"), 5000)


@query(_AS_OF.format("true"), ("fx_revisions",))
def snapshot_head(s: Snapshots) -> DataFrame:
    return snapshots.snapshot_as_of(s.view("revisions"))


_AGE = "SELECT f.depot_file, CASE WHEN have_rev <> head_rev THEN 'utf8' ELSE head_type END AS head_type, CASE WHEN have_rev <> head_rev THEN 7 ELSE file_size END AS file_size FROM dep f"


@query(f", dep AS ({_TYPED})\n{_AGE}", ())
def baseline_refresh(s: Snapshots) -> DataFrame:
    depot = s.depot
    base = depot.where("have_rev <> head_rev").select("depot_file", F.col("have_rev").alias("rev"), F.lit("edit").alias("action"), F.lit("utf8").alias("head_type"), F.lit(7).cast("long").alias("file_size"), F.lit("0").alias("digest"))
    base = base.withColumn("depot_file", F.when(F.crc32("depot_file") % 2 == 0, F.upper("depot_file")).otherwise(F.col("depot_file")))
    return snapshots.refresh_baselines(depot, base).select("depot_file", "head_type", "file_size")


ORACLE_SQL["baseline_refresh"] = fixtures.with_views(["fx_depot"], "").rstrip() + f", dep AS ({_TYPED})\n{_AGE}"


@query("SELECT seq, depot_file FROM fx_depot WHERE head_rev IS NOT NULL AND head_action IS NOT NULL", ("fx_depot",))
def head_target(s: Snapshots) -> DataFrame:
    return snapshots.head_target(s.depot).join(s.depot.select("seq", "depot_file"), "depot_file").select("seq", "depot_file")


@query("SELECT path_key, size FROM fx_workspace", ("fx_workspace",))
def union_inventories(s: Snapshots) -> DataFrame:
    w = s.workspace
    return snapshots.union_inventories(w.where("size % 2 = 0"), w.where("size % 3 <> 1"), w).select("path_key", "size")


# ---- digests ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(replace(text, chr(10), chr(13) || chr(10))) AS raw, md5(text) AS normal FROM documents")
def digest_text_md5(s: Snapshots) -> DataFrame:
    """Text with CR LF line ends has the fingerprint of the text with LF."""
    crlf = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")
    return s.table("documents").select("doc_id", digests.digest_binary(crlf).alias("raw"), digests.digest_text(crlf).alias("normal"))


@query("SELECT doc_id, d AS bom8, d AS le, d AS be FROM (SELECT doc_id, md5(replace(text, chr(13) || chr(10), chr(10))) AS d FROM documents) t")
def digest_utf8_boms(s: Snapshots) -> DataFrame:
    """UTF-8 and both UTF-16 byte orders with a mark have the fingerprint of the plain text with LF line ends."""
    mark = lambda bom, charset: F.concat(F.unhex(F.lit(bom)), F.encode("text", charset))
    of = digests.digest_utf8
    small_batches(s.spark)  # UTF-16 leaves the JVM
    return s.table("documents").select("doc_id", of(mark("EFBBBF", "UTF-8")).alias("bom8"), of(mark("FFFE", "UTF-16LE")).alias("le"), of(mark("FEFF", "UTF-16BE")).alias("be"))


@query("SELECT path_key, coalesce(abs(mtime_s - sync_time) <= 1, false) AS unchanged FROM fx_workspace LEFT JOIN fx_have USING (path_key)", ("fx_workspace", "fx_have"))
def timestamp_shortcut(s: Snapshots) -> DataFrame:
    at = s.workspace.join(s.view("have"), "path_key", "left")
    return at.select("path_key", digests.unchanged_since_sync(F.col("mtime"), F.col("sync_time")).alias("unchanged"))


@query("SELECT path_key AS client_key, CASE WHEN size % 3 = 0 THEN digest END AS found FROM fx_workspace", ("fx_workspace",))
def cache_hits(s: Snapshots) -> DataFrame:
    """A third of the cache is current, a third has another time, a third another size."""
    w = s.workspace
    cache = w.select("path_key", F.when(F.col("size") % 3 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("size") % 3 == 2, F.col("mtime") + F.expr("interval 1 microsecond")).otherwise(F.col("mtime")).alias("mtime"), "digest")
    pending = w.select(F.col("path_key").alias("client_key"), F.col("size").alias("disk_size"), "mtime")
    return classify.needs_content(pending, s.view("have"), cache).select("client_key", "found")


@query("SELECT path_key, CASE WHEN size % 2 = 0 THEN 'fresh' ELSE digest END AS digest FROM fx_workspace", ("fx_workspace",))
def merge_cache(s: Snapshots) -> DataFrame:
    w = s.workspace.select("path_key", "size", "mtime", "digest")
    return inventory.merge_digest_cache(w, w.where("size % 2 = 0").withColumn("digest", F.lit("fresh"))).select("path_key", "digest")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, text, false AS replaced FROM documents")
def decode_charset(s: Snapshots) -> DataFrame:
    """All texts as UTF-8; ``decode_charset_all`` has the fallback, too."""
    small_batches(s.spark)
    got = s.table("documents").select("doc_id", digests.decode_charset(F.encode("text", "UTF-8"), "utf8").alias("d"))
    return got.select("doc_id", "d.text", "d.replaced")


@query()
def decode_charset_all(s: Snapshots) -> DataFrame:
    """All documents: a quarter in Windows-1252 (other characters as ?), a quarter as UTF-8 and a byte that neither
    charset has, the rest as UTF-8. SQL can't encode Windows-1252, so tests compare with brute force."""
    small_batches(s.spark)
    high = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(128, 160)]
    marks, bytes_ = "".join(c for _, c in high), "".join(b for b, c in high if c)
    known = F.translate(F.regexp_replace("text", rf"[^\x00-\x7F\xA0-\xFF{marks}]", "?"), marks, bytes_)
    cp1252 = F.encode(F.when(F.col("text").rlike(r"[^\x00-\x7F\xA0-\xFF]"), known).otherwise(F.col("text")), "ISO-8859-1")
    utf8, quarter = F.encode("text", "UTF-8"), F.pmod("doc_id", F.lit(4))
    raw = F.when(quarter == 0, cp1252).when(quarter == 1, F.concat(utf8, F.unhex(F.lit("81")))).otherwise(utf8)
    got = s.table("documents").select("doc_id", digests.decode_charset(raw, "utf8").alias("d"))
    return got.select("doc_id", "d.text", "d.replaced")


# ---- scope ------------------------------------------------------------------------------------------------------------

_IN = "(path_key LIKE '/ws/src1/%' OR path_key LIKE '/ws/src2/en/%' OR path_key = '/ws/src3/en/d3.txt')"


@query(f"SELECT path_key FROM fx_workspace WHERE {_IN}", ("fx_workspace",))
def scope_include(s: Snapshots) -> DataFrame:
    return containment.scope_filter(s.workspace, s.view("scope"), "path_key").select("path_key")


@query("SELECT path_key FROM fx_workspace WHERE path_key NOT LIKE '/ws/src1/fr/%'", ("fx_workspace",))
def scope_exclude(s: Snapshots) -> DataFrame:
    return containment.scope_exclude(s.workspace, s.view("scope"), "path_key").select("path_key")


@query(f"SELECT path_key, {_IN} AND path_key NOT LIKE '/ws/src1/fr/%' AS in_scope FROM fx_workspace", ("fx_workspace",))
def in_scope(s: Snapshots) -> DataFrame:
    return containment.in_scope(s.workspace, s.view("scope"), "path_key").select("path_key", "in_scope")


@query("SELECT kind, key FROM fx_scope WHERE role = 'include' AND NOT EXISTS (SELECT 1 FROM (SELECT client_key AS p FROM fx_depot UNION ALL SELECT path_key FROM fx_workspace) s WHERE p = key OR (kind = 'dir' AND p LIKE key || '/%'))", ("fx_scope", "fx_depot", "fx_workspace"))
def unmatched_entries(s: Snapshots) -> DataFrame:
    return containment.unmatched_entries(s.view("scope"), s.depot, s.workspace).select("kind", "key")


_DIRS = "SELECT DISTINCT '/ws/' || source AS key FROM documents UNION SELECT DISTINCT '/ws/' || source || '/' || lang FROM documents WHERE doc_id % 3 = 0 UNION SELECT '/ws/other/' || o_orderpriority FROM orders"


@query(f"SELECT key FROM ({_DIRS}) a WHERE NOT EXISTS (SELECT 1 FROM ({_DIRS}) b WHERE a.key LIKE b.key || '/%')")
def scope_topmost(s: Snapshots) -> DataFrame:
    d = s.table("documents")
    keys = d.select(F.concat(F.lit("/ws/"), "source").alias("key")).union(d.where("doc_id % 3 = 0").select(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang"))).union(s.table("orders").select(F.concat(F.lit("/ws/other/"), "o_orderpriority"))).distinct()
    return containment.topmost(keys.withColumn("kind", F.lit("dir"))).select("key")


_TOPS = "SELECT DISTINCT '/ws/' || source AS key FROM documents WHERE doc_id % 4 = 0"
_LEAVES = "SELECT DISTINCT '/ws/' || source || '/' || lang AS key FROM documents"


@query(f"SELECT DISTINCT b.key FROM ({_TOPS}) a JOIN ({_LEAVES}) b ON b.key LIKE a.key || '/%'")
def scope_intersect(s: Snapshots) -> DataFrame:
    d = s.table("documents")
    entry = lambda c: [F.lit("dir").alias("kind"), c.alias("path"), c.alias("key")]
    tops = d.where("doc_id % 4 = 0").select(*entry(F.concat(F.lit("/ws/"), "source"))).distinct()
    leaves = d.select(*entry(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang"))).distinct()
    return containment.intersect(tops, leaves).select("key")


@query("SELECT path_key FROM fx_workspace WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 40 = 0 AND path_key LIKE '/ws/' || d.source || '/' || d.lang || '/%')", ("fx_workspace",))
def prune_dirs(s: Snapshots) -> DataFrame:
    pruned = s.table("documents").where("doc_id % 40 = 0").select(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang").alias("dir_key")).distinct()
    return containment.prune_dirs(s.workspace, pruned, "path_key").select("path_key")


@query("SELECT DISTINCT dir_key FROM (SELECT DISTINCT '/ws/' || source || '/' || lang AS dir_key FROM documents UNION SELECT '/ws/empty/' || o_orderpriority FROM orders) p JOIN fx_depot d ON d.client_key LIKE p.dir_key || '/%'", ("fx_depot",))
def tracked_pruned_dirs(s: Snapshots) -> DataFrame:
    pruned = s.table("documents").select(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang").alias("dir_key")).union(s.table("orders").select(F.concat(F.lit("/ws/empty/"), "o_orderpriority"))).distinct()
    return containment.tracked_pruned_dirs(pruned, s.depot)


@query("SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, 2 + count(DISTINCT split_part(path_key, '/', 3)) + count(DISTINCT split_part(path_key, '/', 3) || '/' || split_part(path_key, '/', 4)) AS dirs FROM fx_wide", ("fx_wide",))
def inventory_totals(s: Snapshots) -> DataFrame:
    return audit.inventory_totals(s.view("wide"))


@query("SELECT '/ws/' || split_part(path_key, '/', 3) AS key, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM fx_wide GROUP BY 1 UNION ALL SELECT NULL, count(*), CAST(sum(size) AS BIGINT) FROM fx_wide", ("fx_wide",))
def inventory_totals_by_entry(s: Snapshots) -> DataFrame:
    wide = s.view("wide")
    entries = wide.select(F.lit("dir").alias("kind"), F.concat(F.lit("/ws/"), F.split_part("path_key", F.lit("/"), F.lit(3))).alias("key")).distinct()
    return audit.inventory_totals_by_entry(wide, entries)


@query("SELECT dir_key, CAST(length(dir_key) - length(replace(dir_key, '/', '')) - 1 AS INTEGER) AS depth FROM (SELECT '/ws/' || split_part(path_key, '/', 3) AS dir_key FROM fx_wide UNION SELECT '/ws/' || split_part(path_key, '/', 3) || '/' || split_part(path_key, '/', 4) FROM fx_wide) t", ("fx_wide",))
def list_directories(s: Snapshots) -> DataFrame:
    return containment.list_directories(s.view("wide"), "/ws").select("dir_key", "depth")


@query("SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM fx_wide WHERE CAST(substr(split_part(path_key, '/', 3), 2) AS INTEGER) < 300 AND NOT CAST(split_part(path_key, '/', 4) AS INTEGER) % 7 = 0", ("fx_wide",))
def scope_wide(s: Snapshots) -> DataFrame:
    """600 entries over the wide inventory: beyond what a predicate should hold, so ancestors meet entries by equality."""
    wide = s.view("wide")
    top = s.spark.range(300).select(F.lit("include").alias("role"), F.lit("dir").alias("kind"), F.concat(F.lit("/ws/o"), F.col("id").cast("string")).alias("key"))
    orders = wide.where(F.split_part("path_key", F.lit("/"), F.lit(4)).cast("long") % 7 == 0).select(F.lit("exclude").alias("role"), F.lit("dir").alias("kind"), F.substring_index("path_key", "/", 4).alias("key")).distinct()
    scope = top.unionByName(orders)
    kept = containment.scope_exclude(containment.scope_filter(wide, scope, "path_key"), scope, "path_key")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# ---- untracked, ignores, guards ---------------------------------------------------------------------------------------


@query("SELECT path_key FROM fx_workspace WHERE path_key NOT IN (SELECT client_key FROM fx_depot)", ("fx_workspace", "fx_depot"))
def untracked_candidates(s: Snapshots) -> DataFrame:
    return untracked.untracked_candidates(s.workspace, s.depot).select("path_key")


_CHECK = "CASE WHEN v.depot_file IS NULL THEN 'outside_view' WHEN v.unmapped THEN 'view_excluded' WHEN d.depot_file IS NOT NULL THEN 'tracked' ELSE 'untracked' END"


@query(f"SELECT w.path_key, {_CHECK} AS verdict FROM fx_workspace w LEFT JOIN fx_view_map v USING (path_key) LEFT JOIN fx_depot d ON d.depot_file = v.depot_file", ("fx_workspace", "fx_view_map", "fx_depot"))
def untracked_cross_check(s: Snapshots) -> DataFrame:
    return untracked.cross_check(untracked.map_paths(s.workspace, s.view("view_map")), s.depot).select("path_key", "verdict")


@query("SELECT w.path_key, v.depot_file FROM fx_workspace w JOIN fx_view_map v USING (path_key) WHERE v.depot_file IS NOT NULL AND NOT v.unmapped AND w.path NOT IN (SELECT path FROM fx_verdicts WHERE ignored) AND w.path IN (SELECT path FROM fx_verdicts) AND w.path_key NOT IN (SELECT client_key FROM fx_depot)", ("fx_workspace", "fx_view_map", "fx_depot", "fx_verdicts"))
def untracked_files(s: Snapshots) -> DataFrame:
    judged = s.workspace.join(s.view("verdicts").select("path"), "path", "left_semi")
    return untracked.discover_untracked(judged, s.depot, s.view("verdicts"), s.view("view_map")).select("path_key", "depot_file")


@query("SELECT w.path, v.depot_file FROM fx_workspace w LEFT JOIN fx_view_map v USING (path_key) WHERE NOT coalesce(v.unmapped, false)", ("fx_workspace", "fx_view_map"))
def view_map_adds(s: Snapshots) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    adds = s.workspace.select(F.col("path_key").alias("client_key"), F.col("path").alias("client_file"), F.lit("add").alias("class"), none("string").alias("depot_file"), none("string").alias("error"))
    return classify.map_new_paths(adds, s.view("view_map")).select(F.col("client_file").alias("path"), "depot_file")


@query("SELECT client_file FROM fx_depot JOIN fx_verdicts ON client_file = path WHERE NOT ignored", ("fx_depot", "fx_verdicts"))
def protect_deletes(s: Snapshots) -> DataFrame:
    return guards.protect_deletes(s.depot, s.view("verdicts"))[0].select("client_file")


@query("SELECT client_file FROM fx_depot WHERE client_file NOT IN (SELECT path FROM fx_verdicts)", ("fx_depot", "fx_verdicts"))
def unjudged_deletes(s: Snapshots) -> DataFrame:
    return guards.protect_deletes(s.depot, s.view("verdicts"))[1].select("client_file")


@query("SELECT DISTINCT c.client_key, c.depot_file FROM fx_collisions c JOIN fx_target t ON t.depot_file = c.depot_file AND t.action <> 'delete' WHERE c.client_key IN (SELECT client_key FROM fx_collisions WHERE head_action = 'delete')", ("fx_collisions", "fx_target"))
def case_conflicts(s: Snapshots) -> DataFrame:
    rows = s.view("collisions")
    return guards.case_conflicts(rows.where("head_action = 'delete'"), rows, s.view("target"))


@query("SELECT w.path, coalesce(v.ignored, false) AS filtered FROM fx_workspace w LEFT JOIN fx_verdicts v USING (path)", ("fx_workspace", "fx_verdicts"))
def file_ignores(s: Snapshots) -> DataFrame:
    return ignore.apply_file_ignores(s.workspace, s.view("verdicts")).select("path", "filtered")


_LINES = f"SELECT CASE WHEN doc_id % 5 = 0 THEN {fixtures.P} || ' ignored by /ws/.p4ignore:' || doc_id || ':*.txt' WHEN doc_id % 31 = 0 THEN 'noise ' || doc_id ELSE {fixtures.P} || ' not ignored' END AS value, {fixtures.P} AS path, doc_id FROM documents"


@query(f"SELECT path, doc_id % 5 = 0 AS ignored FROM ({_LINES}) t WHERE doc_id % 5 = 0 OR doc_id % 31 <> 0")
def verdict_lines(s: Snapshots) -> DataFrame:
    s.table("documents").createOrReplaceTempView("documents")
    lines = s.spark.sql(_LINES)
    return ignore.verdicts_of(lines, lines).select("path", "ignored")


@query("SELECT count(CASE WHEN doc_id % 5 <> 0 AND doc_id % 31 = 0 THEN 1 END) AS unrecognized, 0 AS duplicated, count(CASE WHEN doc_id % 5 <> 0 AND doc_id % 31 = 0 THEN 1 END) AS missing FROM documents")
def verdict_completeness(s: Snapshots) -> DataFrame:
    s.table("documents").createOrReplaceTempView("documents")
    lines = s.spark.sql(_LINES)
    return ignore.verdict_completeness(lines, lines).select("unrecognized", "duplicated", "missing")


_RULES = "SELECT CASE WHEN doc_id % 50 = 0 THEN '#FILE /ws/' || source WHEN doc_id % 9 = 0 THEN '#LINE ' || doc_id || ':!keep' WHEN doc_id % 7 = 0 THEN '#WHAT' WHEN doc_id % 2 = 0 THEN '#LINE ' || doc_id || ':*.log' ELSE '/ws/' || source || '/...' END AS value, doc_id FROM documents"


@query("SELECT true AS saw_header, true AS has_reinclude, count(CASE WHEN doc_id % 50 <> 0 AND doc_id % 9 <> 0 AND doc_id % 7 = 0 THEN 1 END) AS unrecognized FROM documents")
def ignore_rule_summary(s: Snapshots) -> DataFrame:
    s.table("documents").createOrReplaceTempView("documents")
    return ignore.ignore_rule_summary(s.spark.sql(_RULES))


# ---- feed -------------------------------------------------------------------------------------------------------------

_FEED = f"""
SELECT doc_id AS seq, CASE WHEN doc_id % 7 IN (1, 2) THEN 'info' WHEN doc_id % 7 = 3 THEN 'error' ELSE 'stat' END AS code, {fixtures.D} AS "depotFile", {fixtures.P} AS "clientFile",
  CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'updated' ELSE 'refreshed' END AS action, CAST(1 + doc_id % 5 AS STRING) AS rev, CAST(2 AS INTEGER) AS severity,
  CASE WHEN doc_id % 7 = 1 THEN {fixtures.D} || '#' || (1 + doc_id % 5) || ' - can''t ' || CASE WHEN doc_id % 2 = 0 THEN 'update' ELSE 'delete' END || ' modified file ' || {fixtures.P}
       WHEN doc_id % 7 = 2 THEN {fixtures.D} || '#' || (1 + doc_id % 5) || ' - deleted as ' || {fixtures.P} END AS data
FROM documents
"""


def _feed(s: Snapshots) -> DataFrame:
    s.table("documents").createOrReplaceTempView("documents")
    return s.spark.sql(_FEED.replace('"', "`"))


@query(f"SELECT CASE WHEN code = 'info' THEN 'delete' WHEN action = 'added' THEN 'add' ELSE 'update' END AS class, \"depotFile\" AS depot_file, CAST(rev AS BIGINT) AS rev FROM ({_FEED}) t WHERE code = 'stat' OR seq % 7 = 2")
def feed_classes(s: Snapshots) -> DataFrame:
    f = _feed(s)
    opened = inventory.empty(s.spark, "seq long, depot_file string, client_file string, have_rev long")
    return feed.classify_feed(f, opened, s.view("target"))[0].select("class", "depot_file", "rev")


@query(f"SELECT CASE WHEN seq % 2 = 0 THEN 'update_modified' ELSE 'delete_modified' END AS reason, \"depotFile\" AS depot_file, rev, \"clientFile\" AS client_file FROM ({_FEED}) t WHERE seq % 7 = 1")
def refusals(s: Snapshots) -> DataFrame:
    return feed.notices(_feed(s))[0].select("reason", "depot_file", "rev", "client_file")


@query(f"SELECT DISTINCT CASE WHEN seq % 2 = 0 THEN 'update_modified' ELSE 'delete_modified' END AS reason, \"depotFile\" AS depot_file FROM ({_FEED}) t WHERE seq % 7 = 1")
def conflict_dedupe(s: Snapshots) -> DataFrame:
    f = _feed(s)
    return feed.notices(f.unionByName(f.withColumn("seq", F.col("seq") + 10**6)))[0].select("reason", "depot_file")


@query("SELECT d.depot_file, t.rev FROM fx_depot d JOIN fx_target t USING (depot_file) WHERE d.action = 'edit' AND d.have_rev IS DISTINCT FROM t.rev", ("fx_depot", "fx_target"))
def opened_supplement(s: Snapshots) -> DataFrame:
    opened = s.depot.where("action = 'edit'").select("seq", "depot_file", "client_file", "have_rev")
    return feed.opened_candidates(opened, s.view("target")).select("depot_file", "rev")


@query(f"SELECT \"depotFile\" AS depot_file FROM ({_FEED}) t WHERE code = 'stat' AND \"clientFile\" LIKE '/ws/src1/%' AND \"clientFile\" NOT LIKE '/ws/src1/fr/%'")
def candidate_scope(s: Snapshots) -> DataFrame:
    scope = s.view("scope").where("role = 'exclude' OR key = '/ws/src1'")
    return feed.scope_check(feed.feed_candidates(_feed(s)), scope)[0].select("depot_file")


# ---- records and text columns -----------------------------------------------------------------------------------------

_TAGGED = f"""SELECT doc_id AS seq, '... depotFile ' || {fixtures.D} || chr(10) || '... clientFile ' || {fixtures.P} || chr(10) || '... headAction edit' || chr(10) || '... headType text+w' || chr(10) || '... unknown x'
  || chr(10) || '... headRev 1' || chr(10) || '... headRev ' || (1 + doc_id % 5) || chr(10) || '... fileSize ' || length(text) || chr(10) || '... digest ' || upper(md5(text)) AS value FROM documents"""


@query(f"SELECT doc_id AS seq, {fixtures.D} AS depot_file, lower({fixtures.P}) AS client_key, 'text' AS head_type, CAST(1 + doc_id % 5 AS BIGINT) AS head_rev, CAST(length(text) AS BIGINT) AS file_size, md5(text) AS digest FROM documents")
def tagged_records(s: Snapshots) -> DataFrame:
    s.table("documents").createOrReplaceTempView("documents")
    return records.parse_tagged_blocks(s.spark.sql(_TAGGED), "macos").select("seq", "depot_file", "client_key", "head_type", "head_rev", "file_size", "digest")


@query(f"SELECT lower({fixtures.P}) AS path_key, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 1704067200 + doc_id END AS sync_time FROM documents WHERE doc_id % 4 <> 0")
def have_records(s: Snapshots) -> DataFrame:
    d = s.table("documents")
    line = lambda t, n: d.select((F.col("doc_id") + n).alias("seq"), F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 0, "error").otherwise("stat").alias("code"), F.expr(fixtures.P).alias("path"), t.alias("syncTime"))).alias("value"))
    stale = line(F.lit("17"), 0)
    fresh = line(F.when(F.col("doc_id") % 9 == 0, "soon").otherwise((F.col("doc_id") + 1704067200).cast("string")), 10**7)
    return records.parse_have(stale.unionByName(fresh), "macos")


@query(f"SELECT lower({fixtures.P}) AS path_key, {fixtures.D} AS depot_file, doc_id % 6 = 0 AS unmapped FROM documents WHERE doc_id % 10 <> 0")
def where_records(s: Snapshots) -> DataFrame:
    d = s.table("documents")
    value = F.to_json(F.struct(F.expr(fixtures.P).alias("path"), F.expr(fixtures.D).alias("depotFile"), F.when(F.col("doc_id") % 6 == 0, "").alias("unmap")))
    return records.parse_where(d.select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 10 == 0, "no json").otherwise(value).alias("value")), "macos")


@query("SELECT doc_id, '//cl/' || source || '/' || lang || '/d' || doc_id || '.txt' AS client, false AS degraded FROM documents WHERE source <> 'src5' UNION ALL SELECT doc_id, '/elsewhere/' || doc_id, true FROM documents WHERE source = 'src5'")
def client_syntax(s: Snapshots) -> DataFrame:
    path = F.when(F.col("source") == "src5", F.concat(F.lit("/elsewhere/"), F.col("doc_id").cast("string"))).otherwise(F.expr(fixtures.P))
    client, degraded = paths.client_syntax(path, "/ws", "cl")
    return s.table("documents").select("doc_id", client.alias("client"), degraded.alias("degraded"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text || '%#@*?', '%', '%25'), '#', '%23'), '@', '%40'), '*', '%2A'), '?', '%3F') AS spec FROM documents")
def escape_spec(s: Snapshots) -> DataFrame:
    return s.table("documents").select("doc_id", paths.escape_spec(F.concat("text", F.lit("%#@*?"))).alias("spec"))


@query("SELECT doc_id, '/' || source || '/d' || doc_id AS path FROM documents")
def resolve_dots(s: Snapshots) -> DataFrame:
    wild = F.concat(F.lit("/../x/./"), "lang", F.lit("/../../"), "source", F.lit("//a/b/../../d"), F.col("doc_id").cast("string"))
    return s.table("documents").select("doc_id", paths.resolve_dots(wild).alias("path"))


@query("SELECT seq, CASE WHEN raw_type = 'futuretype' THEN NULL WHEN strpos(raw_type, '+') > 0 THEN split_part(raw_type, '+', 1) ELSE raw_type END AS head_type, CASE WHEN raw_type = 'futuretype' THEN raw_type END AS unsupported_type FROM fx_depot", ("fx_depot",))
def file_type_map(s: Snapshots) -> DataFrame:
    return s.depot.select("seq", "head_type", "unsupported_type")


@query("SELECT doc_id, CASE WHEN length(text) < 1024 THEN length(text) || ' B' WHEN length(text) < 1048576 THEN printf('%.2f KiB', length(text) / 1024.0) ELSE printf('%.2f MiB', length(text) / 1048576.0) END AS size FROM documents")
def human_bytes(s: Snapshots) -> DataFrame:
    return s.table("documents").select("doc_id", messages.human_bytes(F.length("text").cast("long")).alias("size"))


# ---- audit ------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(user_id AS STRING) AS run_id, event_type AS command, count(*) AS calls FROM events GROUP BY 1, 2 UNION ALL SELECT CAST(user_id AS STRING), NULL, count(*) FROM events GROUP BY 1")
def command_tally(s: Snapshots) -> DataFrame:
    return audit.command_tally(s.table("events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("command")))


@query("SELECT event_id AS seq, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS calls_so_far FROM events")
def running_call_count(s: Snapshots) -> DataFrame:
    log = s.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("command"))
    return audit.running_call_count(log).select("seq", "calls_so_far")


_VERDICT = "CASE WHEN user_id % 15 = 0 THEN 'incomplete' WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 10 = 0 THEN 'counts' ELSE 'trusted' END"


@query(f"SELECT DISTINCT CAST(user_id AS STRING) AS run_id, {_VERDICT} AS verdict FROM events")
def run_log_validation(s: Snapshots) -> DataFrame:
    return audit.validate_run_log(_run_log(s))


@query(f"SELECT event_id AS seq FROM events WHERE {_VERDICT} = 'trusted' UNION ALL SELECT max(event_id) + 1000000000 FROM events WHERE {_VERDICT} = 'trusted' GROUP BY user_id")
def trusted_rows(s: Snapshots) -> DataFrame:
    return audit.trusted_rows(_run_log(s)).select("seq")


def _run_log(s: Snapshots) -> DataFrame:
    log = s.view("runlog")
    counts = F.when(F.col("kind") == "summary", F.create_map(F.lit("all"), F.col("total")))
    return log.withColumns({"counts": counts, "p4Calls": F.lit(None).cast("long"), "count": F.lit(None).cast("long"), "step": F.lit(None).cast("long")})


@query("SELECT event_id AS seq FROM (SELECT event_id, value, lag(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) t WHERE CAST(value AS BIGINT) < b")
def progress_goes_back(s: Snapshots) -> DataFrame:
    log = s.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.lit("progress").alias("kind"), F.rint("value").cast("long").alias("step"))
    return audit.progress_goes_back(log).select("seq")


@query("SELECT source, lang, count(*) AS n_a, count(CASE WHEN doc_id % 10 <> 0 THEN 1 END) AS n_b FROM documents GROUP BY 1, 2 HAVING count(*) <> count(CASE WHEN doc_id % 10 <> 0 THEN 1 END)")
def multiset_diff(s: Snapshots) -> DataFrame:
    d = s.table("documents")
    return audit.multiset_diff(d, d.where("doc_id % 10 <> 0"), ["source", "lang"])


@query(f"SELECT {fixtures.D} || '#' || (1 + doc_id % 5) AS spec FROM documents WHERE doc_id % 6 = 0")
def unacknowledged_specs(s: Snapshots) -> DataFrame:
    d = s.table("documents").select("doc_id", F.expr(f"{fixtures.D} || '#' || (1 + doc_id % 5)").alias("spec"))
    lines = d.where("doc_id % 6 <> 0").select(F.concat("spec", F.lit(" - updating - /ws/x")).alias("value"))
    return audit.unacknowledged(d.select("spec"), lines)


@query("SELECT 'plan' AS side, event_type AS class, CAST(event_id AS STRING) AS client_file FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0 UNION ALL SELECT 'native', event_type, CAST(event_id AS STRING) FROM events WHERE event_id % 5 = 0 AND event_id % 3 <> 0")
def native_coverage(s: Snapshots) -> DataFrame:
    e = s.table("events").select("event_id", F.col("event_type").alias("class"), F.col("event_id").cast("string").alias("client_file"))
    return audit.native_coverage(e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"))


@query("SELECT event_type AS class, count(*) AS failed, 'e' || min(event_id) AS first_error FROM events WHERE event_id % 4 = 0 GROUP BY 1")
def failures_by_group(s: Snapshots) -> DataFrame:
    e = s.table("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("class"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    return audit.failures_by_group(e)


_BATCH = """SELECT seq, shard, CAST(floor(coalesce(sum(bytes) OVER (PARTITION BY shard ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000) + floor((row_number() OVER (PARTITION BY shard ORDER BY seq) - 1) / 50) AS INTEGER) AS batch
FROM (SELECT seq, strlen(depot_file) + 1 AS bytes, CAST(floor((seq - lo) / ceil((hi - lo + 1) / 64.0)) AS INTEGER) AS shard FROM fx_depot, (SELECT min(seq) AS lo, max(seq) AS hi FROM fx_depot) t) u"""


@query(_BATCH, ("fx_depot",))
def batch_ids(s: Snapshots) -> DataFrame:
    return batching.batch_ids(s.view("depot").select("seq", F.col("depot_file").alias("spec")), 2000, 50).select("seq", "shard", "batch")


@query()
def pack_batches(s: Snapshots) -> DataFrame:
    """Fewest batches: a reset sum, in SQL a recursion over each shard."""
    return batching.pack_batches(s.view("depot").select("seq", F.col("depot_file").alias("spec")), 2000, 50, 8)


@query()
def scope_documents(s: Snapshots) -> DataFrame:
    """A scope document for each customer, every fourth of them wrong in one way or another."""
    k = F.col("c_custkey")
    text = F.when(k % 8 == 0, F.lit('{"include": [{"dir": "a"}], "include": []}')).when(k % 4 == 0, F.concat(F.lit('{"include": [{"dir": "../'), k.cast("string"), F.lit('"}]}'))).otherwise(F.concat(F.lit('{"include": [{"dir": "src//'), k.cast("string"), F.lit('/./x"}], "exclude": [{"file": "a.txt"}]}')))
    return records.read_scope_documents(s.table("customer").select(k.alias("doc_id"), F.encode(text, "UTF-8").alias("content")))


# ---- whole runs -------------------------------------------------------------------------------------------------------


def _run(s: Snapshots, mode: str = "open", **options) -> PlanResult:
    tables = {k: options.pop(k) for k in ("verdicts", "scope", "revisions", "view_map", "workspace") if k in options}
    return reconcile(s.spark, Tables(**({"depot": s.depot, "workspace": s.workspace, "have": s.view("have"), "digests": s.computed} | tables)), mode, **options)


def _judged(s: Snapshots) -> DataFrame:
    """A verdict for every document."""
    return s.table("documents").select(F.expr(fixtures.P).alias("path"), (F.col("doc_id") % 5 == 0).alias("ignored"), F.lit("rule").alias("source"))


def _plan_of(result: PlanResult, *columns: str) -> DataFrame:
    return result.plan.where("class <> 'handoff'").select(*columns)


_register_sync(
    "sync_protected_plan",
    "SELECT substr(outcome, 7) AS class, client_file, target_rev AS rev FROM sync WHERE outcome LIKE 'class %' AND (outcome <> 'class delete' OR seq % 5 <> 0)",
    lambda s: _plan_of(_run(s, "sync", force=True, verdicts=_judged(s)), "class", "client_file", "rev"),
    "heads AS (SELECT depot_file, head_rev AS rev, head_action AS action FROM fx_depot WHERE head_rev IS NOT NULL AND head_action IS NOT NULL),\n" + _SYNC.replace("fx_target", "heads"),
)

_HISTORY = """SELECT depot_file, head_rev AS rev, CASE WHEN seq % 4 = 0 THEN 90 ELSE 10 END AS change, head_action AS action, raw_type, file_size, digest FROM fx_depot WHERE head_rev IS NOT NULL
UNION ALL SELECT depot_file, have_rev, 5, 'edit', raw_type, file_size, digest FROM fx_depot WHERE head_rev IS NOT NULL AND have_rev <> head_rev"""


def _revisions(s: Snapshots) -> DataFrame:
    head, unsupported = kinds.parse_file_type(F.col("raw_type"))
    return s.sql(["fx_depot"], _HISTORY).withColumns({"head_type": head, "unsupported_type": unsupported}).drop("raw_type")


def _as_of(s: Snapshots) -> DataFrame:
    return _plan_of(_run(s, "sync", force=True, as_of=50, revisions=_revisions(s), verdicts=_judged(s)), "class", "client_file", "rev")


_register_sync(
    "sync_as_of_plan",
    "SELECT substr(outcome, 7) AS class, client_file, target_rev AS rev FROM sync WHERE outcome LIKE 'class %' AND (outcome <> 'class delete' OR seq % 5 <> 0)",
    _as_of,
    f"history AS ({_HISTORY}),\npast AS (SELECT depot_file, max(rev) AS rev, arg_max(action, rev) AS action FROM history WHERE change <= 50 GROUP BY depot_file),\n" + _SYNC.replace("fx_target", "past"),
)

_IGNORING = "seen AS (SELECT w.path, path_key, size, mtime_s, filtered OR coalesce(ignored, false) AS filtered, digest FROM fx_workspace w LEFT JOIN fx_verdicts v ON v.path = w.path),\n" + _OPEN.replace("fx_workspace", "seen")
QUERIES["open_filtered_plan"] = lambda spark, sf_dir: _plan_of(_run(s := Snapshots(spark, sf_dir), verdicts=s.view("verdicts").withColumn("source", F.lit("rule"))), "class", "client_file")
ORACLE_SQL["open_filtered_plan"] = fixtures.with_views([*_SNAPSHOT, "fx_verdicts"], "").rstrip() + ",\n" + _IGNORING + "\nSELECT class, client_file FROM decided WHERE class IS NOT NULL"

_COVERED = "(({0} LIKE '/ws/src1/%' OR {0} LIKE '/ws/src2/en/%' OR {0} = '/ws/src3/en/d3.txt') AND {0} NOT LIKE '/ws/src1/fr/%')"
_SCOPED = f"part AS (SELECT * FROM fx_depot WHERE {_COVERED.format('client_key')}), seen AS (SELECT * FROM fx_workspace WHERE {_COVERED.format('path_key')}),\n" + _OPEN.replace("fx_workspace", "seen").replace("fx_depot", "part")


def _scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Snapshots(spark, sf_dir)
    return _run(s, scope=s.view("scope")).summary.select("total", F.coalesce(F.col("counts")["add"], F.lit(0)).alias("n_add"), "scopeMatched", "unmatched")


QUERIES["scope_summary"] = _scope_summary
ORACLE_SQL["scope_summary"] = (
    fixtures.with_views([*_SNAPSHOT, "fx_scope"], "").rstrip() + ",\n" + _SCOPED
    + ", missed AS (SELECT count(*) AS n FROM fx_scope WHERE role = 'include' AND NOT EXISTS (SELECT 1 FROM (SELECT client_key AS p FROM fx_depot UNION ALL SELECT path_key FROM fx_workspace) s WHERE p = key OR (kind = 'dir' AND p LIKE key || '/%')))\n"
    + 'SELECT count(*) AS total, count(CASE WHEN class = \'add\' THEN 1 END) AS n_add, 4 - (SELECT n FROM missed) AS "scopeMatched", (SELECT n FROM missed) AS unmatched FROM decided WHERE class IS NOT NULL'
)

QUERIES["sync_scoped_plan"] = lambda spark, sf_dir: _scoped_sync(Snapshots(spark, sf_dir))
ORACLE_SQL["sync_scoped_plan"] = (
    fixtures.with_views([*_SNAPSHOT, "fx_scope"], "").rstrip() + f""",
history AS ({_HISTORY}), past AS (SELECT depot_file, max(rev) AS rev, arg_max(action, rev) AS action FROM history WHERE change <= 50 GROUP BY depot_file),
part AS (SELECT * FROM fx_depot WHERE {_COVERED.format('client_key')}), seen AS (SELECT * FROM fx_workspace WHERE {_COVERED.format('path_key')}),
""" + _SYNC.replace("fx_target", "past").replace("fx_workspace", "seen").replace("fx_depot", "part")
    + "\nSELECT substr(outcome, 7) AS class, client_file, target_rev AS rev FROM sync WHERE outcome LIKE 'class %' AND (outcome <> 'class delete' OR seq % 5 <> 0)"
)


def _scoped_sync(s: Snapshots) -> DataFrame:
    """To a change, within a scope: records, files and target are narrowed alike."""
    return _plan_of(_run(s, "sync", force=True, as_of=50, revisions=_revisions(s), verdicts=_judged(s), scope=s.view("scope")), "class", "client_file", "rev")


# ---- columns, guards and lines ----------------------------------------------------------------------------------------


@query(r"SELECT doc_id, 'C:\Ws\' || source || '\' || lang || '\d' || doc_id || '.txt' AS windows, '/ws/' || lang || '/d' || doc_id AS relative, '/ws/' || source AS dir, '/ws/' || source AS bare, doc_id % 2 = 0 AS under FROM documents")
def path_forms(s: Snapshots) -> DataFrame:
    n, lit = F.col("doc_id").cast("string"), F.lit
    top = F.concat(lit("/ws/"), "source")
    return s.table("documents").select(
        "doc_id",
        paths.canonical_path(F.concat(lit("c:/Ws/"), "source", lit("/./x/../"), "lang", lit("\\d"), n, lit(".txt")), "C:\\base", "windows").alias("windows"),
        paths.canonical_path(F.concat("source", lit("/../"), "lang", lit("//d"), n), "/ws").alias("relative"),
        paths.directory_key(F.concat(top, lit("///"))).alias("dir"),
        paths.strip_recursive_suffix(F.concat(top, lit("/.../..."))).alias("bare"),
        paths.is_under(F.concat(top, F.when(F.col("doc_id") % 2 == 0, "/a").otherwise("x/a")), top).alias("under"),
    )


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'binary' WHEN 1 THEN 'text' WHEN 2 THEN 'utf8' WHEN 3 THEN 'symlink' ELSE 'apple' END"


@query(f"SELECT doc_id, {_KIND} AS kind, CASE doc_id % 5 WHEN 0 THEN md5(text) WHEN 1 THEN md5(replace(text, chr(13) || chr(10), chr(10))) WHEN 2 THEN md5(replace(text, chr(13) || chr(10), chr(10))) WHEN 3 THEN md5(replace(text, chr(92), '/') || chr(10)) END AS digest FROM documents")
def digest_files(s: Snapshots) -> DataFrame:
    """The bytes of every document as a file of one type or another; links are given by their target."""
    kind, raw = F.expr(_KIND), F.encode("text", "UTF-8")
    return s.table("documents").select("doc_id", kind.alias("kind"), digests.digest(raw, kind, F.when(kind == "symlink", F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, regexp_matches(text, '^[\x00-\x7F]*$') AS safe, CASE WHEN regexp_matches(text, '^[\x00-\x7F]*$') THEN true ELSE text = upper(text) END AS same FROM documents")
def ascii_texts(s: Snapshots) -> DataFrame:
    return s.table("documents").select("doc_id", paths.ascii_safe(F.col("text")).alias("safe"), paths.case_equal_ascii(F.col("text"), F.upper("text")).alias("same"))


@query("SELECT doc_id, text, 'd' || doc_id AS line FROM documents")
def text_trims(s: Snapshots) -> DataFrame:
    ends = F.get(F.array(*map(F.lit, ("\r\n", "\n", "\r", ""))), F.pmod("doc_id", F.lit(4)).cast("int"))
    marked = digests.strip_bom(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), "utf8")
    return s.table("documents").select("doc_id", F.decode(marked, "UTF-8").alias("text"), digests.trim_line_ending(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ends)).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing head type, file size' WHEN doc_id % 2 = 0 THEN 'missing head type' WHEN doc_id % 3 = 0 THEN 'missing file size' END AS missing FROM documents")
def missing_fields(s: Snapshots) -> DataFrame:
    unless = lambda n, value: F.when(F.col("doc_id") % n != 0, value)
    return s.table("documents").select("doc_id", digests.missing_fields(unless(2, F.lit("text")), unless(3, F.length("text"))).alias("missing"))


@query(f"SELECT {fixtures.P} AS path FROM documents WHERE doc_id % 4 = 0")
def refused_adds(s: Snapshots) -> DataFrame:
    d = s.table("documents").select("doc_id", F.expr(fixtures.P).alias("path"), F.expr(fixtures.D).alias("depot_file"))
    lines = d.select(F.concat(F.when(F.col("doc_id") % 4 == 0, F.col("path")).otherwise(F.col("depot_file")), F.lit(messages.REFUSED_ADD_SUFFIX)).alias("value"))
    return ignore.refused_adds(lines, d)


@query("SELECT count(*) > 0 AS prune FROM documents WHERE doc_id % 50 = 0")
def prune_gate(s: Snapshots) -> DataFrame:
    s.table("documents").createOrReplaceTempView("documents")
    lines = s.spark.sql(_RULES).where("value <> '#WHAT' AND value NOT LIKE '%!keep'")
    return ignore.prune_gate(ignore.ignore_rule_summary(lines), containment.list_directories(s.view("wide"), "/ws"), ".p4ignore")


@query("SELECT DISTINCT CASE WHEN source = 'src1' THEN '/ws/src1' ELSE '/ws/' || source || '/fr' END AS dir_key FROM documents WHERE source = 'src1' OR lang = 'fr'")
def prunable_dirs(s: Snapshots) -> DataFrame:
    """src1 and all fr directories are ignored with their probes; of src2 only the directory itself."""
    d = s.table("documents")
    tops = d.select(F.concat(F.lit("/ws/"), "source").alias("dir_key"), "source", F.lit("").alias("lang"))
    dirs = tops.unionByName(d.select(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang").alias("dir_key"), "source", "lang")).distinct()
    probed = (F.col("source") == "src1") | (F.col("lang") == "fr")
    asked = dirs.select(F.col("dir_key").alias("path"), (probed | (F.col("source") == "src2")).alias("ignored")).unionByName(dirs.select(F.concat("dir_key", F.lit("/__probe__")).alias("path"), probed.alias("ignored")))
    return ignore.prunable_dirs(dirs, asked)


@query("SELECT count(CASE WHEN source = 'src5' THEN 1 END) AS degraded, '/elsewhere/' || min(CASE WHEN source = 'src5' THEN doc_id END) AS example FROM documents")
def degraded_paths(s: Snapshots) -> DataFrame:
    path = F.when(F.col("source") == "src5", F.concat(F.lit("/elsewhere/"), F.col("doc_id").cast("string"))).otherwise(F.expr(fixtures.P))
    return audit.degraded_paths(s.table("documents").select(F.col("doc_id").alias("seq"), path.alias("path")), "/ws", "cl")


_SIDES = "(SELECT client_key AS p FROM fx_depot UNION ALL SELECT path_key FROM fx_workspace)"


@query(f"SELECT count(*) AS scope_matched FROM fx_scope WHERE role = 'include' AND EXISTS (SELECT 1 FROM {_SIDES} s WHERE p = key OR (kind = 'dir' AND p LIKE key || '/%'))", ("fx_scope", "fx_depot", "fx_workspace"))
def scope_matched(s: Snapshots) -> DataFrame:
    scope = s.view("scope")
    return containment.scope_matched(scope, containment.unmatched_entries(scope, s.depot, s.workspace))


@query("SELECT '/ws/' || source || '/' || lang AS key FROM documents GROUP BY source, lang HAVING max(doc_id % 11) = 0 UNION SELECT '/ws/away/' || (doc_id % 7) FROM documents", ())
def missing_roots(s: Snapshots) -> DataFrame:
    """Directories all of whose documents are absent from disk, and some that nobody has."""
    d = s.table("documents")
    keys = d.select(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang").alias("key")).union(d.select(F.concat(F.lit("/ws/away/"), (F.col("doc_id") % 7).cast("string")))).distinct()
    dirs = keys.select(F.lit("include").alias("role"), F.lit("dir").alias("kind"), F.col("key").alias("path"), "key")
    return containment.missing_roots(dirs, s.workspace).select("key")


@query("SELECT w.path AS client_file, d.depot_file, d.have_rev, CASE WHEN d.seq IS NULL THEN 'no record' WHEN d.have_rev IS NULL THEN 'never synced' END AS error FROM fx_workspace w LEFT JOIN fx_depot d ON d.client_key = w.path_key", ("fx_workspace", "fx_depot"))
def resolve_restore(s: Snapshots) -> DataFrame:
    return snapshots.resolve_restore(s.workspace.select(F.col("path").alias("client_file"), F.col("path_key").alias("client_key")), s.depot).select("client_file", "depot_file", "have_rev", "error")


@query("SELECT 'e' || min(event_id) AS error, count(*) AS errors FROM events WHERE event_id % 4 = 1")
def first_error(s: Snapshots) -> DataFrame:
    return guards.first_error(s.table("events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")))


@query("SELECT count(*) AS total, (SELECT string_agg(depot_file, ',' ORDER BY depot_file) FROM (SELECT depot_file FROM fx_depot ORDER BY depot_file LIMIT 10) t) AS first FROM fx_depot", ("fx_depot",))
def guard_samples(s: Snapshots) -> DataFrame:
    return guards.samples(s.depot, F.col("depot_file")).select("total", F.array_join("samples", ",").alias("first"))


@query("SELECT seq, depot_file FROM fx_depot", ("fx_depot",))
def dedupe_candidates(s: Snapshots) -> DataFrame:
    rows = s.depot.select("seq", "depot_file", F.lit("update").alias("class"), F.col("head_rev").alias("rev"), "client_file")
    return snapshots.dedupe_candidates(rows.unionByName(rows.withColumn("seq", F.col("seq") + 10**7))).select("seq", "depot_file")


@query("SELECT 'include' AS role, 'dir' AS kind, key FROM (SELECT DISTINCT '/ws/' || source AS key FROM documents) i UNION ALL SELECT 'exclude', 'dir', key FROM (SELECT DISTINCT '/ws/' || source || '/fr' AS key FROM documents WHERE lang = 'fr') e UNION ALL SELECT 'implicit', 'file', '/ws/.scope.json'")
def built_scope(s: Snapshots) -> DataFrame:
    """The sources as include entries of a document, their languages as targets too deep for it, French ones excluded."""
    d = s.table("documents")
    entry = lambda role, c: [F.lit(role).alias("role"), F.lit("dir").alias("kind"), c.alias("path")]
    below = F.concat("source", F.lit("/./"), "lang")
    config = d.select(*entry("include", F.col("source"))).union(d.select(*entry("include", below))).union(d.where("lang = 'fr'").select(*entry("exclude", below))).distinct()
    built = scope.build_scope(s.spark, "/ws", config, True, scope_file=".scope.json")
    return scope.sorted_scope(built).select("role", "kind", "key")


@query("SELECT DISTINCT '/ws/' || source || '/' || lang AS key FROM documents WHERE source = 'src5' AND lang <> 'fr'")
def dropped_targets(s: Snapshots) -> DataFrame:
    d = s.table("documents")
    entry = lambda c: [F.lit("dir").alias("kind"), c.alias("path"), c.alias("key")]
    below = F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang")
    part = lambda df, c: df.select(*entry(c)).distinct()
    return containment.dropped_targets(part(d, below), part(d.where("source <> 'src5'"), F.concat(F.lit("/ws/"), "source")), part(d.where("lang = 'fr'"), below)).select("key")


@query("SELECT path_key AS key FROM fx_view_map WHERE NOT unmapped AND depot_file IS NOT NULL", ("fx_view_map",))
def translated_targets(s: Snapshots) -> DataFrame:
    targets = s.table("documents").select(F.expr(fixtures.D).alias("depot_file"), F.lit("file").alias("kind"))
    return untracked.translate_depot_paths(targets, s.view("view_map")).select("key")


@query("SELECT path, true AS ignored FROM fx_verdicts WHERE ignored AND path IN (SELECT path FROM fx_workspace) UNION ALL SELECT path, false FROM fx_workspace WHERE path NOT IN (SELECT path FROM fx_verdicts)", ("fx_verdicts", "fx_workspace"))
def ignored_paths(s: Snapshots) -> DataFrame:
    """Ignored files, and those that a strict run refuses to judge."""
    ignored, unjudged = ignore.ignored_paths(s.workspace, s.view("verdicts"), strict=True)
    return ignored.withColumn("ignored", F.lit(True)).unionByName(unjudged.withColumn("ignored", F.lit(False)))


@query("SELECT path_key, CASE WHEN depot_file IS NULL THEN 'unmapped' END AS refused FROM fx_view_map WHERE path_key IN (SELECT path_key FROM fx_workspace)", ("fx_view_map", "fx_workspace"))
def mapped_paths(s: Snapshots) -> DataFrame:
    held = s.workspace.join(s.view("view_map").select("path_key"), "path_key", "left_semi")
    return untracked.map_paths(held, s.view("view_map")).select("path_key", F.when(F.col("depot_file").isNull(), "unmapped").alias("refused"))


@query(f"SELECT CASE WHEN seq % 2 = 0 THEN 'update_modified' ELSE 'delete_modified' END AS reason, CASE WHEN seq % 2 = 0 THEN 'not updated' ELSE 'not deleted' END AS action, \"depotFile\" AS file, rev FROM ({_FEED}) t WHERE seq % 7 = 1")
def conflict_lines(s: Snapshots) -> DataFrame:
    rows = feed.notices(_feed(s))[0].withColumns({"stage": F.lit(None).cast("string"), "applied": F.lit(False)})
    at = lambda name: F.get_json_object("value", f"$.{name}")
    return sinks.conflict_lines(rows).select(at("reason").alias("reason"), at("action").alias("action"), at("depotFile").alias("file"), at("rev").alias("rev"))


@query(f"SELECT kind AS type, path FROM fx_scope WHERE role = 'include' AND NOT EXISTS (SELECT 1 FROM {_SIDES} s WHERE p = key OR (kind = 'dir' AND p LIKE key || '/%'))", ("fx_scope", "fx_depot", "fx_workspace"))
def unmatched_lines(s: Snapshots) -> DataFrame:
    lines = sinks.unmatched_lines(containment.unmatched_entries(s.view("scope"), s.depot, s.workspace))
    return lines.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.path").alias("path"))


_register_open(
    "handoff_lines",
    "SELECT 'handoff' AS class, 'reconcile' AS action, client_file AS file FROM decided WHERE side = 'handoff'",
    lambda s: sinks.handoff_lines(classify.to_plan(open_rows(s), "open")).select(F.get_json_object("value", "$.class").alias("class"), F.get_json_object("value", "$.action").alias("action"), F.get_json_object("value", "$.clientFile").alias("file")),
)


@query(f"SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'edit' ELSE 'edit' END AS class, {fixtures.D} AS depot_file, CASE WHEN doc_id % 3 <> 0 THEN 1 + doc_id % 5 END AS rev FROM documents WHERE doc_id % 8 <> 0")
def native_reconcile_rows(s: Snapshots) -> DataFrame:
    k = F.col("doc_id")
    action = F.when(k % 3 == 0, "add").when(k % 3 == 1, "edit").otherwise("move/add")
    value = F.to_json(F.struct(action.alias("action"), F.expr(fixtures.D).alias("depotFile"), F.when(k % 8 != 0, F.expr(fixtures.P)).alias("clientFile"), (1 + k % 5).cast("string").alias("workRev")))
    return records.parse_native_reconcile(s.table("documents").select(k.alias("seq"), value.alias("value"))).select("seq", "class", "depot_file", "rev")


@query("SELECT path_key FROM fx_workspace", ("fx_workspace",))
def sorted_inventory(s: Snapshots) -> DataFrame:
    return snapshots.sorted_inventory(s.workspace).select("path_key")


@query("SELECT path_key, row_number() OVER (ORDER BY path_key) AS place FROM fx_workspace", ("fx_workspace",))
def inventory_order(s: Snapshots) -> DataFrame:
    """The sorted inventory with each row's place in the table as it comes out of the sort."""
    placed = snapshots.sorted_inventory(s.workspace).select("path_key").withColumn("_at", F.monotonically_increasing_id())
    return running(stored(placed, "order"), ["_at"], "place").select("path_key", "place")


_ITEM = "l_orderkey, l_partkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS line"


@query(
    f"""WITH a AS (SELECT {_ITEM} FROM lineitem), b AS (SELECT {_ITEM} FROM lineitem WHERE l_orderkey % 101 <> 0 UNION ALL SELECT {_ITEM} FROM lineitem WHERE l_partkey % 97 = 0),
n AS (SELECT l_orderkey, l_partkey, line, sum(x) AS n_a, sum(1 - x) AS n_b FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, 0 FROM b) u GROUP BY ALL)
SELECT l_orderkey, l_partkey, line, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b FROM n WHERE n_a <> n_b"""
)
def changed_rows(s: Snapshots) -> DataFrame:
    """Line items against themselves without some orders and with some parts twice."""
    items = s.table("lineitem").selectExpr("l_orderkey", "l_partkey", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS line")
    return audit.changed_rows(items, items.where("l_orderkey % 101 <> 0").unionByName(items.where("l_partkey % 97 = 0")))


_CRLF = "replace(text, chr(10), chr(13) || chr(10))"


@query(f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN {_CRLF} ELSE replace({_CRLF}, chr(13) || chr(10), chr(10)) END) AS digest, strlen({_CRLF}) + CASE WHEN doc_id % 3 = 2 THEN 3 ELSE 0 END AS n_bytes FROM documents")
def chunk_digests(s: Snapshots) -> DataFrame:
    """Every document as a file with CR LF line ends, every third with a byte order mark, cut into chunks of 997 bytes."""
    kind = F.get(F.array(*map(F.lit, ("binary", "text", "utf8"))), F.pmod("doc_id", F.lit(3)).cast("int"))
    raw = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")
    files = s.table("documents").select("doc_id", kind.alias("kind"), F.when(kind == "utf8", F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw).alias("raw"))
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("raw") - 1, F.lit(0)).cast("long"), F.lit(997).cast("long"))
    chunks = files.select("doc_id", "kind", "raw", F.explode(at).alias("offset")).select("doc_id", "kind", "offset", F.substr("raw", (F.col("offset") + 1).cast("int"), F.lit(997)).alias("chunk"))
    return content.fingerprint_chunks(chunks, "doc_id").select("doc_id", F.col("computed").alias("digest"), "n_bytes")


@query()
def fewest_batches(s: Snapshots) -> DataFrame:
    """The fewest batches of the whole list, in its order."""
    return batching.fewest_batches(s.view("depot").select("seq", F.col("depot_file").alias("spec")), 2000, 50).select("seq", "batch")


ORACLE_SQL["fewest_batches"] = """WITH RECURSIVE """ + fixtures.with_views(["fx_depot"], "")[5:].rstrip() + """,
placed AS MATERIALIZED (SELECT seq, strlen(depot_file) + 1 AS n, row_number() OVER (ORDER BY seq) AS r FROM fx_depot),
packed AS (SELECT seq, r, CAST(0 AS BIGINT) AS batch, n AS used, 1 AS held FROM placed WHERE r = 1
  UNION ALL SELECT s.seq, s.r, p.batch + CASE WHEN p.used + s.n > 2000 OR p.held >= 50 THEN 1 ELSE 0 END, CASE WHEN p.used + s.n > 2000 OR p.held >= 50 THEN s.n ELSE p.used + s.n END,
    CASE WHEN p.used + s.n > 2000 OR p.held >= 50 THEN 1 ELSE p.held + 1 END FROM packed p JOIN placed s ON s.r = p.r + 1)
SELECT seq, batch FROM packed"""


_TOP, _ORDER = "'/ws/o' || (l_orderkey % 1000)", "l_orderkey % 1000 % 5"


@query(
    f"""WITH t AS (SELECT DISTINCT {_TOP} AS dir_key, {_ORDER} AS k FROM lineitem), d AS (SELECT DISTINCT {_TOP} || '/' || l_orderkey AS dir_key, l_orderkey % 7 AS k FROM lineitem WHERE {_ORDER} <> 0),
q AS (SELECT (SELECT count(*) + count(CASE WHEN k < 2 THEN 1 END) FROM t) + (SELECT count(*) + count(CASE WHEN k = 0 THEN 1 END) FROM d) AS questions)
SELECT dir_key, questions FROM (SELECT dir_key FROM t WHERE k = 0 UNION ALL SELECT dir_key FROM d WHERE k = 0) p, q"""
)
def pruning_plan(s: Snapshots) -> DataFrame:
    """Every fifth top directory is ignored with its content, of the next ones only the directory itself, and so is every
    seventh order anywhere; the questions asked are the fewest that settle this."""
    s.table("documents").createOrReplaceTempView("documents")
    rules = s.spark.sql(_RULES).where("value <> '#WHAT' AND value NOT LIKE '%!keep'")
    d = s.table("lineitem")
    tops = d.select(F.expr(_TOP).alias("path"), F.expr(_ORDER).alias("k")).where("k < 2").distinct()
    seventh = d.where("l_orderkey % 7 = 0").select("l_orderkey").distinct().select(F.expr(f"{_TOP} || '/' || l_orderkey").alias("path"))
    whole = tops.where("k = 0").select("path").unionByName(seventh)
    yes = whole.select(F.explode(F.array("path", F.concat("path", F.lit("/__probe__")))).alias("path")).unionByName(tops.where("k = 1").select("path"))
    planned = pruning.plan_pruning(containment.list_directories(s.view("wide"), "/ws"), rules, pruning.answers_from(yes.select(F.concat("path", F.lit(" ignored")).alias("value"))))
    return planned.pruned.withColumn("questions", F.lit(planned.questions).cast("long"))


ORACLE_SQL["pack_batches"] = """WITH RECURSIVE """ + fixtures.with_views(["fx_depot"], "")[5:].rstrip() + """,
sized AS (SELECT seq, depot_file AS spec, strlen(depot_file) + 1 AS n, CAST(floor((seq - lo) / ceil((hi - lo + 1) / 8.0)) AS INTEGER) AS shard FROM fx_depot, (SELECT min(seq) AS lo, max(seq) AS hi FROM fx_depot) t),
placed AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS r FROM sized),
packed AS (SELECT seq, spec, shard, r, 0 AS batch, n AS used, 1 AS held FROM placed WHERE r = 1
  UNION ALL SELECT s.seq, s.spec, s.shard, s.r, p.batch + CASE WHEN p.used + s.n > 2000 OR p.held >= 50 THEN 1 ELSE 0 END, CASE WHEN p.used + s.n > 2000 OR p.held >= 50 THEN s.n ELSE p.used + s.n END,
    CASE WHEN p.used + s.n > 2000 OR p.held >= 50 THEN 1 ELSE p.held + 1 END FROM packed p JOIN placed s ON s.shard = p.shard AND s.r = p.r + 1)
SELECT seq, spec, shard, batch FROM packed"""
