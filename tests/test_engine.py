"""Whole runs, sources and sinks on real files, streams, and every registered query against its oracle."""

import hashlib
import json
import os
import random
import sys
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sylva import queries, schemas
from sylva.operators import audit, batching, feed, ignore, snapshots, untracked
from sylva.operators.guards import PlanRefused
from sylva.plans.reconcile import Tables, reconcile
from sylva.sources import content, inventory, records, sinks
from sylva.streaming import jobs
from tests.test_classify import CHANGED, FILE, HIDDEN, OTHER, SAME, record, world

CASES = [({}, FILE), ({}, CHANGED), ({}, None), (None, FILE), ({"action": "edit"}, FILE), ({"action": "delete"}, FILE), ({"head_type": "apple"}, FILE), ({"have_rev": None}, FILE), ({}, HIDDEN)]


@pytest.fixture(scope="module")
def tables(spark):
    depot, ws, have, computed = world(spark, CASES)
    return Tables(depot=depot, workspace=ws, have=have, digests=computed)


def classes(result):
    return {(r["client_file"], r["class"]) for r in result.plan.collect()}


def test_open_clean_and_options(spark, tables):
    got = reconcile(spark, tables)
    assert classes(got) == {("/w/1", "edit"), ("/w/2", "delete"), ("/w/3", "add"), ("/w/4", "revert_edit"), ("/w/5", "revert_delete"), ("/w/6", "handoff")}
    assert [r["client_file"] for r in got.side["unsynced"].collect()] == ["/w/7"]
    s = got.summary.first()
    assert s["total"] == 5 and dict(s["counts"]) == {"edit": 1, "delete": 1, "add": 1, "revert_edit": 1, "revert_delete": 1} and s["ok"] and s["conflicts"] == 0
    assert classes(reconcile(spark, tables, native_parity=True)) == {("/w/1", "edit"), ("/w/2", "delete"), ("/w/3", "add"), ("/w/5", "reopen_edit"), ("/w/6", "handoff")}
    assert classes(reconcile(spark, tables, "clean")) == {("/w/1", "revert"), ("/w/2", "restore"), ("/w/3", "delete"), ("/w/6", "handoff")}
    for bad in ({"mode": "zap"}, {"force": True}, {"mode": "sync", "delete_untracked": True}, {"verify_all": True}, {"mode": "sync", "as_of": 0}, {"as_of": 3}, {"mode": "sync", "run_excludes": True}, {"mode": "sync"}):
        with pytest.raises(ValueError):
            reconcile(spark, tables, **bad)


def test_errors_refuse(spark):
    depot, ws, have, computed = world(spark, [({"action": "branch"}, None), ({}, CHANGED)])
    with pytest.raises(PlanRefused, match="classification"):
        reconcile(spark, Tables(depot, ws, have, digests=computed))
    depot, ws, have, _ = world(spark, [({}, CHANGED)])
    with pytest.raises(PlanRefused, match="digests"):
        reconcile(spark, Tables(depot, ws, have))
    content = spark.createDataFrame([("/w/0", b"x\r\n")], "client_key string, content binary")
    assert classes(reconcile(spark, Tables(depot, ws, have, content=content))) == {("/w/0", "edit")}


def test_forced_sync(spark):
    depot, ws, have, computed = world(spark, [({}, FILE), ({}, CHANGED), ({}, None), ({"have_rev": 1}, FILE), ({}, FILE), (None, FILE), (None, HIDDEN)])
    rev = [(f"//d/{i}", 2 if i == 3 else 1, 10 if i != 4 else 99, "edit", "text", 100, SAME) for i in range(5)] + [("//d/3", 1, 5, "edit", "text", 100, SAME)]
    t = Tables(depot, ws, have, revisions=spark.createDataFrame(rev, schemas.REVISIONS), digests=computed)
    base = {("/w/1", "revert"), ("/w/2", "restore"), ("/w/3", "update")}
    assert classes(reconcile(spark, t, "sync", force=True)) == base
    with pytest.raises(PlanRefused, match="verdict_completeness"):  # a deletion that nobody judged
        reconcile(spark, t, "sync", force=True, as_of=50)
    t.verdicts = spark.createDataFrame([("/w/4", False, "x")], schemas.IGNORE_VERDICTS)
    assert classes(reconcile(spark, t, "sync", force=True, as_of=50)) == base | {("/w/4", "delete")}
    t.verdicts = t.verdicts.withColumn("ignored", ~F.col("ignored"))
    assert classes(reconcile(spark, t, "sync", force=True, as_of=50)) == base  # an ignored file isn't deleted
    t.verdicts = spark.createDataFrame([("/w/5", False, "x"), ("/w/6", False, "x")], schemas.IGNORE_VERDICTS)
    t.view_map = spark.createDataFrame([("/w/5", "//d/5", False), ("/w/6", "//d/6", True)], schemas.VIEW_MAP)
    assert classes(reconcile(spark, t, "sync", force=True, delete_untracked=True)) == base | {("/w/5", "untracked")}
    t.verdicts = t.verdicts.where("path <> '/w/6'")
    with pytest.raises(PlanRefused, match="verdict_completeness"):
        reconcile(spark, t, "sync", force=True, delete_untracked=True)
    t.revisions = t.revisions.where("false")
    with pytest.raises(PlanRefused, match="empty_target"):
        reconcile(spark, t, "sync", force=True)


def test_ignores_scope_and_pruning_of_a_run(spark, tables):
    t = Tables(tables.depot, tables.workspace, tables.have, digests=tables.digests)
    t.verdicts = spark.createDataFrame([("/w/3", True, "x"), ("/w/1", False, "x")], schemas.IGNORE_VERDICTS)
    assert not any(f == "/w/3" for f, _ in classes(reconcile(spark, t)))
    t.verdicts, t.pruned = None, spark.createDataFrame([("/w",)], "dir_key string")  # tracked files lie there
    assert classes(reconcile(spark, t)) == classes(reconcile(spark, tables))
    t.pruned, t.scope = None, spark.createDataFrame([("include", "file", "/w/1", "/w/1"), ("include", "dir", "/none", "/none")], schemas.SCOPE)
    got = reconcile(spark, t)
    assert classes(got) == {("/w/1", "edit")} and [r["path"] for r in got.side["unmatched"].collect()] == ["/none"]
    assert (got.summary.first()["scopeMatched"], got.summary.first()["unmatched"]) == (1, 1)
    t.scope = t.scope.where("kind = 'dir'")
    with pytest.raises(PlanRefused, match="no_entry_matched"):
        reconcile(spark, t)


FEED = [
    (1, "stat", "//d/a", "/w/a", "added", "1", 0, None), (2, "stat", "//d/b", "/w/b", "refreshed", "2", 0, None), (3, "stat", "//d/a", "/w/a", "added", "1", 0, None), (4, "info", None, None, None, None, 1, "//d/c#3 - deleted as /w/c"),
    (5, "info", None, None, None, None, 1, "//d/e#3 - can't update modified file /w/e"), (6, "info", None, None, None, None, 1, "//d/e#3 - can't update modified file /w/e"), (7, "error", None, None, None, None, 2, "up-to-date"),
]


def test_normal_sync(spark, tables):
    t = Tables(tables.depot, tables.workspace, feed=spark.createDataFrame(FEED, schemas.FEED))
    t.opened = spark.createDataFrame([(20, "//d/1", "/w/1", 1), (21, "//d/4", "/w/4", 9)], "seq long, depot_file string, client_file string, have_rev long")
    got = reconcile(spark, t, "sync")
    assert classes(got) == {("/w/a", "add"), ("/w/b", "update"), ("/w/c", "delete"), ("/w/4", "resolve")}
    assert [(r["reason"], r["action"]) for r in got.conflicts.collect()] == [("update_modified", "not updated")] and got.summary.first()["conflicts"] == 1
    t.scope = spark.createDataFrame([("include", "dir", "/w", "/w"), ("exclude", "file", "/w/a", "/w/a")], schemas.SCOPE)
    t.opened = None
    assert classes(reconcile(spark, t, "sync")) == {("/w/b", "update"), ("/w/c", "delete")}
    for rule, row in [("feed_failure", (9, "error", None, None, None, None, 3, "broken")), ("unexplained_notice", (9, "info", None, None, None, None, 1, "hello")), ("feed_record", (9, "stat", "//d/z", "/w/z", "zapped", "1", 0, None)), ("feed_record", (9, "stat", "//d/z", "/w/z", "added", "x", 0, None)), ("feed_record", (9, "stat", None, "/w/z", "added", "1", 0, None)), ("conflicting_duplicates", (9, "stat", "//d/a", "/w/a", "added", "7", 0, None)), ("outside_scope", (9, "stat", "//d/z", "/x/z", "added", "1", 0, None))]:
        t.feed = spark.createDataFrame([*FEED, row], schemas.FEED)
        with pytest.raises(PlanRefused, match=rule):
            reconcile(spark, t, "sync")
    gone = spark.createDataFrame([("//d/1", 3, "delete")], schemas.TARGET)
    opened = spark.createDataFrame([(1, "//d/1", "/w/1", 1), (2, "//d/2", "/w/2", None)], "seq long, depot_file string, client_file string, have_rev long")
    errors = feed.opened_candidates(opened, gone.unionByName(spark.createDataFrame([("//d/2", 3, "edit")], schemas.TARGET)))
    assert errors.where("error IS NOT NULL").count() == 2
    empty = spark.createDataFrame([], "class string")
    assert feed.is_up_to_date(empty, empty) and not feed.is_up_to_date(empty, opened)
    notices = spark.createDataFrame([(9, "hello")], "seq long, data string")
    feed.require_explained(notices, opened)  # an opened file may be what it tells of
    with pytest.raises(PlanRefused, match="unexplained_notice"):
        feed.require_explained(notices, empty)
    t.feed, t.opened, t.scope = spark.createDataFrame(FEED[4:], schemas.FEED), None, None  # refusals only
    refused = reconcile(spark, t, "sync")
    assert not refused.up_to_date and refused.plan.isEmpty() and (refused.summary.first()["ok"], refused.summary.first()["conflicts"]) == (True, 1)


def test_files_on_disk(spark, tmp_path):
    for name, data in {"a/b/x.txt": b"one\r\n", "a/y.bin": b"\0\1", "skip/z.txt": b"z", "使用.txt": "中\n".encode()}.items():
        p = tmp_path / "ws" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    root = str(tmp_path / "ws")
    inv = inventory.scan_inventory(spark, [root])
    assert {(os.path.relpath(r["path"], root), r["size"]) for r in inv.collect()} == {("a/b/x.txt", 5), ("a/y.bin", 2), ("skip/z.txt", 1), ("使用.txt", 4)}
    assert inventory.scan_inventory(spark, [root, f"{root}/nowhere"], excluded=[f"{root}/skip"]).count() == 3
    assert inventory.scan_inventory(spark, [f"{root}/nowhere"]).isEmpty() and inventory.scan_inventory(spark, [root], glob="*.bin").count() == 1
    single = inventory.scan_single_files(spark, [f"{root}/a/y.bin", f"{root}/none", f"{root}/a"])
    assert [os.path.relpath(r["path"], root) for r in single.collect()] == ["a/y.bin"]
    got = content.read_content(inv.where("path LIKE '%x.txt'")).collect()
    assert [bytes(r["content"]) for r in got] == [b"one\r\n"]
    assert content.read_content(inv.where("false")).isEmpty()
    cache, warning = inventory.load_digest_cache(spark, f"{tmp_path}/cache")
    assert cache.isEmpty() and "not readable" in warning
    fresh = inv.select("path_key", "size", "mtime", F.lit("d1").alias("digest"))
    assert inventory.save_digest_cache(fresh, f"{tmp_path}/cache", "v1") and not inventory.save_digest_cache(fresh, f"{tmp_path}/cache", "v2", dirty=False)
    cache, warning = inventory.load_digest_cache(spark, f"{tmp_path}/cache")
    assert cache.count() == 4 and warning is None
    merged = inventory.merge_digest_cache(cache, fresh.limit(1).withColumn("digest", F.lit("d2")))
    assert sorted(r["digest"] for r in merged.collect()) == ["d1", "d1", "d1", "d2"]


def test_text_records(spark, tmp_path):
    block = "... depotFile //d/a\n... clientFile /W/A\n... headAction edit\n... headType text+w\n... headRev 1\n... headRev 3\n... digest ABC\n... odd 1"
    (tmp_path / "f.txt").write_text(f"{block}\n\n... depotFile //d/b\n... headAction zap\n\nnoise\n\n... depotFile //d/c\n... headType strange\n... haveRev none")
    rows = records.parse_tagged_records(spark, str(tmp_path / "f.txt"), "macos").orderBy("depot_file").collect()
    assert [(r["depot_file"], r["client_key"], r["head_rev"], r["head_type"], r["unsupported_type"], r["digest"], r["error"]) for r in rows] == [
        ("//d/a", "/w/a", 3, "text", None, "abc", None), ("//d/b", None, None, None, None, None, "unknown action: zap"), ("//d/c", None, None, None, "strange", None, None)]
    (tmp_path / "g.txt").write_bytes(block.replace("\n", "\r\n").encode() + b"\r\n\r\n" + block.encode())
    assert records.parse_tagged_records(spark, str(tmp_path / "g.txt")).count() == 2
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "seq long, value string")
    have = records.parse_have(lines('{"code":"stat","path":"/A","syncTime":"5"}', '{"code":"stat","path":"/A","syncTime":"x"}', '{"code":"info","path":"/B"}', "cut {"), "unix")
    assert [tuple(r) for r in have.collect()] == [("/A", None)]
    where = records.parse_where(lines('{"path":"/A","depotFile":"//d/a"}', '{"path":"/A","depotFile":"//d/b","unmap":""}', '{"path":"/C"}', "x"))
    assert [tuple(r) for r in where.collect()] == [("/A", "//d/b", True)]
    native = records.parse_native_reconcile(lines('{"action":"add","depotFile":"//a","clientFile":"/a","workRev":"1"}', '{"action":"move","depotFile":"//b","clientFile":"/b","workRev":"4"}', '{"action":"edit","depotFile":"//c"}'))
    assert sorted((r["class"], r["rev"]) for r in native.collect()) == [("add", None), ("edit", 4)]
    (tmp_path / "feed.json").write_text('{"code":"stat","depotFile":"//d/a","rev":"1"}\n{"code":"st')
    with pytest.raises(Exception):
        records.read_preview_feed(spark, str(tmp_path / "feed.json")).collect()


def test_sinks(spark, tables, tmp_path):
    result = reconcile(spark, tables)
    objects = [json.loads(r["value"]) for r in sinks.plan_lines(result.plan).collect()]
    by = {o["clientFile"]: o for o in objects}
    assert len(objects) == 5 and by["/w/1"]["rev"] == "1" and "rev" not in by["/w/3"] and "stage" not in by["/w/1"] and by["/w/4"]["action"] == "revert"
    assert [json.loads(r["value"])["action"] for r in sinks.handoff_lines(result.plan).collect()] == ["reconcile"]
    conflicts = spark.createDataFrame([("delete_modified", None, "//d/a", "/w/a", "3", None, False)], schemas.CONFLICTS)
    assert json.loads(sinks.conflict_lines(conflicts).first()[0])["action"] == "not deleted"
    assert json.loads(sinks.unmatched_lines(spark.createDataFrame([("dir", "/x")], "kind string, path string")).first()[0]) == {"kind": "unmatched", "path": "/x", "type": "dir"}
    assert json.loads(sinks.error_lines(spark, "bad").first()[0]) == {"kind": "error", "message": "bad"}
    sinks.write_listing(result.plan, "open", f"{tmp_path}/list")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/list").collect()]
    assert lines[:2] == [sinks.TITLES["open"]["add"].format(1), 'Add "/w/3".'] and lines[-1] == 'Revert Delete "/w/5".' and len(lines) == 10
    sinks.write_lines(sinks.plan_lines(result.plan), f"{tmp_path}/plan")
    sinks.write_summary(result.summary, f"{tmp_path}/summary")
    assert spark.read.text(f"{tmp_path}/plan").count() == 5 and records.read_run_logs(spark, f"{tmp_path}/summary").first()["total"] == 5
    assert [r["spec"] for r in sinks.query_specs(spark.createDataFrame([("include", "dir", "/w/a#"), ("include", "file", "/w/b"), ("exclude", "dir", "/c")], "role string, kind string, path string")).collect()] == ["/w/a%23/...", "/w/b"]
    clean = sinks.export_specs(reconcile(spark, tables, "clean").plan.where("class <> 'handoff'"))
    assert {(r["class"], r["spec"]) for r in clean.collect()} == {("revert", "//d/1#1"), ("restore", "//d/2#1"), ("delete", "/w/3#none")}


def test_ignores(spark):
    asked = spark.createDataFrame([("/w/a",), ("/w/b",), ("/w/é",)], "path string")
    lines = spark.createDataFrame([("/w/a ignored",), ("/w/zz ignored",), ("what",)], "value string")
    got, odd = ignore.ignored_of(lines, asked)
    assert [r[0] for r in got.collect()] == ["/w/a"] and sorted(r[0] for r in odd.collect()) == ["/w/zz ignored", "what"]
    assert [r[0] for r in ignore.refused_adds(spark.createDataFrame([("/W/B - ignored file can't be added.",)], "value string"), asked, "macos").collect()] == ["/w/b"]
    ascii_, other = ignore.split_by_ascii(asked)
    assert ascii_.count() == 2 and other.count() == 1
    verdicts = spark.createDataFrame([("/w/a", True), ("/w/a", True), ("/w/b", False)], "path string, ignored boolean")
    assert ignore.ignored_paths(asked, verdicts, False)[1].isEmpty() and sorted(r[0] for r in ignore.ignored_paths(asked, verdicts, True)[1].collect()) == ["/w/a", "/w/é"]
    rules = spark.createDataFrame([("#FILE x",), ("#LINE 1:*.o",)], "value string")
    dirs = spark.createDataFrame([("/w/out", 1, False), ("/w/out/sub", 2, False), ("/w/keep", 1, False)], "dir_key string, depth int, nested_ignore boolean")
    gate = lambda name="x/.p4ignore", **k: ignore.prune_gate(ignore.ignore_rule_summary(rules), dirs, name.split("/")[-1], **k).first()[0]
    assert gate() and not gate("p4ignore.txt") and not gate(enabled=False) and not gate(force_sync=True)
    assert not ignore.prune_gate(ignore.ignore_rule_summary(rules.union(spark.createDataFrame([("!a",)], "value string"))), dirs, ".p4ignore").first()[0]
    yes = spark.createDataFrame([(p, True) for p in ("/w/out", "/w/out/__probe__", "/w/out/sub", "/w/out/sub/__probe__", "/w/keep")], "path string, ignored boolean")
    assert [r[0] for r in ignore.prunable_dirs(dirs, yes).collect()] == ["/w/out"]
    assert sorted(r[0] for r in ignore.ask_below(dirs, spark.createDataFrame([("/w/out",)], "dir_key string")).select("dir_key").collect()) == ["/w/keep"]
    assert ignore.probes(dirs).count() == 3


def test_untracked_rules(spark):
    counts = untracked.cross_check_counts(spark.createDataFrame([("tracked",), ("untracked",), ("untracked",)], "verdict string")).first()
    assert counts["untracked"] == 2 and counts["outside_view"] == 0
    empty = spark.createDataFrame([], schemas.DEPOT)
    with pytest.raises(PlanRefused, match="empty_depot"):
        untracked.discover_untracked(None, empty, None, None)
    view = spark.createDataFrame([("/w/a", "//d/a", False)], schemas.VIEW_MAP)
    targets = spark.createDataFrame([("//d/a", "file"), ("//d/b", "file")], "depot_file string, kind string")
    assert [r["key"] for r in untracked.translate_depot_paths(targets, view).collect()] == ["/w/a"]
    with pytest.raises(PlanRefused, match="unmapped_target"):
        untracked.translate_depot_paths(targets, view, strict=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.choice([1, 5, 30, 200])) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, spec string")
    packed = sorted(batching.pack_batches(df, 100, 7, 5).collect(), key=lambda r: r["seq"])
    shards = {}
    for r in packed:
        shards.setdefault(r["shard"], []).append(r)
    for part in shards.values():
        size = n = batch = 0
        for k, r in enumerate(part):
            b = len(r["spec"]) + 1
            if k and n and (size + b > 100 or n >= 7):
                batch, size, n = batch + 1, 0, 0
            size, n = size + b, n + 1
            assert r["batch"] == batch
    ids = batching.batch_ids(df, 100, 7, 5).groupBy("shard", "batch").agg(F.count("*").alias("n"), F.sum(F.octet_length("spec") + 1).alias("b"), F.max(F.octet_length("spec") + 1).alias("m")).collect()
    assert all(r["n"] <= 7 and r["b"] < 100 + r["m"] for r in ids)
    assert batching.balanced_batches(df, 10**6, 10**6, 10, 1).select("batch").distinct().count() in range(10, 22) and batching.batch_ids(df.where("false"), 10, 10).isEmpty()


LOG = [
    ("good", 1, "file", "add", None, None, None, None, None, None, None), ("good", 2, "p4CommandCount", None, None, None, None, None, None, 0, None), ("good", 3, "p4CommandCount", None, None, None, None, None, None, 1, None), ("good", 4, "progress", None, None, None, None, None, None, None, 1),
    ("good", 5, "progress", None, None, None, None, None, None, None, 1), ("good", 6, "file", "handoff", None, None, None, None, None, None, None), ("good", 7, "summary", None, True, 1, {"add": 1}, 0, 1, None, None),
    ("failed", 1, "summary", None, False, 0, {}, 0, 0, None, None), ("counts", 1, "summary", None, True, 1, {"add": 1}, 0, 0, None, None), ("conflicts", 1, "conflict", None, None, None, None, None, None, None, None), ("conflicts", 2, "summary", None, True, 0, {}, 0, 0, None, None),
    ("calls", 1, "p4CommandCount", None, None, None, None, None, None, 0, None), ("calls", 2, "summary", None, True, 0, {}, 0, 4, None, None), ("order", 1, "progress", None, None, None, None, None, None, None, 3), ("order", 2, "progress", None, None, None, None, None, None, None, 2),
    ("order", 3, "summary", None, True, 0, {}, 0, 0, None, None), ("incomplete", 1, "file", "add", None, None, None, None, None, None, None),
]
LOG_SCHEMA = "run_id string, seq long, kind string, class string, ok boolean, total long, counts map<string,long>, conflicts long, p4Calls long, count long, step long"
VERDICTS = {"good": "trusted", "failed": "failed", "counts": "counts", "conflicts": "conflicts", "calls": "calls", "order": "order", "incomplete": "incomplete"}


def test_run_log(spark):
    log = spark.createDataFrame(LOG, LOG_SCHEMA)
    assert {r["run_id"]: r["verdict"] for r in audit.validate_run_log(log).collect()} == VERDICTS
    assert {r["run_id"] for r in audit.trusted_rows(log).collect()} == {"good"} and [r["run_id"] for r in audit.progress_goes_back(log).collect()] == ["order"]


def test_run_log_stream(spark, tmp_path):
    log = spark.createDataFrame(LOG, LOG_SCHEMA)
    log.where("seq <= 3").coalesce(1).write.json(f"{tmp_path}/in")
    log.where("seq > 3").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.RUNLOG).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = jobs.trusted_runs(stream, "10 minutes").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:  # a processing-time timeout keeps batches coming, so the stream never counts as idle
        until = time.time() + 120
        while spark.sql("SELECT * FROM runs").count() < len(VERDICTS) - 1 and time.time() < until:
            time.sleep(1)
        got = {r["run_id"]: r["verdict"] for r in spark.sql("SELECT * FROM runs").collect()}
        assert got == {k: v for k, v in VERDICTS.items() if k != "incomplete"}
    finally:
        q.stop()


def test_cache_stream(spark, tmp_path):
    row = lambda k, d: (k, 1, d)
    for i, rows in enumerate([[row("a", "1"), row("b", "1")], [row("b", "2")]]):
        spark.createDataFrame(rows, "path_key string, size long, digest string").withColumn("mtime", F.timestamp_seconds(F.lit(i))).select("path_key", "size", "mtime", "digest").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.DIGEST_CACHE).parquet(f"{tmp_path}/in")
    q = jobs.maintain_digest_cache(stream, f"{tmp_path}/cache", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert {r["path_key"]: r["digest"] for r in inventory.load_digest_cache(spark, f"{tmp_path}/cache")[0].collect()} == {"a": "1", "b": "2"}


def test_cache_versions_after_a_crash(spark, tmp_path):
    """A half-written version is never read, a batch merged twice changes nothing, and old versions go."""
    row = lambda k, d: spark.createDataFrame([(k, 1, d)], "path_key string, size long, digest string").select("path_key", "size", F.timestamp_seconds(F.lit(1)).alias("mtime"), "digest")
    at = f"{tmp_path}/cache"
    held = lambda: {r["path_key"]: r["digest"] for r in inventory.load_digest_cache(spark, at)[0].collect()}
    inventory.save_digest_cache(row("a", "1"), at, "v0-x")
    (tmp_path / "cache" / "v1-y").mkdir()
    (tmp_path / "cache" / "v1-y" / "part-0.parquet").write_bytes(b"half")
    assert held() == {"a": "1"}
    for name in ("v1-z", "v1-again"):
        inventory.save_digest_cache(inventory.merge_digest_cache(inventory.load_digest_cache(spark, at)[0], row("b", "2")), at, name)
        assert held() == {"a": "1", "b": "2"}
    assert not (tmp_path / "cache" / "v0-x").exists()


def test_strict_mapping_and_restore(spark):
    files = spark.createDataFrame([("/w/a",), ("/w/b",)], "path_key string")
    view = spark.createDataFrame([("/w/a", "//d/a", False)], schemas.VIEW_MAP)
    with pytest.raises(PlanRefused, match="no_mapping"):
        untracked.map_paths(files, view, strict=True)
    assert untracked.map_paths(files, view).count() == 2


def _key(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_queries_keep_every_document(spark, tmp_path):
    """Line ends with CR, documents of a MiB and more, every language and charset, by brute force."""
    texts = ["a\r\nb\n", "a\rb", "\r\r\n", "Käse für 5 €", "naïve \r\n漢字", "", None, "x" * 1023, "x" * 1024, "y" * 999_999, "y" * 1_000_000, "z" * 1_048_576, "z" * 2_500_000]
    rows = [(4 * i + k, t, ("de", "en", "fr", "es")[i % 4]) for i, t in enumerate(texts) for k in range(4 if len(t or "") < 2000 else 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r[0]: tuple(r)[1:] for r in queries.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("human_bytes", "digest_text_md5", "digest_utf8_boms", "decode_charset_all")}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for d, t, _ in rows:
        n = None if t is None else len(t)
        size = None if n is None else f"{n} B" if n < 1 << 10 else f"{n / (1 << 10):.2f} KiB" if n < 1 << 20 else f"{n / (1 << 20):.2f} MiB"
        assert got["human_bytes"][d] == (size,)
        assert got["digest_text_md5"][d] == ((None, None) if t is None else (md5(t.replace("\n", "\r\n")), md5(t)))
        assert got["digest_utf8_boms"][d] == ((None,) * 3 if t is None else (md5(t.replace("\r\n", "\n")),) * 3)
        if t is None:
            want = (None, None)
        elif d % 4 == 0:  # bytes that aren't UTF-8 come back from Windows-1252
            want = (t.encode("cp1252", "replace").decode("cp1252"), False)
        else:
            want = ((t.encode() + b"\x81").decode("cp1252", "replace"), True) if d % 4 == 1 else (t, False)
        assert got["decode_charset_all"][d] == want
    assert all(len(x) == len(rows) for x in got.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(_key(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(_key(r[i]) for i in at) for r in want.fetchall()) and rows


def test_entry_without_the_training_data_operators(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "sylva.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 5
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_deduplication_names_are_used(spark):
    df = spark.createDataFrame([(3, "r", "//d/a", "/w/a", "1"), (1, "r", "//d/a", "/w/a", "1")], "seq long, reason string, depot_file string, client_file string, rev string")
    assert [r["seq"] for r in snapshots.dedupe_refusals(df).collect()] == [1]
    assert [r["path_key"] for r in snapshots.sorted_inventory(spark.createDataFrame([("/b", "/b"), ("/a", "/a")], "path string, path_key string")).collect()] == ["/a", "/b"]
    assert audit.same_multiset(df, df) and not audit.same_multiset(df, df.limit(1))
    assert record(1)[0] == 1 and OTHER != SAME
