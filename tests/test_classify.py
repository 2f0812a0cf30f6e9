"""Decision tables as data, and laws that every plan obeys."""

import random

import pytest
from pyspark.sql import functions as F

from sylva import schemas
from sylva.operators import guards, snapshots
from sylva.plans import classify

SAME, OTHER = "aa", "bb"


def record(i, **x):
    base = {"seq": i, "depot_file": f"//d/{i}", "client_file": f"/w/{i}", "client_key": f"/w/{i}", "head_type": "text", "unsupported_type": None, "head_action": "edit", "head_rev": 1, "have_rev": 1, "action": None, "file_size": 100, "digest": SAME}
    return tuple((base | x).values())


def world(spark, cases):
    """cases: (record fields or None, file (size, filtered, digest, seconds after the sync) or None)."""
    depot = spark.createDataFrame([record(i, **r) for i, (r, _) in enumerate(cases) if r is not None], schemas.DEPOT)
    files = [(f"/w/{i}", f"/w/{i}", f[0], 1000 + f[3], f[1], f[2]) for i, (_, f) in enumerate(cases) if f is not None]
    ws = spark.createDataFrame(files, "path string, path_key string, size long, m long, filtered boolean, actual string").withColumn("mtime", F.timestamp_seconds("m"))
    have = ws.select("path_key", F.lit(1000).cast("long").alias("sync_time"))
    return depot, ws.select("path", "path_key", "size", "mtime", "filtered"), have, ws.select(F.col("path_key").alias("client_key"), F.col("actual").alias("computed"))


def outcomes(spark, cases, target=None, verify_all=False):
    depot, ws, have, computed = world(spark, cases)
    rows = classify.classify_open(depot, ws) if target is None else classify.classify_sync(depot, ws, target)
    cache = spark.createDataFrame([], schemas.DIGEST_CACHE)
    done = classify.resolve_digests(rows, have, cache, computed, verify_all)
    out = {i: set() for i in range(len(cases))}
    for r in done.collect():
        out[int(r["client_key"].rsplit("/", 1)[1])].add(r["class"] or r["side"] or r["error"].split(":")[0])
    return out


FILE, CHANGED, STALE = (100, False, SAME, 50), (100, False, OTHER, 50), (100, False, OTHER, 0)
HIDDEN = (100, True, OTHER, 50)
OPEN = [
    ({"unsupported_type": "new", "head_type": None}, None, {"handoff"}),
    ({"unsupported_type": "new", "head_type": None}, FILE, {"handoff"}),
    ({"head_action": "delete"}, None, set()),
    ({"head_action": "delete"}, FILE, {"add"}),
    ({"head_action": "move/delete", "action": "add"}, FILE, set()),
    ({"head_action": "delete", "action": "edit"}, FILE, {"rule 5"}),
    ({"head_action": "archive"}, FILE, {"archived"}),
    ({"head_action": "archive", "head_type": "apple"}, FILE, {"archived", "handoff"}),
    ({"have_rev": None}, None, set()),
    ({"have_rev": None}, FILE, {"unsynced"}),
    ({"action": "delete"}, FILE, {"revert_delete"}),
    ({"action": "delete"}, CHANGED, {"reopen_edit"}),
    ({"action": "delete"}, STALE, {"revert_delete"}),
    ({"action": "delete"}, HIDDEN, set()),
    ({"action": "delete", "head_type": "binary"}, (101, False, SAME, 50), {"reopen_edit"}),
    ({"action": "delete", "file_size": None}, FILE, {"rule 1"}),
    ({"action": "delete"}, None, set()),
    ({"action": "edit"}, None, {"reopen_delete"}),
    ({"action": "integrate"}, None, {"reopen_delete"}),
    ({"action": "edit"}, HIDDEN, set()),
    ({"action": "edit"}, FILE, {"revert_edit"}),
    ({"action": "edit"}, CHANGED, set()),
    ({"action": "edit", "head_type": "binary"}, (101, False, SAME, 50), set()),
    ({"action": "edit", "file_size": None}, FILE, {"rule 6"}),
    ({"action": "integrate"}, CHANGED, set()),
    ({}, None, {"delete"}),
    ({}, HIDDEN, set()),
    ({}, FILE, set()),
    ({}, CHANGED, {"edit"}),
    ({}, STALE, set()),
    ({"head_type": "binary"}, (101, False, SAME, 0), {"edit"}),
    ({"head_type": None, "file_size": None}, CHANGED, set()),
    ({"head_type": "apple"}, CHANGED, {"handoff"}),
    ({"action": "branch"}, None, {"rule 2"}),
    ({"action": "branch"}, FILE, {"rule 2", "rule 7"}),
    ({"action": "branch"}, HIDDEN, {"rule 2"}),
    ({"head_action": None, "head_rev": None, "have_rev": None, "action": "add"}, None, {"revert_add"}),
    ({"head_action": None, "head_rev": None, "have_rev": None, "action": "move/add"}, HIDDEN, {"revert_add"}),
    ({"head_action": None, "head_rev": None, "have_rev": None, "action": "add"}, FILE, set()),
    ({"head_action": None, "head_rev": None, "have_rev": None, "action": "edit"}, FILE, {"rule 3"}),
    ({"digest": None}, CHANGED, {"no expected digest"}),
    (None, FILE, {"add"}),
    (None, HIDDEN, set()),
]


def test_open_table(spark):
    got = outcomes(spark, [(r, f) for r, f, _ in OPEN])
    assert {i: (OPEN[i], x) for i, x in got.items() if x != OPEN[i][2]} == {}


SYNC = [  # record, file, target (rev, action) or None, outcome
    ({"action": "edit"}, None, None, set()),
    ({"unsupported_type": "new"}, FILE, None, {"handoff"}),
    ({}, FILE, None, {"delete"}),
    ({}, HIDDEN, None, {"delete"}),
    ({}, None, None, set()),
    ({}, FILE, (3, "delete"), {"delete"}),
    ({}, FILE, (3, "archive"), {"archived"}),
    ({}, None, (1, "edit"), {"restore"}),
    ({}, FILE, (2, "edit"), {"update"}),
    ({"have_rev": None}, FILE, (1, "edit"), {"update"}),
    ({"file_size": None}, FILE, (1, "edit"), {"missing file size"}),
    ({"head_type": "binary"}, (101, False, SAME, 0), (1, "edit"), {"revert"}),
    ({"head_type": "resource"}, FILE, (1, "edit"), {"handoff"}),
    ({}, FILE, (1, "edit"), set()),
    ({}, CHANGED, (1, "edit"), {"revert"}),
    ({}, STALE, (1, "edit"), set()),
]


@pytest.mark.parametrize("verify_all", [False, True])
def test_sync_table(spark, verify_all):
    target = spark.createDataFrame([(f"//d/{i}", *t) for i, (_, _, t, _) in enumerate(SYNC) if t], "depot_file string, rev long, action string")
    got = outcomes(spark, [(r, f) for r, f, _, _ in SYNC], target, verify_all)
    want = {i: x[3] for i, x in enumerate(SYNC)}
    if verify_all:
        want[len(SYNC) - 1] = {"revert"}
    assert got == want


def test_clean_is_a_projection_of_open(spark):
    cases = [(r, f) for r, f, x in OPEN if not any("rule" in y or "digest" in y for y in x)]
    depot, ws, have, computed = world(spark, cases)
    rows, cache = classify.classify_open(depot, ws), spark.createDataFrame([], schemas.DIGEST_CACHE)
    open_ = {(r["client_key"], r["class"]) for r in classify.resolve_digests(rows, have, cache, computed).collect() if r["class"]}
    clean = classify.resolve_digests(classify.project_clean(rows), have, cache, computed)
    clean = {(r["client_key"], {"edit": "revert"}.get(r["class"], r["class"])) for r in clean.collect() if r["class"]}
    to = {"add": "delete", "edit": "revert", "delete": "restore"}
    assert clean == {(k, to[c]) for k, c in open_ if c in to}
    parity = {(r["client_key"], r["class"]) for r in classify.native_parity(classify.resolve_digests(rows, have, cache, computed)).collect() if r["class"]}
    assert parity == {(k, {"revert_delete": "reopen_edit"}.get(c, c)) for k, c in open_ if c not in ("revert_add", "revert_edit")}


def test_random_worlds_give_each_file_one_class(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(400):
        r = None if rng.random() < 0.1 else {
            "head_action": rng.choice(["edit", "edit", "add", "delete", "archive", None]), "have_rev": rng.choice([None, 1, 2]), "action": rng.choice([None, None, "edit", "delete", "add", "integrate"]),
            "head_type": rng.choice(["text", "binary", "utf8", "apple"]), "file_size": rng.choice([100, 101]), "digest": rng.choice([SAME, OTHER]),
        }
        cases.append((r, None if rng.random() < 0.3 else (100, rng.random() < 0.2, rng.choice([SAME, OTHER]), rng.choice([0, 50]))))
    classes = set(schemas.PLAN) and {"add", "edit", "delete", "reopen_edit", "reopen_delete", "revert_add", "revert_edit", "revert_delete"}
    for out in outcomes(spark, cases).values():
        assert len(out & classes) <= 1


def test_cache_supplies_only_exact_hits(spark):
    depot, ws, have, _ = world(spark, [({}, CHANGED), ({}, CHANGED), ({}, CHANGED), ({}, CHANGED)])
    rows = classify.classify_open(depot, ws)
    files = {r["path_key"]: r for r in ws.collect()}
    cache = spark.createDataFrame([("/w/0", 100, files["/w/0"]["mtime"], OTHER), ("/w/1", 99, files["/w/1"]["mtime"], SAME), ("/w/2", 100, files["/w/0"]["mtime"].replace(microsecond=1), SAME)], schemas.DIGEST_CACHE)
    need = {r["client_key"]: r["found"] for r in classify.needs_content(rows, have, cache).collect()}
    assert need == {"/w/0": OTHER, "/w/1": None, "/w/2": None, "/w/3": None}
    none = spark.createDataFrame([], "client_key string, computed string")
    assert {(r["client_key"], r["class"] or r["error"]) for r in classify.resolve_digests(rows, have, cache, none).collect()} == {("/w/0", "edit"), *((f"/w/{i}", "content not read") for i in (1, 2, 3))}


def test_winners(spark):
    live, dead = {"head_action": "edit"}, {"head_action": "delete"}
    for a, b, first in [(live, dead, 0), (dead, live, 1), (live | {"have_rev": None}, live, 1), (live, live | {"have_rev": None}, 0), (dead, dead, 0), (dead, live | {"have_rev": None}, 1)]:
        df = spark.createDataFrame([record(0, **a, client_key="/w/x"), record(1, **b, client_key="/w/x")], schemas.DEPOT)
        assert snapshots.pick_winner(df).first()["seq"] == first
        assert [r["seq"] for r in snapshots.mark_winners(df).where("winner").collect()] == [first]


def test_loser_reports_once_with_the_winners_facts(spark):
    depot = spark.createDataFrame([record(0, client_key="/w/x", depot_file="//d/A"), record(1, client_key="/w/x", depot_file="//d/a", have_rev=None)], schemas.DEPOT)
    ws = spark.createDataFrame([], schemas.WORKSPACE)
    rows = classify.classify_open(depot, ws).collect()
    assert [(r["class"], r["depot_file"]) for r in rows] == [("delete", "//d/A")]


def test_guards(spark):
    plan = spark.createDataFrame([("restore", None), ("restore", 1)], "class string, have_rev long")
    assert not guards.first_download_counts(plan, plan).first()["refuse"]
    many = spark.range(100_001).select(F.lit("restore").alias("class"), F.lit(None).cast("long").alias("have_rev"))
    assert guards.first_download_counts(many, plan).first()["refuse"]
    empty = spark.createDataFrame([], schemas.TARGET)
    with pytest.raises(guards.PlanRefused, match="empty_target"):
        guards.empty_target_guard(empty, plan)
    with pytest.raises(guards.PlanRefused) as e:
        guards.refuse_if_any(spark.range(25), "some_rule", F.col("id").cast("string"), F.col("id"))
    assert e.value.total == 25 and e.value.samples == [str(i) for i in range(10)] and "and 15 more" in str(e.value)
    deletes = spark.createDataFrame([("/w/a",), ("/w/b",), ("/w/c",), ("/w/d",)], "client_file string")
    verdicts = spark.createDataFrame([("/w/a", False), ("/w/b", True), ("/w/c", False), ("/w/c", True)], "path string, ignored boolean")
    safe, bad = guards.protect_deletes(deletes, verdicts)
    assert [r[0] for r in safe.collect()] == ["/w/a"] and sorted(r[0] for r in bad.collect()) == ["/w/c", "/w/d"]
    e = spark.createDataFrame([(5, "late"), (2, "early"), (1, None)], "seq long, error string")
    assert tuple(guards.first_error(e).first()) == ("early", 2)


def test_as_of(spark):
    rev = spark.createDataFrame([("//d/a", 1, 10, "add"), ("//d/a", 2, 20, "edit"), ("//d/a", 3, 30, "delete"), ("//d/b", 1, 25, "add"), ("//D/A", 1, 5, "add"), ("//d/c", None, 1, "add"), ("//d/c", 1, 1, None)], "depot_file string, rev long, change long, action string")
    at = lambda cl: {(r["depot_file"], r["rev"], r["action"]) for r in snapshots.snapshot_as_of(rev, cl).collect()}
    assert at(20) == {("//d/a", 2, "edit"), ("//D/A", 1, "add")} and at(None) == at(1000) == {("//d/a", 3, "delete"), ("//d/b", 1, "add"), ("//D/A", 1, "add")}
    with pytest.raises(ValueError, match="1 or more"):
        snapshots.snapshot_as_of(rev, 0)


def test_baselines(spark):
    depot = spark.createDataFrame([record(0, head_rev=3, have_rev=2), record(1, head_rev=2, have_rev=2), record(2, depot_file="//d/Two", head_rev=3, have_rev=2), record(3, depot_file="//d/Ü", head_rev=3, have_rev=2), record(4, have_rev=None)], schemas.DEPOT)
    rev = spark.createDataFrame([("//d/0", 2, 1, "add", "binary", 7, "zz"), ("//d/1", 2, 1, "add", "binary", 7, "zz"), ("//D/TWO", 2, 1, "add", "binary", 7, "zz"), ("//d/ü", 2, 1, "add", "binary", 7, "zz")], schemas.REVISIONS)
    got = {r["seq"]: (r["head_type"], r["file_size"], r["head_rev"]) for r in snapshots.refresh_baselines(depot, rev).collect()}
    assert got == {0: ("binary", 7, 3), 1: ("text", 100, 2), 2: ("binary", 7, 3), 3: ("text", 100, 3), 4: ("text", 100, 1)}


def test_candidates(spark):
    df = spark.createDataFrame([(2, "update", "//d/a", 1, "/w/a"), (1, "update", "//d/a", 1, "/w/a"), (3, "add", "//d/b", 1, "/w/b"), (4, "add", "//d/b", 2, "/w/b")], "seq long, class string, depot_file string, rev long, client_file string")
    assert [r["depot_file"] for r in snapshots.conflicting_duplicates(df).collect()] == ["//d/b"]
    assert sorted(r["seq"] for r in snapshots.dedupe_candidates(df).collect()) == [1, 3]
