"""Whole runs: refusals of wrong plans, files read in tasks, pruning from the top down, batches of the whole list."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva import schemas
from sylva.operators import audit, batching, guards, pruning
from sylva.operators.guards import PlanRefused
from sylva.plans.reconcile import Tables, reconcile
from sylva.sources import inventory
from tests.test_content import by_definition


def plan_of(result):
    return {(r["client_file"], r["class"]) for r in result.plan.collect()}


@pytest.fixture(scope="module")
def two_files(spark):
    """/w/a/x is at revision 5, /w/b/y at 3; both are on disk as they were synced."""
    depot = [(k, f"//d/{p}", f"/w/{p}", f"/w/{p}", "text", None, "edit", rev, rev, None, 1, "d") for k, (p, rev) in enumerate([("a/x", 5), ("b/y", 3)])]
    disk = [(f"/w/{p}", f"/w/{p}", 1, None, False) for p in ("a/x", "b/y")]
    digests = spark.createDataFrame([("/w/a/x", "d"), ("/w/b/y", "d")], "client_key string, computed string")
    return Tables(spark.createDataFrame(depot, schemas.DEPOT), spark.createDataFrame(disk, schemas.WORKSPACE), digests=digests)


def with_(tables, **other):
    return Tables(**{**vars(tables), **other})


def test_a_change_needs_revisions(spark, two_files):
    with pytest.raises(ValueError, match="revisions"):
        reconcile(spark, two_files, "sync", force=True, as_of=2)


def test_a_scope_narrows_the_target(spark, two_files):
    """Only a path outside of the scope has a revision: the target is empty within it, and nothing is deleted."""
    scope = spark.createDataFrame([("include", "dir", "/w/a", "/w/a")], schemas.SCOPE)
    judged = spark.createDataFrame([("/w/a/x", False, "r")], schemas.IGNORE_VERDICTS)
    other = spark.createDataFrame([("//d/b/y", 3, 1, "edit", "text", 1, "d")], schemas.REVISIONS)
    with pytest.raises(PlanRefused, match="empty_target"):
        reconcile(spark, with_(two_files, scope=scope, revisions=other, verdicts=judged), "sync", force=True, as_of=2)
    own = other.unionByName(spark.createDataFrame([("//d/a/x", 4, 1, "edit", "text", 1, "d"), ("//d/a/x", 5, 9, "edit", "text", 1, "d")], schemas.REVISIONS))
    got = reconcile(spark, with_(two_files, scope=scope, revisions=own, verdicts=judged), "sync", force=True, as_of=2)
    assert [(r["client_file"], r["class"], r["rev"]) for r in got.plan.collect()] == [("/w/a/x", "update", 4)]


def test_a_verdict_that_says_nothing_protects(spark, two_files):
    gone = spark.createDataFrame([("//d/a/x", 5, 1, "edit", "text", 1, "d"), ("//d/b/y", 4, 1, "delete", "text", 1, "d")], schemas.REVISIONS)
    silent = spark.createDataFrame([("/w/b/y", None, "r")], schemas.IGNORE_VERDICTS)
    with pytest.raises(PlanRefused, match="verdict_completeness"):
        reconcile(spark, with_(two_files, revisions=gone, verdicts=silent), "sync", force=True)
    safe, unjudged = guards.protect_deletes(two_files.depot, silent)
    assert safe.isEmpty() and unjudged.count() == 2


def test_answers_that_name_nothing(spark):
    specs = spark.createDataFrame([("//d/a#1",), ("//d/b - c#2",)], "spec string")
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [r["spec"] for r in audit.unacknowledged(specs, lines("//d/b - c#2 - updating /w/b - c")).collect()] == ["//d/a#1"]
    assert audit.unacknowledged(specs, lines()).count() == 2  # no answer at all: all are open
    with pytest.raises(PlanRefused, match="unreadable_answers"):
        audit.unacknowledged(specs, lines("all done", "//d/z#1 - updating /w/z"))


def test_files_are_read_where_they_are(spark, tmp_path):
    """Open files by their own bytes: a changed one, equal ones with other line ends and with a mark, one that can't be read."""
    raw = {"same.txt": b"a\r\nb\n", "changed.txt": b"new", "mark.u8": b"\xef\xbb\xbfx\r\n", "odd.u8": b"\xff\xfe\x00\xd8x"}
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    ws = inventory.scan_inventory(spark, [str(tmp_path)])
    kinds = {n: "utf8" if n.endswith("u8") else "text" for n in raw}
    depot = [(k, f"//d/{n}", f"{tmp_path}/{n}", f"{tmp_path}/{n}", kinds[n], None, "edit", 1, 1, None, 9, "0" if n == "changed.txt" else by_definition(kinds[n], raw[n])) for k, n in enumerate(raw)]
    tables = Tables(spark.createDataFrame(depot, schemas.DEPOT), ws)
    assert plan_of(reconcile(spark, tables, read_files=True)) == {(f"{tmp_path}/changed.txt", "edit")}
    os.remove(tmp_path / "same.txt")
    with pytest.raises(PlanRefused, match="unreadable_file"):
        reconcile(spark, tables, read_files=True)


def tree_of(rng):
    """(directories with depth, ignored by themselves, ignored as to their content) of a random tree."""
    dirs = {}
    for _ in range(120):
        path, depth = "/w", 0
        while rng.random() < 0.75 and depth < 6:
            path, depth = f"{path}/{rng.choice('abcdé')}", depth + 1
            dirs[path] = depth
    own = {d for d in dirs if rng.random() < 0.4}
    return dirs, own, {d for d in dirs if rng.random() < 0.6}


def by_hand(dirs, own, content):
    """Topmost pruned directories and the number of questions, level by level."""
    pruned, questions = set(), 0
    for d in sorted(dirs, key=dirs.get):
        if any(d.startswith(p + "/") for p in pruned) or not d.isascii():
            continue
        questions += 1
        if d in own:
            questions += 1
            if d in content:
                pruned.add(d)
    return pruned, questions


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pruning_asks_as_little_as_it_can(spark, seed):
    dirs, own, content = tree_of(random.Random(seed))
    table = spark.createDataFrame([(d, n, False) for d, n in dirs.items()], "dir_key string, depth int, nested_ignore boolean")
    rules = spark.createDataFrame([("#FILE /w/.p4ignore",), ("#LINE 1:*.o",)], "value string")
    lines = spark.createDataFrame([(f"{d} ignored",) for d in own] + [(f"{d}/__probe__ ignored",) for d in content], "value string")
    asked = []

    def ask(questions):
        asked.extend(r["path"] for r in questions.select("path").collect())
        return pruning.answers_from(lines)(questions)

    got = pruning.plan_pruning(table, rules, ask)
    want, questions = by_hand(dirs, own, content)
    assert {r["dir_key"] for r in got.pruned.collect()} == want and got.questions == questions == len(asked) == len(set(asked)) and got.candidates == len(dirs)
    strange = pruning.plan_pruning(table, rules, lambda q: pruning.answers_from(lines)(q).unionByName(spark.createDataFrame([("what?",)], "value string")))
    assert strange.fallback == "an answer can't be read" and strange.pruned.isEmpty()
    for other in ({"config_name": "x"}, {"config_name": None}, {"enabled": False}, {"force_sync": True}, {"rules": rules.limit(0)}, {"rules": rules.unionByName(spark.createDataFrame([("!keep",)], "value string"))}, {"directories": table.withColumn("nested_ignore", F.lit(True))}):
        asked.clear()
        refused = pruning.plan_pruning(**{"directories": table, "rules": rules, "ask": ask, **other})
        assert refused.fallback and refused.pruned.isEmpty() and not asked
    assert pruning.plan_pruning(table.limit(0), rules, ask).pruned.isEmpty()


def test_pruning_reads_its_tables_once(spark):
    """Rows made of directories and of recorded answers, over three levels, by counting; each question is answered once."""
    made = {"dirs": spark.sparkContext.accumulator(0), "lines": spark.sparkContext.accumulator(0), "answers": spark.sparkContext.accumulator(0)}

    def counted(df, name, column):
        seen = made[name]

        @F.udf("string")
        def same(x):
            seen.add(1)
            return x

        return df.withColumn(column, same.asNondeterministic()(column))

    dirs = [(f"/w/{'/'.join(p)}", len(p), False) for p in ("a", "b", "bc", "bd", "bce")]
    lines = [f"/w/{x} ignored" for x in ("a", "a/__probe__", "b", "b/c/e", "b/c/e/__probe__")]
    table = counted(spark.createDataFrame(dirs, "dir_key string, depth int, nested_ignore boolean"), "dirs", "dir_key")
    known = pruning.answers_from(counted(spark.createDataFrame([(x,) for x in lines], "value string"), "lines", "value"))
    rules = spark.createDataFrame([("#FILE /w/.p4ignore",)], "value string")
    got = pruning.plan_pruning(table, rules, lambda q: counted(known(q), "answers", "value"))
    assert {r["dir_key"] for r in got.pruned.collect()} == {"/w/a", "/w/b/c/e"} and got.questions == 8
    assert {n: c.value for n, c in made.items()} == {"dirs": len(dirs), "lines": len(lines), "answers": len(lines)}


def test_a_run_prunes(spark):
    """Files in ignored directories are no adds, but tracked ones among them are still compared; without pruning all count."""
    files = ["out/a.o", "out/sub/b.o", "out2/c.o", "held/d.o", "held/t", "src/e"]
    disk = [(f"/w/{f}", f"/w/{f}", 1, None, False) for f in files]
    depot = [(1, "//d/held/t", "/w/held/t", "/w/held/t", "text", None, "edit", 1, 1, None, 1, "d")]
    lines = [f"/w/{d}{x} ignored" for d in ("out", "held") for x in ("", "/__probe__")] + ["/w/out2 ignored"]
    one = lambda x: spark.createDataFrame([(v,) for v in x], "value string")
    t = Tables(
        spark.createDataFrame(depot, schemas.DEPOT), spark.createDataFrame(disk, schemas.WORKSPACE), digests=spark.createDataFrame([("/w/held/t", "e")], "client_key string, computed string"),
        rule_lines=one(["#FILE /w/.p4ignore", "#LINE 1:out"]), ignore_lines=one(lines),
    )
    got = reconcile(spark, t, roots=("/w",))
    assert plan_of(got) == {("/w/out2/c.o", "add"), ("/w/src/e", "add"), ("/w/held/t", "edit"), ("/w/held/d.o", "add")}
    assert {r["dir_key"] for r in got.side["pruned"].collect()} == {"/w/out", "/w/held"}
    assert tuple(got.side["pruning"].first()) == (5, 7, None)
    whole = reconcile(spark, t, roots=("/w",), prune=False)
    assert len(plan_of(whole)) == 6 and whole.side["pruning"].first()["fallback"] == "switched off"


def greedy(sizes, max_bytes, max_rows):
    out, batch, used, held = [], 0, 0, 0
    for n in sizes:
        if held and (used + n > max_bytes or held >= max_rows):
            batch, used, held = batch + 1, 0, 0
        used, held = used + n, held + 1
        out.append(batch)
    return out


@pytest.mark.parametrize(("seed", "range_rows"), [(1, 50), (2, 100_000), (3, 13)])
def test_fewest_batches_of_the_whole_list(spark, seed, range_rows):
    """Against the sequential sum: rows above the limit, gaps in seq, both limits."""
    rng = random.Random(seed)
    rows = [(k * k, "é" * rng.choice([0, 1, 5, 20, 200])) for k in range(400)]
    df = spark.createDataFrame(rows, "seq long, spec string").repartition(5)
    got = {r["seq"]: r["batch"] for r in batching.fewest_batches(df, 100, 7, range_rows=range_rows).collect()}
    want = greedy([len(s.encode()) + 1 for _, s in rows], 100, 7)
    assert [got[seq] for seq, _ in rows] == want
    many = batching.fewest_batches(df, 10**9, 10**9, 16, range_rows).groupBy("batch").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("batch").collect()
    assert len(many) >= 16 and all(x["b"] < y["a"] for x, y in zip(many, many[1:], strict=False)) and [r["batch"] for r in many] == list(range(len(many)))
    assert batching.fewest_batches(df.where("false"), 10, 10).isEmpty() and batching.fewest_batches(df, 10**9, 10**9).select("batch").distinct().count() == 1


@pytest.mark.parametrize(("levels", "bits"), [(1, 2), (3, 8), (4, 3)])
def test_changed_rows(spark, monkeypatch, levels, bits):
    """Repeats, NULL in each place, rows of one side only, a row that is very frequent, equal and empty tables."""
    monkeypatch.setattr(audit, "LEVEL_BITS", bits)
    rng = random.Random(levels)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), k % 40) for k in range(1_500)] + [(None, None, 0)] * 700
    other = [r for r in rows if rng.random() < 0.98] + [(7, "new", 7)] * 3 + rows[:5]
    schema = "a int, b string, c int"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    n, m = Counter(rows), Counter(other)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.changed_rows(left, right, levels).collect()}
    assert got == {r: (n[r], m[r]) for r in n.keys() | m.keys() if n[r] != m[r]}
    assert audit.same_multiset(left, left.repartition(7).select("c", "a", "b")) and not audit.same_multiset(left, right) and not audit.same_multiset(left, left.unionByName(left.limit(1)))
    assert not audit.same_multiset(spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int"))
    assert audit.changed_rows(left.limit(0), left.limit(0)).isEmpty() and not audit.same_multiset(left, left.drop("a"))


def test_only_differing_ranges_move(spark):
    """One row in 100,000 differs: the last shuffle reads a few rows a side."""
    a = spark.range(100_000).withColumn("v", F.col("id") % 7)
    b = a.withColumn("v", F.when(F.col("id") == 77, 9).otherwise(F.col("v")))
    assert {tuple(r) for r in audit.changed_rows(a, b).collect()} == {(77, 0, 1, 0), (77, 9, 0, 1)}
