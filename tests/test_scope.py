"""Scope documents, scope algebra and containment."""

import json

import pytest
from pyspark.sql import functions as F

from sylva.operators import containment, guards, scope
from sylva.sources.records import read_scope_documents

DOCUMENTS = [  # text, part of the error or None
    ("{}", None), ('{"include": []}', None), ('{"exclude": []}', None), ('{"include": [{"dir": "."}]}', None), ('{"include": [{"dir": "a�b"}]}', None), ('{"include": [{"file": "x y;z"}], "exclude": [{"dir": "g"}]}', None),
    ("", "syntax:"), ("\ufeff{}", "syntax:"), ("[]", "object:"), ("null", "object:"), ('{"include": null}', "list:"), ('{"include": ["a"]}', "object:"),
    ('{"include": [{"dir": 7}]}', "text:"), ('{"include": [{}]}', "one:"), ('{"include": [{"dir": "a", "file": "b"}]}', "one:"), ('{"include": [{"path": "a"}]}', "field:"), ('{"focus": []}', "field:"),
    ('{"include": [], "include": []}', "twice:"), ('{"include": [{"dir": "a", "dir": "b"}]}', "twice:"), ('{"include": [{"dir": "/abs"}]}', "absolute:"), ('{"include": [{"dir": "C:/w"}]}', "drive:"),
    ('{"include": [{"dir": "a\\\\b"}]}', "backslash:"), ('{"include": [{"dir": "a/../../b"}]}', "above:"), ('{"include": [{"dir": "a/*"}]}', "pattern:"), ('{"include": [{"dir": "a/..."}]}', "dots:"), ('{"include": [{"file": "."}]}', "root:"),
    ('{"include": [{"dir": ""}]}', "empty:"), ('{"include": [' + ",".join(['{"dir": "abcdefgh"}'] * 60000) + "]}", "large:"),
]


def test_documents(spark):
    raw = [(i, t.encode()) for i, (t, _) in enumerate(DOCUMENTS)] + [(100, b'{"include":[{"dir":"x\xff"}]}'), (101, b'{"include":[{"dir":"x\xc3("}]}'), (102, None)]
    rows = read_scope_documents(spark.createDataFrame(raw, "doc_id long, content binary")).collect()
    for i, (_, why) in enumerate(DOCUMENTS):
        errors = [r["error"] for r in rows if r["doc_id"] == i and r["error"]]
        assert bool(errors) == bool(why) and all(e.startswith(why) for e in errors), (i, errors)
    assert all(r["error"].startswith("encoding:") for r in rows if r["doc_id"] in (100, 101)) and [r["error"] for r in rows if r["doc_id"] == 102] == ["missing: there is no document"]
    assert {r["doc_id"]: r["include_given"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0: False, 1: True, 2: False}


D, FILE = "dir", "file"
CASES = [  # config or None, targets or None, run excludes, include, exclude, members, refused rule
    (None, [(D, ".")], [], ["."], [], {"a.txt": True}, None),
    (None, None, [], None, None, None, "no_path"),
    (None, [(FILE, "readme.txt")], [], ["readme.txt"], [], {"readme.txt": True, "readme.txt.bak": False, "src/readme.txt": False}, None),
    ({}, None, [], ["."], [], {"a/b/c.txt": True}, None),
    ({"include": []}, [(D, ".")], [], None, None, None, "no_overlap"),
    ({"include": [{"dir": "src"}]}, [(D, ".")], [], ["src"], [], {"src/a": True, "srcx/a": False, "a": False}, None),
    ({"include": [{"dir": "src"}], "exclude": [{"dir": "src/gen"}]}, None, [], ["src"], ["src/gen"], {"src/a": True, "src/gen/o": False, "src/gen2/o": True}, None),
    ({"exclude": [{"file": "l.txt"}]}, None, [], ["."], ["l.txt"], {"l.txt": False, "l.txt.bak": True, "s/l.txt": True}, None),
    ({"include": [{"dir": "src"}]}, [(D, "docs")], [], None, None, None, "no_overlap"),
    ({}, [(D, "src/deep")], [], ["src/deep"], [], {"src/deep/c": True, "src/a": False}, None),
    ({}, [(D, "/other")], [], None, None, None, "no_overlap"),
    ({}, [(D, "/")], [], ["."], [], {"a": True}, None),
    ({"include": [{"dir": "Src"}]}, None, [], ["Src"], [], {"Src/a": True, "src/a": False}, None),
    ({"include": [{"dir": "./a//b/."}, {"dir": "x/../c"}]}, None, [], ["a/b", "c"], [], {"a/b/1": True, "c/1": True, "a/1": False}, None),
    ({"include": [{"dir": "a"}, {"dir": "a/b"}, {"file": "a/f"}]}, None, [], ["a"], [], {"a/b/1": True}, None),
    ({"exclude": [{"dir": "gen"}]}, [(D, ".")], [(D, "scratch"), (FILE, "l.txt")], ["."], ["gen", "l.txt", "scratch"], {"gen/a": False, "scratch/b": False, "l.txt": False, "m": True}, None),
    ({}, [(D, ".")], [], ["."], [], {".scope": False, "a": True}, None),
    ({"exclude": [{"dir": "s/d"}]}, [(D, "s/d")], [], None, None, None, "no_overlap"),
    ({"include": [{"dir": "src"}]}, [(D, "src/deep"), (D, "docs")], [], None, None, None, "dropped_targets"),
    ({"include": [{"file": "src/a.txt"}]}, [(D, "src")], [], ["src/a.txt"], [], {"src/a.txt": True, "src/b.txt": False}, None),
    ({"exclude": [{"dir": "docs"}]}, [(D, "src"), (D, "docs")], [], ["src"], ["docs"], {"src/a": True, "docs/a": False}, None),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_scopes(spark, case):
    config, targets, excludes, include, exclude, members, refused = case
    root = "/ws"
    parsed = None
    if config is not None:
        parsed = read_scope_documents(spark.createDataFrame([(1, json.dumps(config).encode())], "doc_id long, content binary")).where("kind IS NOT NULL")
    given = None if targets is None else scope.entries(spark, targets, root)
    more = scope.entries(spark, excludes, root) if excludes else None
    build = lambda: scope.build_scope(spark, root, parsed, "include" in (config or {}), given, more, ".scope")
    if refused:
        with pytest.raises(guards.PlanRefused, match=refused):
            build()
        return
    made = build()
    rows = made.collect()
    full = lambda p: root if p == "." else f"{root}/{p}"
    assert sorted(r["path"] for r in rows if r["role"] == "include") == sorted(map(full, include))
    assert sorted(r["path"] for r in rows if r["role"] == "exclude") == sorted(map(full, exclude))
    df = spark.createDataFrame([(full(p), want) for p, want in members.items()], "key string, want boolean")
    assert containment.in_scope(df, made, "key").where("in_scope <> want").count() == 0
    kept = {r["key"] for r in containment.scope_exclude(containment.scope_filter(df, made, "key"), made, "key").collect()}
    assert kept == {full(p) for p, want in members.items() if want}


@pytest.mark.parametrize(("policy", "folds"), [("windows", True), ("macos", True), ("unix", False)])
def test_case_policies(spark, policy, folds):
    root, sep = ("C:\\ws", "\\") if policy == "windows" else ("/ws", "/")
    entries = spark.createDataFrame([("include", "dir", "Src")], "role string, kind string, path string")
    made = scope.build_scope(spark, root, entries, True, policy=policy)
    from sylva.functions.paths import path_key

    df = spark.createDataFrame([(f"{root}{sep}src{sep}a.txt",)], "path string").withColumn("key", path_key(F.col("path"), policy))
    assert containment.scope_filter(df, made, "key", sep).count() == int(folds)


def test_predicate_and_join_agree(spark, monkeypatch):
    paths = spark.createDataFrame([(f"/a/{i}/{j}/f{k}",) for i in range(6) for j in range(4) for k in range(3)] + [("/a",), ("/",), ("/ab/1",), (None,)], "key string")
    entries = spark.createDataFrame([("dir", "/a/1"), ("dir", "/a/2/3"), ("file", "/a/4/0/f1"), ("file", "/a/5"), ("dir", "/a/5/1/f2")], "kind string, key string")
    by = lambda f: sorted(r["key"] or "" for r in f(paths, entries, "key").collect())
    few = by(containment.keep_covered), by(containment.drop_covered)
    monkeypatch.setattr(containment, "PREDICATE_ENTRIES", 0)
    assert few == (by(containment.keep_covered), by(containment.drop_covered)) and len(few[0]) == 12 + 3 + 1 + 1
    monkeypatch.setattr(containment, "BROADCAST_ROWS", 0)
    assert few[0] == by(containment.keep_covered)


def test_dirs_targets_and_matches(spark):
    inv = spark.createDataFrame([(f"/ws/{p}", f"/ws/{p}", 1) for p in ("a/b/f", "a/.p4ignore", "c/d/.P4IGNORE", ".p4ignore", "g")], "path string, path_key string, size long")
    got = {r["dir_key"]: (r["depth"], r["nested_ignore"]) for r in containment.list_directories(inv, "/ws", fold=True).collect()}
    assert got == {"/ws/a": (1, True), "/ws/a/b": (2, False), "/ws/c": (1, False), "/ws/c/d": (2, False)} or got["/ws/a"] == (1, True)
    args = spark.createDataFrame([("a",), ("g",), ("new",), ("x/...",), ("//depot/main/...",), ("//depot/f",)], "path string")
    kinds = {(r["key"], r["kind"], r["depot"]) for r in scope.parse_targets(args, containment.list_directories(inv, "/ws"), "/ws").collect()}
    assert kinds == {("/ws/a", "dir", False), ("/ws/g", "file", False), ("/ws/new", "file", False), ("/ws/x", "dir", False), ("//depot/main", "dir", True), ("//depot/f", "file", True)}
    rows = spark.createDataFrame([("include", "dir", "/ws/a"), ("include", "file", "/ws/g"), ("include", "file", "/ws/a"), ("include", "dir", "/ws/zz")], "role string, kind string, key string")
    missing = containment.unmatched_entries(rows, inv.select(F.col("path_key").alias("client_key")), inv)
    assert sorted((r["kind"], r["key"]) for r in missing.collect()) == [("dir", "/ws/zz"), ("file", "/ws/a")] and containment.scope_matched(rows, missing).first()[0] == 2
