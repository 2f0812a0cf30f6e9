"""Files beyond one cell: fingerprints by chunks, content by path, walks that don't open what is excluded."""

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva.functions.digests import Digester, digest
from sylva.operators.guards import PlanRefused
from sylva.sources import content, inventory
from sylva.sources import walk as walks
from sylva.sources.tables import running

TEXTS = [
    b"", b"\r", b"\n", b"\r\n", b"a\r\nb\r\n", b"a\r\nb\nc", b"a\r\r\n", b"\r\n\r\n", b"a\r", b"\xef\xbb\xbf", b"\xef\xbb", b"\xef\xbb\xbfa\r\n\xc3\xa4", b"\xff\xfe", b"\xff\xfea\0\r\0\n\0", b"\xfe\xff\0a\0\r\0\n\xd8\x3d\xde\0",
    b"\xef\xbb\xbfbad \xff\xc3 end\xe6\x97", b"\xff\xfea\0\x3d\xd8b\0", b"\xff\xfea\0b", b"\xfe\xff\xd8\0\0a", b"no mark \xff\xc3", "中文\r\n".encode(), b"\xff", b"\xff\xfe\r\0", b"\0\1\r\n\2" * 99,
]


def by_definition(kind, raw):
    """The rules read off whole content."""
    if kind != "binary":
        for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if kind == "utf8" and raw.startswith(mark):
                raw = raw[len(mark) :].decode(codec, "replace").encode()
                break
        raw = raw.replace(b"\r\n", b"\n")
    return hashlib.md5(raw).hexdigest()


def by_chunks(kind, raw, chunk):
    d = Digester(kind)
    for k in range(0, len(raw), chunk):
        d.update(raw[k : k + chunk])
    return d.hexdigest()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 20])
def test_chunks_of_any_size(chunk):
    for raw in TEXTS:
        for kind in ("binary", "text", "utf8"):
            assert by_chunks(kind, raw, chunk) == by_definition(kind, raw), (kind, raw)
        assert by_chunks("symlink", raw, chunk) == by_definition("utf8", raw)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([b"", b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"]), st.lists(st.sampled_from([b"\r", b"\n", b"a", b"\0", b"\xd8", b"\xde", b"\xc3", b"\xa4", b"\xe6"]), max_size=20), st.integers(1, 9))
def test_any_bytes_in_any_chunks(mark, parts, chunk):
    raw = mark + b"".join(parts)
    for kind in ("binary", "text", "utf8"):
        assert by_chunks(kind, raw, chunk) == by_definition(kind, raw)


def test_columns_say_the_same(spark):
    df = spark.createDataFrame([(k, bytearray(raw), kind) for k, raw in enumerate(TEXTS) for kind in ("binary", "text", "utf8")], "k int, raw binary, kind string")
    for r in df.withColumn("d", digest(F.col("raw"), F.col("kind"))).collect():
        assert r["d"] == by_definition(r["kind"], bytes(r["raw"])), (r["kind"], bytes(r["raw"]))


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_chunk_tables(spark, chunk):
    """Chunks in any order; a gap, an overlap, a kind without rule, NULL chunks, an empty table."""
    rows = [(f"{kind}{k}", kind, at, bytearray(raw[at : at + chunk])) for kind in ("binary", "text", "utf8") for k, raw in enumerate(TEXTS) for at in range(0, max(1, len(raw)), chunk)]
    rows += [("gap", "text", 0, bytearray(b"ab")), ("gap", "text", 3, bytearray(b"c")), ("twice", "text", 0, bytearray(b"a")), ("twice", "text", 0, bytearray(b"a")), ("odd", None, 0, bytearray(b"a")), ("none", "text", 0, None)]
    df = spark.createDataFrame(rows, "path string, kind string, offset long, chunk binary")
    got = {r["path"]: (r["computed"], r["n_bytes"]) for r in content.fingerprint_chunks(df.repartition(5)).collect()}
    want = {f"{kind}{k}": (by_definition(kind, raw), len(raw)) for kind in ("binary", "text", "utf8") for k, raw in enumerate(TEXTS)}
    assert got == {**want, "gap": (None, 3), "twice": (None, 2), "odd": (None, 1), "none": (hashlib.md5(b"").hexdigest(), 0)}
    assert content.fingerprint_chunks(df.where("false")).isEmpty()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """3,000 files of 0 to 40 kB in directories down to four levels, some of them empty, and links."""
    root = tmp_path_factory.mktemp("tree")
    for k in range(3_000):
        at = root / f"a{k % 7}" / f"b{k % 11}" / f"c{k % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}.{'txt' if k % 2 else 'bin'}").write_bytes(TEXTS[k % len(TEXTS)] * (k % 50))
    (root / "a1" / "empty" / "deeper").mkdir(parents=True)
    os.symlink("../a2/b2", root / "a1" / "link")
    return root


def test_only_pending_files_are_read(spark, tree):
    inv = inventory.scan_inventory(spark, [str(tree)])
    assert inv.count() == 3_001
    pending = inv.where("path LIKE '%.txt'").withColumn("head_type", F.expr("CASE size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'binary' ELSE 'utf8' END"))
    pending = pending.unionByName(pending.limit(3)).unionByName(spark.createDataFrame([(f"{tree}/gone", "x", 5, None, False, "text"), (f"{tree}/a1", "x", 5, None, False, "text")], pending.schema))
    sizes = {r["path"]: (r["size"], r["head_type"]) for r in pending.collect()}
    for task_bytes in (1 << 16, 256 << 20):
        got = {r["path"]: r for r in content.fingerprint_files(pending, task_bytes, 1_000).collect()}
        assert got.keys() == sizes.keys()
        failed = {p for p, r in got.items() if r["error"]}
        assert {os.path.basename(p) for p in failed} == {"gone", "a1"}
        for path in got.keys() - failed:
            raw = open(path, "rb").read()
            assert got[path]["computed"] == by_definition(sizes[path][1], raw) and got[path]["n_bytes"] == len(raw)
        assert sum(r["n_bytes"] or 0 for r in got.values()) == sum(size for path, (size, _) in sizes.items() if path not in failed)
    read = {r["path"]: r for r in content.read_content(pending, 1 << 16).collect()}
    assert {p for p, r in read.items() if r["error"]} == failed
    assert all(bytes(read[p]["content"]) == open(p, "rb").read() for p in read.keys() - failed)
    linked = content.fingerprint_files(inv.where("path LIKE '%/link'").withColumn("head_type", F.lit("symlink"))).first()
    assert linked["computed"] == hashlib.md5(b"../a2/b2\n").hexdigest()


def test_tasks_are_even(spark):
    """One huge file, some large ones and many small ones: no task has more than its share and one file."""
    sizes = [10_000_000, *[900_000] * 7, *[100] * 5_000]
    dealt, tasks = content.deal_by_size(spark.createDataFrame([(f"f{k}", n) for k, n in enumerate(sizes)], "path string, size long"), 1_000_000, 1_000)
    rows = dealt.groupBy("task").agg(F.sum(F.col("size") + 1_000).alias("b"), F.max(F.col("size") + 1_000).alias("m"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == len(sizes) and max(r["task"] for r in rows) < tasks
    assert all(r["b"] <= 1_000_000 + r["m"] for r in rows)


def test_walk_never_opens_what_is_excluded(spark, tree):
    """Calls by level; a directory excluded deep down, a file, a pruned directory; empty directories count."""
    every = walks.walk(spark, [str(tree)])
    dirs = [d for d, _, _ in os.walk(tree)]
    assert every.listings == len(dirs) and {r["path"] for r in every.directories.collect()} == set(dirs)
    t = walks.totals(every).first()
    assert (t["files"], t["directories"], t["bytes"]) == (3_001, len(dirs), sum(os.lstat(os.path.join(d, f)).st_size for d, _, fs in os.walk(tree) for f in fs) + os.lstat(tree / "a1" / "link").st_size)
    out = spark.createDataFrame([("dir", f"{tree}/a1/b1"), ("file", f"{tree}/a2/b2/c2/f2.bin"), ("file", f"{tree}/a3"), ("dir", "/elsewhere")], "kind string, key string")
    cut = walks.walk(spark, [str(tree), f"{tree}/a1/b1/c0", f"{tree}/a5", f"{tree}/nowhere"], out, spark.createDataFrame([(f"{tree}/a4",)], "dir_key string"))
    gone = (f"{tree}/a1/b1", f"{tree}/a4")
    left = [d for d in dirs if not any(d == g or d.startswith(g + "/") for g in gone)]
    assert cut.listings == len(left) + 1  # and the root that isn't there
    assert {r["path"] for r in cut.directories.collect()} == set(left)
    paths = [r["path"] for r in cut.files.collect()]
    assert len(paths) == len(set(paths)) and set(paths) == {r["path"] for r in every.files.collect() if not r["path"].startswith(tuple(f"{g}/" for g in gone)) and not r["path"].endswith("/f2.bin")}


def test_unreadable_directories_refuse(spark, tree, monkeypatch):
    listed = inventory.walk

    def broken(*a, **k):
        got = listed(*a, **k)
        got.errors = spark.createDataFrame([("/w/x", "PermissionError: no")], "path string, error string")
        return got

    monkeypatch.setattr(inventory, "walk", broken)
    with pytest.raises(PlanRefused, match="unreadable_directory"):
        inventory.scan_inventory(spark, [str(tree)])


@pytest.mark.parametrize("range_rows", [7, 1_000])
def test_running_sums(spark, range_rows):
    df = spark.createDataFrame([((k * 37) % 100, k % 5, k) for k in range(300)], "a int, v long, k int")
    rows = running(df, ["a", "k"], "upto", "v", range_rows=range_rows).collect()
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (r["a"], r["k"])):
        total += r["v"]
        want[r["k"]] = total
    assert {r["k"]: r["upto"] for r in rows} == want and len(rows) == 300
    assert running(df.where("false"), ["k"], "n").isEmpty()
