"""Column functions, case by case."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sylva import queries
from sylva.functions import digests, kinds, messages, paths


def run(spark, cases, make, type_="string"):
    """Each case is (input, wanted); all inputs in one table."""
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"i int, x {type_}")
    got = {r["i"]: r["y"] for r in df.select("i", make(F.col("x")).alias("y")).collect()}
    for i, (x, want) in enumerate(cases):
        assert got[i] == want, (x, got[i], want)


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (lambda c: paths.normalize_sep(c, "windows"), [("a/b\\c", "a\\b\\c"), (None, None)]),
        (lambda c: paths.normalize_sep(c, "unix"), [("a/b\\c", "a/b\\c")]),
        (lambda c: paths.path_key(c, "windows"), [("C:/A/Ü", "c:\\a\\ü")]),
        (lambda c: paths.path_key(c, "macos"), [("/A/İ", "/a/i̇")]),
        (lambda c: paths.path_key(c, "unix"), [("/A/b", "/A/b")]),
        (paths.upper_drive, [("c:\\x", "C:\\x"), ("/c/x", "/c/x"), ("", "")]),
        (paths.resolve_dots, [("/a/./b/../c", "/a/c"), ("/../..", "/"), ("/a//b/", "/a/b"), ("C:/a/../../b", "C:/b")]),
        (lambda c: paths.canonical_path(c, "/ws"), [("a/../b", "/ws/b"), ("/x/.", "/x"), (".", "/ws"), ("a\\b", "/ws/a\\b")]),
        (lambda c: paths.canonical_path(c, "C:\\ws", "windows"), [("a/b", "C:\\ws\\a\\b"), ("d:/x/../y", "D:\\y")]),
        (lambda c: paths.directory_key(c), [("/a/b//", "/a/b"), ("/", "/"), ("//", "/")]),
        (lambda c: paths.directory_key(c, "windows"), [("C:\\", "c:\\"), ("C:\\A\\", "c:\\a")]),
        (paths.strip_recursive_suffix, [("/a/...", "/a"), ("/a/.../", "/a"), ("/a/.../...", "/a"), ("/...", "/"), ("C:\\...", "C:\\"), ("/a/b...", "/a/b..."), ("/a/f.txt", "/a/f.txt")]),
        (paths.escape_spec, [("a%#@*?b", "a%25%23%40%2A%3Fb"), ("%23", "%2523")]),
        (paths.parent_dir, [("/a/b", "/a"), ("/a", "/"), ("/a/b/c.txt", "/a/b")]),
        (lambda c: paths.parent_dir(c, "\\"), [("C:\\a\\b", "C:\\a"), ("C:\\a", "C:\\")]),
        (lambda c: F.array_join(paths.ancestors(c), "|"), [("/a/b", "/|/a|/a/b"), ("/a", "/|/a")]),
        (lambda c: F.array_join(paths.ancestors(c, "\\"), "|"), [("C:\\a\\b", "C:\\|C:\\a|C:\\a\\b")]),
        (messages.parse_ignored_line, [("/a b ignored", "/a b"), ("/a ignored ", None)]),
        (messages.parse_add_refusal_line, [("/w/a - ignored file can't be added.", "/w/a"), ("//d/a - ignored file can't be added.", None), ("x", None)]),
        (messages.ignore_rule_line_kind, [("#FILE h", "header"), ("#FILE  ", "unrecognized"), ("#LINE 3:*.log", "line"), ("#LINE 3:!a", "reinclude"), ("#LINE x:a", "unrecognized"), ("#LINE 3:", "unrecognized"), ("!x", "reinclude"), ("/a/...", "mapping"), ("C:\\a", "mapping"), ("...", "mapping"), ("", "unrecognized"), ("what", "unrecognized"), ("#X", "unrecognized")]),
        (digests.trim_line_ending, [("a\r\n", "a"), ("a\n", "a"), ("a\n\n", "a\n"), ("a", "a")]),
        (kinds.charset_codec, [("utf8", "utf-8"), ("cp936", "gbk"), ("none", None), ("utf32", None)]),
        (kinds.digest_type, [("text", "text"), ("unicode", "text"), ("utf16", "utf8"), ("symlink", "symlink"), ("apple", None)]),
    ],
)
def test_strings(spark, make, cases):
    run(spark, cases, make)


def test_is_under(spark):
    df = spark.createDataFrame([("/a/b", "/a", True), ("/ab", "/a", False), ("/a", "/a", False), ("/a", "/", True), ("/", "/", False)], "p string, d string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", paths.is_under(F.col("p"), F.col("d")).alias("got")).collect())


def test_client_syntax(spark):
    cases = {"windows": [("c:\\WS\\A\\b.txt", "//cl/A/b.txt", False), ("C:\\ws", "C:\\ws", True)], "unix": [("/ws/a", "//cl/a", False), ("/WS/a", "/WS/a", True), ("/ws2/a", "/ws2/a", True)], "macos": [("/WS/a", "/WS/a", True)]}
    for policy, rows in cases.items():
        out, bad = paths.client_syntax(F.col("p"), "C:\\ws" if policy == "windows" else "/ws", "cl", policy)
        got = spark.createDataFrame(rows, "p string, want string, degraded boolean").select("want", "degraded", out.alias("o"), bad.alias("b")).collect()
        assert all(r["o"] == r["want"] and r["b"] == r["degraded"] for r in got)
    with pytest.raises(ValueError, match="policy"):
        paths.path_key(F.col("p"), "vms")


def test_scope_paths(spark):
    rows = [
        ("src/deep", "dir", "src/deep", None), ("./src//deep/./", "dir", "src/deep", None), ("a/../b", "dir", "b", None), (".", "dir", ".", None), ("a/..", "dir", ".", None), ("使用 #1@x%.txt", "file", "使用 #1@x%.txt", None),
        ("", "dir", None, "empty:"), ("a\0b", "dir", None, "nul:"), ("a\\b", "dir", None, "backslash:"), ("/abs", "dir", None, "absolute:"), ("C:/w", "dir", None, "drive:"), ("a/*.txt", "dir", None, "pattern:"), ("a?", "file", None, "pattern:"),
        ("a/../../b", "dir", None, "above:"), ("a/...", "dir", None, "dots:"), ("../...", "dir", None, "above:"), (".../..", "dir", None, "dots:"), (".", "file", None, "root:"), ("..", "file", None, "above:"),
    ]
    path, reason = paths.scope_path(F.col("p"), F.col("k"))
    for r in spark.createDataFrame(rows, "p string, k string, want string, why string").select("*", path.alias("got"), reason.alias("reason")).collect():
        assert r["got"] == r["want"] and (r["why"] is None) == (r["reason"] is None) and (r["reason"] or "").startswith(r["why"] or ""), r


def test_case_equal(spark):
    rows = [("A/b", "a/B", True), ("É", "é", False), ("É", "É", True), ("a", "b", False)]
    assert all(r["w"] == r["g"] for r in spark.createDataFrame(rows, "a string, b string, w boolean").select("w", paths.case_equal_ascii(F.col("a"), F.col("b")).alias("g")).collect())


def test_actions_and_types(spark):
    a, err = kinds.parse_action(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame([("add",), ("move/delete",), ("Add",), ("zap",), (None,)], "x string").select(a, err).collect()]
    assert got == [("add", None), ("move/delete", None), (None, "unknown action: Add"), (None, "unknown action: zap"), (None, None)]
    t, raw = kinds.parse_file_type(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame([("text+w",), ("binary+l",), ("utf16",), ("utf8+x",), ("unicode",), ("xtext",), ("symlink",), (None,)], "x string").select(t, raw).collect()]
    assert got == [("text", None), ("binary", None), ("utf16", None), ("utf8", None), ("unicode", None), (None, "xtext"), ("symlink", None), (None, None)]
    with pytest.raises(Exception, match="unknown action"):
        spark.createDataFrame([("zap",)], "x string").select(kinds.require_action(F.col("x"))).collect()
    words = spark.createDataFrame([(m, c, w) for m, x in kinds.ACTION_WORDS.items() for c, w in x.items()] + [("open", "restore", "unknown")], "m string, c string, w string")
    assert words.where(kinds.action_for(F.col("m"), F.col("c")) != F.col("w")).count() == 0 and words.count() == 19
    c, err = kinds.native_class(F.col("x"))
    assert [tuple(r) for r in spark.createDataFrame([("refreshed",), ("zap",)], "x string").select(c, err).collect()] == [("update", None), (None, "unknown native action: zap")]


def test_digests(spark):
    md5 = lambda b: hashlib.md5(b).hexdigest()
    text = [(b"a\r\nb\r\n", b"a\nb\n"), (b"a\r\nb\nc", b"a\nb\nc"), (b"a\r\r\n", b"a\r\n"), (b"a\r", b"a\r"), (b"", b""), (b"\r\n\r\n", b"\n\n"), (bytes(range(256)), bytes(range(256)))]
    run(spark, [(a, md5(b)) for a, b in text], digests.digest_text, "binary")
    utf8 = [(b"\xef\xbb\xbfa\r\nb", b"a\nb"), (b"plain\r\n", b"plain\n"), (b"\xef\xbb\xbf", b""), ("\ufeffä\r\n".encode("utf-16-le"), "ä\n".encode()), ("\ufeffä".encode("utf-16-be"), "ä".encode())]
    run(spark, [(a, md5(b)) for a, b in utf8] + [(b"\xff\xfea", md5("\ufffd".encode())), (b"\xef\xbb\xbf\xff", md5("\ufffd".encode()))], digests.digest_utf8, "binary")
    run(spark, [("a\\b", md5(b"a/b\n"))], digests.digest_symlink)
    df = spark.createDataFrame([(b"a\r\n", "text"), (b"a\r\n", "binary"), (b"a\r\n", "utf8"), (b"a", "apple"), (b"t\r\n", "symlink")], "c binary, t string")
    assert [r[0] for r in df.select(digests.digest(F.col("c"), F.col("t"))).collect()] == [md5(b"a\n"), md5(b"a\r\n"), md5(b"a\n"), None, md5(b"t\n")]


def test_times(spark):
    rows = [("2024-01-01 00:00:00.9", 1704067200, True), ("2024-01-01 00:00:01.9", 1704067200, True), ("2024-01-01 00:00:02", 1704067200, False), ("2023-12-31 23:59:59", 1704067200, True), ("1969-12-31 23:59:59.5", -1, False), (None, 1, False), ("2024-01-01 00:00:00", None, False)]
    df = spark.createDataFrame(rows, "m string, s long, want boolean").withColumn("m", F.to_timestamp("m"))
    assert df.where(digests.unchanged_since_sync(F.col("m"), F.col("s")) != F.col("want")).count() == 0


def test_charsets(spark):
    for charset, text in (("utf8", "ä€"), ("cp936", "中文"), ("shiftjis", "日本"), ("cp1251", "Да"), ("utf16le", "x")):
        raw = text.encode(kinds.CODECS[charset])
        assert tuple(spark.createDataFrame([(raw,)], "c binary").select(digests.decode_charset(F.col("c"), charset).alias("d")).first()["d"]) == (text, False)
    assert tuple(spark.createDataFrame([(b"caf\xe9",), (None,)], "c binary").select(digests.decode_charset(F.col("c"), "utf8").alias("d")).first()["d"]) == ("café", False)
    rows = spark.createDataFrame([(b"\xef\xbb\xbfa",)], "c binary")
    assert bytes(rows.select(digests.strip_bom(F.col("c"), "utf8")).first()[0]) == b"a" and bytes(rows.select(digests.strip_bom(F.col("c"), "utf16le")).first()[0]) == b"\xef\xbb\xbfa"


def test_every_charset_by_brute_force(spark):
    rng = random.Random(5)
    raws = [bytes(range(256)), b"", None, b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82", "ä€\U0001f600".encode(), b"\xef\xbf\xbd", b"\x80\x81", b"a\0b"]
    raws += [bytes(rng.choices(range(256), k=rng.randrange(40))) for _ in range(200)] + [bytes([b]) for b in range(256)]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, c binary")

    def want(raw, codec):
        if raw is None:
            return None, None
        if codec == "utf-8":
            try:
                return raw.decode(), False
            except UnicodeDecodeError:
                codec = "cp1252"
        text = raw.decode(codec, "replace")
        return text, "\ufffd" in text

    names = [*{c: n for n, c in kinds.CODECS.items()}.values(), "unknown"]
    for row in df.select("i", *[digests.decode_charset(F.col("c"), n).alias(n) for n in names]).collect():
        for n in names:
            assert tuple(row[n]) == want(raws[row["i"]], kinds.CODECS.get(n, "utf-8")), (n, raws[row["i"]])


def test_utf8_stays_in_the_jvm(spark, monkeypatch):
    """Python gets nothing of a text that is UTF-8."""
    monkeypatch.setattr(digests, "_decode_batches", lambda content, codec: F.struct(F.concat(F.lit(f"{codec} "), F.hex(content)).alias("text"), F.lit(True).alias("replaced")))
    df = spark.createDataFrame([("ä".encode(),), (b"\xe4",), (b"",)], "c binary")
    got = df.select(digests.decode_charset(F.col("c"), "utf8").alias("d"))
    assert [tuple(r["d"]) for r in got.collect()] == [("ä", False), ("cp1252 E4", True), ("", False)]
    sent = []
    monkeypatch.setattr(digests, "_decode_batches", lambda content, codec: sent.append(content) or F.struct(F.lit("").alias("text"), F.lit(True).alias("replaced")))
    digests.decode_charset(F.col("c"), "utf8")
    assert [r[0] for r in df.select(sent[0]).collect()] == [None, b"\xe4", None]


@pytest.mark.parametrize("name", ["decode_charset", "decode_charset_all", "digest_utf8_boms"])
def test_whole_texts_go_in_small_batches(spark, sf, name):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    queries.QUERIES[name](spark, sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(32 << 20)


def test_messages(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert tuple(one("//d/a#b#12 - can't overwrite existing file C:\\w\\a - b", messages.parse_refusal)) == ("//d/a#b", "12", "overwrite_existing", "C:\\w\\a - b")
    assert one("//d/a#2 - can't eat file x", messages.parse_refusal) is None and one("d/a#2 - can't update modified file x", messages.parse_refusal) is None
    assert tuple(one("//d/g#1 - deleted as /w/g", messages.parse_deleted_notice)) == ("//d/g", "1", "/w/g")
    assert [tuple(v) for v in one("/a ignored by b ignored by /f:1:*", messages.verdict_candidates)] == [("/a", True, "b ignored by /f:1:*"), ("/a ignored by b", True, "/f:1:*")]
    assert [tuple(v) for v in one("/a not ignored", messages.verdict_candidates)] == [("/a", False, None)]
    assert one("x ignored by  ", messages.verdict_candidates) == []
    kinds_ = spark.createDataFrame([("stat", None), ("info", 0), ("error", 2), ("error", 3), ("error", None), ("odd", 1)], "c string, s int").select(messages.classify_feed_record(F.col("c"), F.col("s"))).collect()
    assert [r[0] for r in kinds_] == ["body", "notice", "diagnostic", "failure", "failure", "failure"]
    run(spark, [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KiB"), (3 << 29, "1.50 GiB")], messages.human_bytes, "long")
    assert [r[0] for r in spark.createDataFrame([(1, 3), (0, 0), (3, 3)], "s long, c long").select(messages.percent_skipped(F.col("s"), F.col("c"))).collect()] == [33, 0, 100]
