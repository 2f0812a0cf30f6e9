"""Readers of the versioned store's record formats, as column expressions over text lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import schemas
from sylva.functions.kinds import parse_action, parse_file_type
from sylva.functions.paths import path_key, scope_path
from sylva.sources.ordered import RANGE_BYTES, ordered_records

# The keys of a tagged record.
TAGGED_KEYS = ("depotFile", "clientFile", "headAction", "headType", "headRev", "haveRev", "digest", "fileSize", "action")
MAX_DOCUMENT = 1 << 20


def parse_tagged_blocks(blocks: DataFrame, policy: str = "unix") -> DataFrame:
    """Depot rows and an ``error`` column from blocks (seq, value) of ``... key value`` lines: unknown keys are ignored,
    the last of equal keys counts, an unknown file type becomes unsupported_type, an unknown action an error."""
    line = lambda x: F.regexp_extract(x, r"^\.\.\. (\S+)", 1)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: line(x).isin(*TAGGED_KEYS))
    got = blocks.select("seq", lines.alias("lines")).where(F.size("lines") > 0)

    def value(key: str) -> Column:
        mine = F.filter("lines", lambda x: line(x) == key)
        return F.when(F.size(mine) > 0, F.regexp_extract(F.element_at(mine, -1), r"^\.\.\. \S+ ?(.*)$", 1))

    head, unsupported = parse_file_type(value("headType"))
    head_action, wrong = parse_action(value("headAction"))
    action, wrong_too = parse_action(value("action"))
    rev = lambda key: value(key).try_cast("long")
    return got.select(
        "seq", value("depotFile").alias("depot_file"), value("clientFile").alias("client_file"), path_key(value("clientFile"), policy).alias("client_key"), head.alias("head_type"), unsupported.alias("unsupported_type"),
        head_action.alias("head_action"), rev("headRev").alias("head_rev"), rev("haveRev").alias("have_rev"), action.alias("action"), rev("fileSize").alias("file_size"), F.lower(value("digest")).alias("digest"), F.coalesce(wrong, wrong_too).alias("error"),
    )


def parse_tagged_records(spark: SparkSession, path: str, policy: str = "unix", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Depot rows of text files of blocks with blank lines between, LF or CR LF; the last block needs none. seq is the place
    in the files, whatever the splits."""
    return parse_tagged_blocks(ordered_records(spark, path, True, range_bytes), policy)


def read_have(spark: SparkSession, path: str, policy: str = "unix") -> DataFrame:
    """``parse_have`` of files of JSON lines."""
    return parse_have(ordered_records(spark, path), policy)


def read_where(spark: SparkSession, path: str, policy: str = "unix") -> DataFrame:
    """``parse_where`` of files of JSON lines."""
    return parse_where(ordered_records(spark, path), policy)


def parse_have(lines: DataFrame, policy: str = "unix") -> DataFrame:
    """(path_key, sync_time) of JSON lines (seq, value): stat records only, unreadable times NULL, the last of a key."""
    got = F.from_json("value", "code string, path string, syncTime string")
    rows = lines.select("seq", got.alias("r")).where((F.col("r.code") == "stat") & F.col("r.path").isNotNull())
    keyed = rows.select("seq", path_key(F.col("r.path"), policy).alias("path_key"), F.col("r.syncTime").try_cast("long").alias("sync_time"))
    return keyed.groupBy("path_key").agg(F.max_by(F.struct("sync_time"), "seq").alias("r")).select("path_key", "r.sync_time")


def parse_where(lines: DataFrame, policy: str = "unix") -> DataFrame:
    """View map of JSON lines (seq, value): lines that are no JSON, or lack a path, are skipped; a key ``unmap``, whatever
    its value, means unmapped; the last of a path counts."""
    got = lines.select("seq", F.from_json("value", "path string, depotFile string").alias("r"), F.array_contains(F.json_object_keys("value"), "unmap").alias("unmap"))
    rows = got.where(F.col("r.path").isNotNull() & F.col("r.depotFile").isNotNull()).select("seq", path_key(F.col("r.path"), policy).alias("path_key"), F.col("r.depotFile").alias("depot_file"), F.coalesce("unmap", F.lit(False)).alias("unmapped"))
    return rows.groupBy("path_key").agg(F.max_by(F.struct("depot_file", "unmapped"), "seq").alias("r")).select("path_key", "r.*")


def read_preview_feed(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Feed records of JSON lines in their order; a line that is cut off fails the job, as an incomplete feed proves nothing."""
    schema = schemas.FEED.replace("seq long, ", "")
    lines = ordered_records(spark, path, range_bytes=range_bytes)
    return lines.select("seq", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("seq", "r.*")


def parse_native_reconcile(lines: DataFrame) -> DataFrame:
    """Plan rows (seq, class, depot_file, client_file, rev) of the store's own reconcile: rev is dropped for adds, and
    lines without both paths are dropped."""
    r = F.from_json("value", "action string, depotFile string, clientFile string, workRev string")
    rows = lines.select("seq", r.alias("r")).where(F.col("r.depotFile").isNotNull() & F.col("r.clientFile").isNotNull())
    class_ = F.when(F.col("r.action").isin("add", "delete"), F.col("r.action")).otherwise("edit")
    return rows.select("seq", class_.alias("class"), F.col("r.depotFile").alias("depot_file"), F.col("r.clientFile").alias("client_file"), F.when(class_ != "add", F.col("r.workRev").try_cast("long")).alias("rev"))


_ENTRIES = "doc_id long, include_given boolean, error string, role string, kind string, raw string, place int"


def read_scope_documents(documents: DataFrame) -> DataFrame:
    """Entries of scope documents (doc_id, content binary): one row an entry, and one row without kind for each document
    (its error, or whether it has ``include``). Duplicate keys must be seen, so documents go through a JSON reader in
    Arrow batches; paths are then checked by columns."""

    class Wrong(Exception):
        pass

    def once(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in pairs}) < len(pairs):
            raise Wrong("twice: a field of one object is given two times")
        return dict(pairs)

    def read(raw: bytes | None) -> tuple[bool, list[tuple[str, str, str]]]:
        if raw is None or len(raw) > MAX_DOCUMENT:
            raise Wrong("missing: there is no document" if raw is None else f"large: the document takes more than {MAX_DOCUMENT} bytes")
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            raise Wrong("encoding: the document isn't written in UTF-8") from None
        try:
            doc = json.loads(text, object_pairs_hook=once)
        except (json.JSONDecodeError, RecursionError) as e:
            raise Wrong(f"syntax: the document can't be parsed ({e})") from None
        if not isinstance(doc, dict):
            raise Wrong("object: the document is a value without fields")
        entries = []
        for key in doc:
            if key not in ("include", "exclude"):
                raise Wrong(f'field: nothing is known about "{key}" in a document')
        for role in ("include", "exclude"):
            items = doc.get(role, [])
            if not isinstance(items, list):
                raise Wrong(f"list: {role} holds something else than entries")
            for item in items:
                if not isinstance(item, dict):
                    raise Wrong(f"object: {role} has an entry without fields")
                for key in item:
                    if key not in ("dir", "file"):
                        raise Wrong(f'field: nothing is known about "{key}" in an entry of {role}')
                if len(item) != 1:
                    raise Wrong(f"one: an entry of {role} names {len(item)} paths")
                kind, path = next(iter(item.items()))
                if not isinstance(path, str):
                    raise Wrong(f"text: the {kind} of an entry of {role} isn't text")
                entries.append((role, kind, path))
        return "include" in doc, entries

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _ENTRIES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    given, entries = read(None if raw is None else bytes(raw))
                    rows.append((doc_id, given, None, None, None, None, -1))
                    rows += [(doc_id, given, None, *e, i) for i, e in enumerate(entries)]
                except Wrong as e:
                    rows.append((doc_id, None, str(e), None, None, None, -1))
            yield pd.DataFrame(rows, columns=names)

    parsed = documents.select("doc_id", "content").mapInPandas(parse, _ENTRIES)
    path, reason = scope_path(F.col("raw"), F.col("kind"))
    return parsed.select("doc_id", "include_given", "role", "kind", "place", F.when(F.col("kind").isNotNull(), path).alias("path"), F.coalesce(F.col("error"), F.when(F.col("kind").isNotNull() & reason.isNotNull(), F.concat(reason, F.lit(" ("), F.col("role"), F.lit(")")))).alias("error"))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUNLOG).json(path)


def stream_run_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.RUNLOG).json(path)
