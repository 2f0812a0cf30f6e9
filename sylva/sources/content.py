"""Content of files, read by path inside tasks: whole, or as a fingerprint in constant memory, whatever a file's size.

``pending`` rows are dealt to tasks by size, largest files first, so that no task has more than TASK_BYTES plus one file,
and no file is opened that isn't asked for. A file that can't be read is a row with an error, never a failed job: the caller
refuses or reports it. Tasks open local and mounted paths themselves, and other stores by their URI through Arrow.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.digests import Digester, symlink_digest
from sylva.functions.kinds import digest_type
from sylva.sources.tables import running, stored

#: What a task reads, about; what opening a file costs, as bytes; bytes read at a time.
TASK_BYTES, OPEN_BYTES, CHUNK = 256 << 20, 64 << 10, 1 << 20
#: A cell can't hold more.
CELL_BYTES = (1 << 31) - 1


def local_path(path: str) -> str | None:
    """The path on a mounted file system, or None for another store's URI."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def open_file(path: str) -> BinaryIO:
    at = local_path(path)
    if at is not None:
        return open(at, "rb", buffering=0)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def deal_by_size(pending: DataFrame, task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES) -> tuple[DataFrame, int]:
    """(``pending`` with column ``task``, number of tasks). Files go in order of size, largest first, and a task ends where
    the running total passes a multiple of ``task_bytes``. ``path`` must be distinct; an unknown size counts as 0."""
    at = pending.withColumn("_cost", F.coalesce(F.col("size"), F.lit(0)) + open_bytes)
    at = stored(running(at, [F.col("_cost").desc(), F.col("path")], "_upto", "_cost"), "dealt")
    total = at.agg(F.max("_upto")).first()[0] or 0
    return at.withColumn("task", F.floor((F.col("_upto") - F.col("_cost")) / task_bytes).cast("int")).drop("_cost", "_upto"), total // task_bytes + 1


def _in_tasks(pending: DataFrame, task_bytes: int, read: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: list[str], schema: str) -> DataFrame:
    dealt, tasks = deal_by_size(pending, task_bytes)
    return dealt.repartitionById(tasks, "task").select(*columns).mapInPandas(read, schema)


def read_content(pending: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, content, error) of each file in ``pending`` (path, size), repeated paths once. content is NULL where error
    isn't; a file beyond one cell is an error here and has a fingerprint by ``fingerprint_files``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                content = error = None
                try:
                    with open_file(path) as f:
                        content = f.read(CELL_BYTES + 1) if local_path(path) is None else _whole(f)
                    if len(content) > CELL_BYTES:
                        content, error = None, "larger than a cell"
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror or e}"
                yield pd.DataFrame({"path": [path], "content": [content], "error": [error]})

    return _in_tasks(pending.select("path", "size").dropDuplicates(["path"]), task_bytes, read, ["path"], "path string, content binary, error string")


def _whole(f: BinaryIO) -> bytes:
    """All bytes of an unbuffered file, or one more than a cell holds."""
    parts, size = [], 0
    while size <= CELL_BYTES and (part := f.read(CHUNK)):
        parts.append(part)
        size += len(part)
    return b"".join(parts)


def fingerprint(path: str, kind: str | None, chunk: int = CHUNK) -> tuple[str | None, int]:
    """(digest, bytes read) of a file of a digest kind, a chunk in memory at a time. None: the kind has no rule."""
    if kind is None:
        return None, 0
    at = local_path(path)
    if kind == "symlink" and at is not None and os.path.islink(at):
        return symlink_digest(os.readlink(at)), 0
    digester, size = Digester(kind), 0
    with open_file(path) as f:
        while part := f.read(chunk):
            digester.update(part)
            size += len(part)
    return digester.hexdigest(), size


def fingerprint_files(pending: DataFrame, task_bytes: int = TASK_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(path, computed, n_bytes, error) of each file in ``pending`` (path, size, head_type), repeated paths once. Bytes pass
    through a task a chunk at a time, so a file may have any size."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind in zip(batch["path"], batch["kind"], strict=True):
                try:
                    rows.append((path, *fingerprint(path, kind, chunk), None))
                except OSError as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e.strerror or e}"))
            yield pd.DataFrame(rows, columns=["path", "computed", "n_bytes", "error"]).astype({"n_bytes": "Int64"})

    files = pending.select("path", "size", digest_type(F.col("head_type")).alias("kind")).dropDuplicates(["path"])
    return _in_tasks(files, task_bytes, read, ["path", "kind"], "path string, computed string, n_bytes long, error string")


def fingerprint_chunks(chunks: DataFrame, key: str = "path") -> DataFrame:
    """(key, computed, n_bytes) of files that lie in a table as chunks: (key, kind, offset, chunk), kind the same in all chunks
    of a file, offsets telling its order. A file's chunks meet in a task and pass through it one batch at a time, so a
    file may be larger than a cell. NULL chunks are empty; a file of an unknown kind has no digest; a gap or an overlap
    between chunks is an error of the table and gives no digest either."""
    kind_of_key = chunks.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digester, size, whole = None, None, 0, True

        def done() -> tuple:
            return now[0], digester.hexdigest() if digester and whole else None, size

        for batch in batches:
            rows = []
            for name, kind, offset, chunk in zip(batch[key], batch["kind"], batch["offset"], batch["chunk"], strict=True):
                if now is None or name != now[0]:
                    if now is not None:
                        rows.append(done())
                    now, size, whole = (name,), 0, True
                    digester = None if kind is None else Digester(kind)
                whole = whole and offset == size
                chunk = chunk or b""
                if digester:
                    digester.update(bytes(chunk))
                size += len(chunk)
            yield pd.DataFrame(rows, columns=[key, "computed", "n_bytes"])
        if now is not None:
            yield pd.DataFrame([done()], columns=[key, "computed", "n_bytes"])

    ordered = chunks.select(key, "kind", "offset", "chunk").repartition(key).sortWithinPartitions(key, "offset")
    return ordered.mapInPandas(read, f"`{key}` {kind_of_key}, computed string, n_bytes long")
