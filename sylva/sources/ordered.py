"""Text files as numbered records, the same for every way in which they are split.

First-wins and last-wins rules need the order of a feed. Here a record's number comes from where it begins, (file, byte
offset), and not from the partition that read it: files in the order of their paths, offsets within a file. A file is cut into
byte ranges, and a record belongs to the range in which its first byte lies, so ranges are read in parallel, and a record
that goes on beyond its range is read to its end.

Use: ``register(spark)`` once, then ``spark.read.format("ordered_records").option("mode", "blocks").load(path)``, or
``ordered_records``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sylva.sources.content import local_path

#: Bytes of a range; offsets that a file has room for in a record's number.
RANGE_BYTES, OFFSET_BITS = 64 << 20, 44
_BACK = 3  # what tells whether a line follows a blank one


@dataclass
class Range(InputPartition):
    path: str
    number: int
    begin: int
    end: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a directory, in order; names that begin with _ or . are no data."""
    at = local_path(path)
    if at is None:
        from pyarrow import fs

        store, inner = _store(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        scheme = path.split("://")[0]
        return sorted((f"{scheme}://{x.path}", x.size) for x in store.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.base_name[0] not in "_.")
    if os.path.isfile(at):
        return [(at, os.path.getsize(at))]
    return sorted((e.path, e.stat().st_size) for e in os.scandir(at) if e.is_file() and e.name[0] not in "_.")


def _open(path: str) -> BinaryIO:
    at = local_path(path)
    if at is not None:
        return open(at, "rb")
    store, inner = _store(path)
    return store.open_input_file(inner)


def _lines(f: BinaryIO, begin: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line without its end, whether the line before is blank or there is none) of the lines that begin at
    ``begin`` or later."""
    at = max(0, begin - _BACK)
    f.seek(at)
    blank = at == 0
    if begin > 0:
        head = f.read(begin - at)
        if not head.endswith(b"\n"):  # the middle of a line: it belongs to the range before
            rest = f.readline()
            head, begin = head + rest, begin + len(rest)
            if not head.endswith(b"\n"):
                return
        line = head[:-1].removesuffix(b"\r")
        blank = line.endswith(b"\n") or (at == 0 and not line)
    f.seek(begin)
    while line := f.readline():
        text = line.removesuffix(b"\n").removesuffix(b"\r")
        yield begin, text, blank
        blank, begin = not text, begin + len(line)


def records_of(f: BinaryIO, begin: int, end: int, blocks: bool) -> Iterator[tuple[int, str]]:
    """(offset, text) of the records that begin in [begin, end): lines that aren't blank, or blocks of them with blank lines
    between. The last record needs no end. Line ends inside a block are LF."""
    held: list[bytes] = []
    start = 0
    for at, text, after_blank in _lines(f, begin):
        if held and (not blocks or not text):
            yield start, b"\n".join(held).decode("utf-8", "replace")
            held = []
        if not held and at >= end:
            return
        if text and (held or not blocks or after_blank):
            start = start if held else at
            held.append(text)
    if held:
        yield start, b"\n".join(held).decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.blocks = options["path"], options.get("mode", "lines") == "blocks"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        files = list_files(self.path)
        if too_large := [p for p, size in files if size >> OFFSET_BITS]:
            raise ValueError(f"{too_large[0]} has more than 2**{OFFSET_BITS} bytes")
        cut = [Range(p, k, at, min(at + self.range_bytes, size)) for k, (p, size) in enumerate(files) for at in range(0, size, self.range_bytes)]
        return cut or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple[int, str]]:
        if part.path:
            with _open(part.path) as f:
                for at, text in records_of(f, part.begin, part.end, self.blocks):
                    yield (part.number << OFFSET_BITS) + at, text


class OrderedRecords(DataSource):
    """Options: path; mode: lines or blocks; rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "ordered_records"

    def schema(self) -> str:
        return "seq long, value string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderedRecords)


def ordered_records(spark: SparkSession, path: str, blocks: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(seq, value) of the records of a file or directory; seq rises with the order and has gaps."""
    register(spark)
    return spark.read.format("ordered_records").option("mode", "blocks" if blocks else "lines").option("rangeBytes", range_bytes).load(path)
