"""Content fingerprints: MD5 over content in a form that doesn't depend on how a platform writes line ends."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import CODECS, digest_type


def digest_binary(content: Column) -> Column:
    return F.md5(content)


def lf_bytes(content: Column) -> Column:
    """Bytes with every CR LF as LF; ISO-8859-1 maps bytes to characters one to one, so nothing else changes."""
    return F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")


def digest_text(content: Column) -> Column:
    return F.md5(lf_bytes(content))


def _bom(content: Column, mark: str) -> Column:
    return F.hex(F.substring(content, 1, len(mark) // 2)) == mark


class Digester:
    """The fingerprint of content that comes in chunks, equal to that of the whole, with a few bytes held back at most: a CR
    that may belong to an LF, the first bytes until a byte order mark is told, a character that a chunk's end cuts.
    ``kind`` is binary, text, or utf8 and symlink (a link stored as a file) for text with a mark. Malformed text after a
    mark is decoded with a replacement character for each error."""

    MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))

    def __init__(self, kind: str):
        if kind not in ("binary", "text", "utf8", "symlink"):
            raise ValueError(f"no digest rule for kind {kind!r}")
        self.md5, self.binary = hashlib.md5(usedforsecurity=False), kind == "binary"
        self.head: bytes | None = b"" if kind in ("utf8", "symlink") else None
        self.decoder: codecs.IncrementalDecoder | None = None
        self.cr = False

    def update(self, chunk: bytes) -> None:
        if self.head is not None:
            self.head += chunk
            if len(self.head) < 3:
                return
            chunk = self._after_mark()
        self._text(chunk, False)

    def _after_mark(self) -> bytes:
        head, self.head = self.head, None
        for mark, codec in self.MARKS:
            if head.startswith(mark):
                self.decoder = codecs.getincrementaldecoder(codec)("replace")
                return head[len(mark) :]
        return head

    def _text(self, chunk: bytes, last: bool) -> None:
        if self.decoder:
            chunk = self.decoder.decode(chunk, last).encode("utf-8")
        if self.binary:
            self.md5.update(chunk)
            return
        if self.cr:
            chunk = b"\r" + chunk
        self.cr = chunk.endswith(b"\r") and not last
        self.md5.update((chunk[:-1] if self.cr else chunk).replace(b"\r\n", b"\n"))

    def hexdigest(self) -> str:
        """Of all chunks; nothing may follow."""
        self._text(self._after_mark() if self.head is not None else b"", True)
        return self.md5.hexdigest()


def symlink_digest(target: str) -> str:
    return hashlib.md5((target.replace("\\", "/") + "\n").encode(), usedforsecurity=False).hexdigest()


def _digest_with_replacement(content: Column) -> Column:
    @F.pandas_udf("string")
    def digests(content: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            digester = Digester("utf8")
            digester.update(bytes(raw))
            return digester.hexdigest()

        return content.map(one, na_action="ignore").astype(object)

    return digests(content)


def digest_utf8(content: Column) -> Column:
    """By byte order mark as UTF-8 text without the mark, LF line ends; without a mark the bytes as text. What is malformed
    after a mark counts as replacement characters. UTF-16 and malformed UTF-8 leave the JVM, other content doesn't."""
    utf8, utf16 = _bom(content, "EFBBBF"), _bom(content, "FFFE") | _bom(content, "FEFF")
    rest = F.substr(content, F.lit(4))
    well = utf8 & F.is_valid_utf8(rest.cast("string"))
    return F.coalesce(_digest_with_replacement(F.when(utf16 | (utf8 & ~well), content)), F.when(well, digest_text(rest)).otherwise(digest_text(content)))


def digest_symlink(target: Column) -> Column:
    return F.md5(F.encode(F.concat(F.translate(target, "\\", "/"), F.lit("\n")), "UTF-8"))


def digest(content: Column, file_type: Column, link_target: Column | None = None) -> Column:
    """By file type; a link stored as a regular file is fingerprinted as UTF-8 text. NULL where there is no rule."""
    kind = digest_type(file_type)
    link = digest_utf8(content) if link_target is None else F.when(link_target.isNotNull(), digest_symlink(link_target)).otherwise(digest_utf8(content))
    return F.when(kind == "binary", digest_binary(content)).when(kind == "text", digest_text(content)).when(kind == "utf8", digest_utf8(content)).when(kind == "symlink", link)


def unchanged_since_sync(mtime: Column, sync_time: Column) -> Column:
    """Whole seconds of mtime within one second of the sync; unknown times and times before 1970 never match."""
    seconds = F.floor(F.unix_micros(mtime) / 1_000_000)
    return F.coalesce((F.abs(seconds - sync_time) <= 1) & (F.unix_micros(mtime) >= 0), F.lit(False))


def _decode_batches(content: Column, codec: str) -> Column:
    @F.pandas_udf("text string, replaced boolean")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if raw is None else bytes(raw).decode(codec, "replace") for raw in batch]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "replaced": pd.Series([None if x is None else "\ufffd" in x for x in texts], dtype=object)})

    return decoded(content)


def decode_charset(content: Column, charset: str) -> Column:
    """Struct (text, replaced): UTF-8 strictly, else as Windows-1252; other charsets with replacement. Spark decodes few
    charsets, so what isn't UTF-8 goes through Arrow batches of whole contents: bound them by ``small_batches``."""
    codec = CODECS.get(charset, "utf-8")
    if codec != "utf-8":
        return _decode_batches(content, codec)
    text = content.cast("string")
    well = F.is_valid_utf8(text)
    return F.when(well, F.struct(text.alias("text"), F.lit(False).alias("replaced"))).otherwise(_decode_batches(F.when(~well, content), "cp1252"))


def strip_bom(content: Column, charset: str) -> Column:
    """Without the byte order mark of the given charset; another charset's mark is content."""
    mark = {"utf-8": "EFBBBF", "utf-16-le": "FFFE", "utf-16-be": "FEFF"}.get(CODECS.get(charset, ""), "")
    return F.when(_bom(content, mark), F.substr(content, F.lit(len(mark) // 2 + 1))).otherwise(content) if mark else content


def trim_line_ending(c: Column) -> Column:
    """Without one line feed and then one carriage return at the end."""
    return F.regexp_replace(c, r"\r?\n?\z", "")


def missing_fields(head_type: Column, file_size: Column) -> Column:
    """Which of the fields that a comparison needs is NULL, as a message; NULL if none."""
    names = F.array_compact(F.array(F.when(head_type.isNull(), F.lit("head type")), F.when(file_size.isNull(), F.lit("file size"))))
    return F.when(F.size(names) > 0, F.concat(F.lit("missing "), F.concat_ws(", ", names)))
