"""Closed vocabularies: actions, file types, classes and what they map to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
ACTIONS = ("add", "edit", "delete", "branch", "integrate", "import", "purge", "archive", "move/add", "move/delete")
DELETED = ("delete", "move/delete")
LIVE = ("move/add", "add", "edit", "branch", "integrate", "import", "purge")
FILE_TYPES = ("binary", "text", "utf8", "symlink", "utf16", "apple", "resource", "unicode")
DIGEST_TYPES = {"text": "text", "unicode": "text", "utf8": "utf8", "utf16": "utf8", "binary": "binary", "symlink": "symlink"}
# Classes in the order of output.
OPEN_CLASSES = ("add", "edit", "reopen_edit", "delete", "reopen_delete", "revert_add", "revert_edit", "revert_delete")
CLEAN_CLASSES = ("delete", "revert", "restore")
SYNC_CLASSES = ("update", "revert", "restore", "delete", "untracked")
NATIVE_CLASSES = ("add", "update", "delete", "resolve")
# The word for what happens to a file of each (mode, class).
ACTION_WORDS = {
    "open": {"add": "add", "edit": "edit", "delete": "delete", "reopen_edit": "edit", "reopen_delete": "delete", "revert_add": "revert", "revert_edit": "revert", "revert_delete": "revert"},
    "clean": {"delete": "deleting", "revert": "reverting", "restore": "restoring"},
    "sync": {"add": "adding", "update": "updating", "revert": "reverting", "restore": "restoring", "delete": "deleting", "resolve": "scheduling", "untracked": "deleting"},
}
NATIVE_CLASS_OF = {"added": "add", "updated": "update", "refreshed": "update", "deleted": "delete", "opened": "resolve"}
# Charset names of the versioned store and the codec of each; none, auto and the utf32 family have none.
CODECS = {
    "utf8": "utf-8", "utf-8": "utf-8", "utf8-bom": "utf-8", "utf8bom": "utf-8", "utf-8-bom": "utf-8", "utf16": "utf-16-le", "utf16-nobom": "utf-16-le", "utf16le": "utf-16-le", "utf16le-bom": "utf-16-le",
    "utf16be": "utf-16-be", "utf16be-bom": "utf-16-be", "winansi": "cp1252", "cp1252": "cp1252", "cp1250": "cp1250", "cp1251": "cp1251", "cp1253": "cp1253", "cp1254": "cp1254", "cp1255": "cp1255",
    "cp1256": "cp1256", "cp1257": "cp1257", "cp1258": "cp1258", "cp936": "gbk", "cp950": "big5", "cp949": "cp949", "shiftjis": "cp932", "eucjp": "euc_jp", "macosroman": "mac_roman", "koi8-r": "koi8_r",
    "iso8859-1": "cp1252", "iso8859-2": "iso8859-2", "iso8859-5": "iso8859-5", "iso8859-7": "iso8859-7", "iso8859-15": "iso8859-15",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_action(c: Column) -> tuple[Column, Column]:
    """(action, error): the ten known words, or an error that names the other."""
    known = c.isin(*ACTIONS)
    return F.when(known, c), F.when(c.isNotNull() & ~known, F.concat(F.lit("unknown action: "), c))


def require_action(c: Column) -> Column:
    """The action; an unknown one fails the job."""
    action, error = parse_action(c)
    return F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(action)


def parse_file_type(c: Column) -> tuple[Column, Column]:
    """(head_type, unsupported_type): the known type that the raw one begins with, else the raw one."""
    known = F.lit(None).cast("string")
    for name in reversed(FILE_TYPES):
        known = F.when(F.startswith(c, F.lit(name)), F.lit(name)).otherwise(known)
    return known, F.when(known.isNull(), c)


def digest_type(c: Column) -> Column:
    """How content of a file type is fingerprinted; NULL where only the store itself can (apple, resource)."""
    return F.element_at(_map(DIGEST_TYPES), c)


def is_deleted_action(c: Column) -> Column:
    return F.coalesce(c.isin(*DELETED), F.lit(False))


def is_live_action(c: Column) -> Column:
    return F.coalesce(c.isin(*LIVE), F.lit(False))


def action_for(mode: Column, class_: Column) -> Column:
    flat = {f"{m}:{k}": v for m, words in ACTION_WORDS.items() for k, v in words.items()}
    return F.coalesce(F.element_at(_map(flat), F.concat_ws(":", mode, class_)), F.lit("unknown"))


def native_class(c: Column) -> tuple[Column, Column]:
    """(class, error) of the store's own word for an update."""
    found = F.element_at(_map(NATIVE_CLASS_OF), c)
    return found, F.when(found.isNull(), F.concat(F.lit("unknown native action: "), F.coalesce(c, F.lit("(none)"))))


def charset_codec(c: Column) -> Column:
    return F.element_at(_map(CODECS), c)


def class_rank(class_: Column, mode: str) -> Column:
    """Place of a class in the fixed order of the mode's output."""
    order = {"open": OPEN_CLASSES, "clean": CLEAN_CLASSES, "sync": SYNC_CLASSES, "native": NATIVE_CLASSES}[mode]
    return F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(order) for x in (k, i)]), class_)
