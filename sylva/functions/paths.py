"""Path columns. A ``policy`` says how paths are spelled and compared: windows (``\\``, case folded), macos (``/``, folded)
or unix (``/``, exact). Keys are for comparison only; the original spelling is kept beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("windows", "macos", "unix")
_DRIVE_ROOT = r"^[A-Za-z]:[/\\]$"


def _check(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown path policy {policy!r}; known: {', '.join(POLICIES)}")


def separator(policy: str) -> str:
    _check(policy)
    return "\\" if policy == "windows" else "/"


def normalize_sep(c: Column, policy: str = "unix") -> Column:
    return F.translate(c, "/", "\\") if separator(policy) == "\\" else c


def path_key(c: Column, policy: str = "unix") -> Column:
    """What two spellings of one path share."""
    c = normalize_sep(c, policy)
    return c if policy == "unix" else F.lower(c)


def upper_drive(c: Column) -> Column:
    """The first character in upper case if it is an ASCII letter before a colon."""
    return F.when(c.rlike(r"^[a-z]:"), F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def _folded(parts: Column) -> Column:
    """Components with ``.`` and empty ones dropped and ``..`` resolved; at the top ``..`` stays at the top."""
    keep = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((p == ".") | (p == ""), done).otherwise(F.concat(done, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), keep)


def resolve_dots(c: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty components; a drive stays where it is."""
    c = F.translate(c, "\\", "/")
    drive = F.regexp_extract(c, r"^([A-Za-z]:)", 1)
    return F.concat(drive, F.lit("/"), F.array_join(_folded(F.split(F.substr(c, F.length(drive) + 1), "/")), "/"))


def canonical_path(c: Column, base: str = "/", policy: str = "unix") -> Column:
    """Absolute against ``base``, dots resolved, separators and drive letter in the policy's form."""
    unified = F.translate(c, "\\", "/") if policy == "windows" else c
    absolute = F.when(unified.rlike(r"^(/|[A-Za-z]:/)" if policy == "windows" else "^/"), unified).otherwise(F.concat(F.lit(base.rstrip("/\\") + "/"), unified))
    if policy != "windows":
        return F.concat(F.lit("/"), F.array_join(_folded(F.split(absolute, "/")), "/"))
    return upper_drive(normalize_sep(resolve_dots(absolute), policy))


def directory_key(c: Column, policy: str = "unix") -> Column:
    """Key of a directory: no separator at the end unless it is a root."""
    key = path_key(c, policy)
    trimmed = F.regexp_replace(key, r"[/\\]+$" if policy == "windows" else "/+$", "")
    return F.when(trimmed == "", F.lit(separator(policy))).when(trimmed.rlike(r"^[A-Za-z]:$"), F.concat(trimmed, F.lit(separator(policy)))).otherwise(trimmed)


def strip_recursive_suffix(c: Column) -> Column:
    """A directory target without its trailing ``/...`` (also ``\\...``), however often it is there."""
    bare = F.regexp_replace(c, r"([/\\]+\.\.\.)+[/\\]*$", "")
    cut = bare != c
    return F.when(cut & (bare == ""), F.lit("/")).when(cut & bare.rlike(r"^[A-Za-z]:$"), F.concat(bare, F.lit("\\"))).otherwise(bare)


def escape_spec(c: Column) -> Column:
    """Wildcards and revision marks of a file spec as %xx; ``%`` first, so nothing is escaped twice."""
    for mark, code in (("%", "%25"), ("#", "%23"), ("@", "%40"), ("*", "%2A"), ("?", "%3F")):
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def is_under(path: Column, directory: Column, sep: str = "/") -> Column:
    """Strictly below the directory, at a component boundary."""
    prefix = F.when(F.endswith(directory, F.lit(sep)), directory).otherwise(F.concat(directory, F.lit(sep)))
    return F.startswith(path, prefix) & (F.length(path) > F.length(prefix))


def ancestors(c: Column, sep: str = "/") -> Column:
    """All proper ancestor directories and the path itself, from the root down: what turns containment into equality."""
    parts = F.split(c, r"\\" if sep == "\\" else "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.call_function("substring_index", c, F.lit(sep), i))
    return F.transform(heads, lambda p, i: F.when((i == 0) & ((p == "") | p.rlike("^[A-Za-z]:$")), F.concat(p, F.lit(sep))).otherwise(p))


def parent_dir(c: Column, sep: str = "/") -> Column:
    """Directory of a path; a root's child has the root."""
    mark = r"\\" if sep == "\\" else "/"
    up = F.regexp_extract(c, rf"^(.*){mark}[^{mark}]*$", 1)
    return F.when((up == "") | up.rlike("^[A-Za-z]:$"), F.concat(up, F.lit(sep))).otherwise(up)


def depth(c: Column, root: str, sep: str = "/") -> Column:
    """Components below ``root``; 0 for the root itself."""
    rest = F.substr(c, F.lit(len(root.rstrip(sep)) + 2))
    return F.when(F.length(rest) == 0, F.lit(0)).otherwise(F.size(F.split(rest, r"\\" if sep == "\\" else "/")))


def client_syntax(local: Column, root: str, client: str, policy: str = "unix") -> tuple[Column, Column]:
    """(``//client/relative``, degraded): a path at or outside ``root`` stays as it is and is marked degraded. Case is
    folded for the comparison on windows only."""
    sep, top = separator(policy), root.rstrip("/\\")
    spelled = normalize_sep(local, policy)
    compared, prefix = (F.lower(spelled), (top + sep).lower()) if policy == "windows" else (spelled, top + sep)
    inside = F.startswith(compared, F.lit(prefix)) & (F.length(compared) > len(prefix))
    relative = F.substr(spelled, F.lit(len(prefix) + 1))
    if sep == "\\":
        relative = F.translate(relative, "\\", "/")
    return F.when(inside, F.concat(F.lit(f"//{client}/"), relative)).otherwise(local), ~F.coalesce(inside, F.lit(False))


def case_equal_ascii(a: Column, b: Column) -> Column:
    """Equal but for ASCII case; paths with other characters must be equal exactly."""
    ascii_ = a.rlike(r"^[\x00-\x7F]*$") & b.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, F.lower(a) == F.lower(b)).otherwise(a == b)


def ascii_safe(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def scope_path(c: Column, kind: Column) -> tuple[Column, Column]:
    """(path, reason) of a path in a scope document: relative to the root, ``/`` only, literal; NULL path with a reason,
    a code and a sentence, where it is none. The order of the rules decides the reason."""
    raw = F.split(c, "/")
    named = F.filter(raw, lambda p: (p != "") & (p != "."))
    levels = F.transform(F.sequence(F.lit(1), F.size(named)), lambda i: F.aggregate(F.slice(named, 1, i), F.lit(0), lambda n, p: n + F.when(p == "..", F.lit(-1)).otherwise(F.lit(1))))
    first_up = F.when(F.size(named) > 0, F.array_position(F.transform(levels, lambda n: n < 0), True)).otherwise(F.lit(0))
    first_dots = F.array_position(named, "...")
    because = lambda code, why: F.concat(F.lit(f'{code}: "'), c, F.lit(f'" {why}'))
    path = F.array_join(_folded(raw), "/")
    steps_above = (first_up > 0) & ((first_dots == 0) | (first_up < first_dots))
    reason = (
        F.when(F.length(c) == 0, F.lit("empty: an entry needs a path"))
        .when(F.instr(c, "\0") > 0, because("nul", "has the character of code 0"))
        .when(F.instr(c, "\\") > 0, because("backslash", "parts its directories by something else than /"))
        .when(F.startswith(c, F.lit("/")), because("absolute", "begins at a root, where entries begin below it"))
        .when(c.rlike("^[A-Za-z]:"), because("drive", "begins with the name of a drive"))
        .when(c.rlike("[*?]"), because("pattern", "may stand for several paths, where an entry names one"))
        .when(steps_above, because("above", "leads out of the root on its way"))
        .when(first_dots > 0, because("dots", "asks for all below a directory, which a directory does anyway"))
        .when((path == "") & (kind == "file"), because("root", "is the root, where a file was announced"))
    )
    return F.when(reason.isNull(), F.when(path == "", F.lit(".")).otherwise(path)), reason
