"""Message lines of the versioned store, parsed by column expressions: NULL where a line has another form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The refusals' wordings and the reason that each means.
REFUSALS = {"update modified file": "update_modified", "delete modified file": "delete_modified", "overwrite existing file": "overwrite_existing"}
_REFUSAL = r"^(//.*)#([0-9]+) - can't (update modified file|delete modified file|overwrite existing file) (.+)$"
_DELETED = r"^(//.*)#([0-9]+) - deleted as (.+)$"
IGNORED_SUFFIX = " ignored"
NOT_IGNORED_SUFFIX = " not ignored"
IGNORED_BY = " ignored by "
REFUSED_ADD_SUFFIX = " - ignored file can't be added."


def _groups(c: Column, pattern: str, *names: str) -> Column:
    fields = F.struct(*[F.regexp_extract(c, pattern, i).alias(n) for i, n in enumerate(names, 1) if n])
    return F.when(c.rlike(pattern), fields)


def parse_refusal(c: Column) -> Column:
    """Struct (depot_file, rev, reason, client_file) of a refused update; the last ``#`` before the verb splits the rev."""
    got = _groups(c, _REFUSAL, "depot_file", "rev", "verb", "client_file")
    reasons = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])
    return F.when(got.isNotNull(), F.struct(got["depot_file"].alias("depot_file"), got["rev"].alias("rev"), F.element_at(reasons, got["verb"]).alias("reason"), got["client_file"].alias("client_file")))


def parse_deleted_notice(c: Column) -> Column:
    """Struct (depot_file, rev, client_file) of a deletion notice."""
    return _groups(c, _DELETED, "depot_file", "rev", "client_file")


def classify_feed_record(code: Column, severity: Column) -> Column:
    """body, notice, diagnostic or failure; what isn't known is a failure."""
    return F.when(code == "stat", "body").when(code == "info", "notice").when((code == "error") & (severity < 3), "diagnostic").otherwise("failure")


def parse_ignored_line(c: Column) -> Column:
    """The path of ``<path> ignored``."""
    return F.when(F.endswith(c, F.lit(IGNORED_SUFFIX)), F.substr(c, F.lit(1), F.length(c) - len(IGNORED_SUFFIX)))


def parse_add_refusal_line(c: Column) -> Column:
    """The local path of a refused add; lines that begin with ``//`` are none."""
    return F.when(F.endswith(c, F.lit(REFUSED_ADD_SUFFIX)) & ~F.startswith(c, F.lit("//")), F.substr(c, F.lit(1), F.length(c) - len(REFUSED_ADD_SUFFIX)))


def verdict_candidates(c: Column) -> Column:
    """All readings (path, ignored, source) of a verdict line: a path may itself contain the separating words."""
    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, i, F.lit(len(IGNORED_BY))) == IGNORED_BY)
    by = F.transform(positions, lambda i: F.struct(F.substr(c, F.lit(1), i - 1).alias("path"), F.lit(True).alias("ignored"), F.substr(c, i + len(IGNORED_BY)).alias("source")))
    by = F.filter(by, lambda x: F.length(F.trim(x["source"])) > 0)
    plain = F.array(F.struct(F.substr(c, F.lit(1), F.length(c) - len(NOT_IGNORED_SUFFIX)).alias("path"), F.lit(False).alias("ignored"), F.lit(None).cast("string").alias("source")))
    return F.when(F.endswith(c, F.lit(NOT_IGNORED_SUFFIX)), F.concat(plain, by)).otherwise(by)


def ignore_rule_line_kind(c: Column) -> Column:
    """header, line, reinclude, mapping or unrecognized: what a line of an ignore-rule report is."""
    text = F.regexp_extract(c, r"^#LINE [0-9]+:(.+)$", 1)
    return (
        F.when(c.rlike(r"^#FILE .*\S"), "header")
        .when(F.startswith(text, F.lit("!")) | F.startswith(c, F.lit("!")), "reinclude")
        .when(text != "", "line")
        .when(F.startswith(c, F.lit("#")), "unrecognized")
        .when(c.rlike(r"^([/\\]|\.\.\.|[A-Za-z]:)"), "mapping")
        .otherwise("unrecognized")
    )


def split_positions(c: Column, mark: str = " - ") -> Column:
    """All prefixes of a line that end before ``mark``."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, i, F.lit(len(mark))) == mark)
    return F.transform(at, lambda i: F.substr(c, F.lit(1), i - 1))


def human_bytes(n: Column) -> Column:
    """1.50 GiB and the like."""
    unit = F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10), F.lit(6)).cast("int")
    names = F.array(*[F.lit(x) for x in ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")])
    return F.when(unit == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.format_string("%.2f %s", F.bround(n / F.pow(F.lit(1024.0), unit), 2), F.get(names, unit)))


def percent_skipped(skipped: Column, candidates: Column) -> Column:
    """Whole percent; 0 without candidates."""
    return F.coalesce(F.floor(F.lit(100) * skipped / F.nullif(candidates, F.lit(0))), F.lit(0)).cast("long")
