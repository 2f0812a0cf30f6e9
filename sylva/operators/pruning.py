"""Pruning of ignored directories as a whole: gate, questions from the top down, and what may be skipped.

Whether a directory's content is ignored can't be asked, so a made-up child is: a directory is pruned if it and the child
are. Below a pruned directory nothing is asked. Every level is two questions at most, each a table that is answered as a
whole: is the directory ignored, and, for those that are, is the child. Anything that isn't understood drops the pruning,
never a file: then all directories are walked and files are judged one by one.

Directories and recorded answers are read once, and every question is answered once: what is asked again comes from files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.messages import parse_ignored_line
from sylva.functions.paths import ascii_safe, parent_dir
from sylva.operators.ignore import ignore_rule_summary, probes
from sylva.sources.tables import stored

#: Takes a table (path) of questions and returns answer lines (value).
Ask = Callable[[DataFrame], DataFrame]

IGNORE_FILE = ".p4ignore"  # fixed value


@dataclass
class Pruning:
    """pruned: (dir_key), no directory below another. candidates: directories looked at. questions: paths asked about.
    fallback: why nothing is pruned, or None."""

    pruned: DataFrame
    candidates: int = 0
    questions: int = 0
    fallback: str | None = None


def answers_from(lines: DataFrame) -> Ask:
    """Answers out of a table of recorded lines (value): those that name a path asked about, and those that name none. The
    lines are parsed and written when the first question comes."""
    known: list[DataFrame] = []

    def ask(questions: DataFrame) -> DataFrame:
        if not known:
            known.append(stored(lines.select("value", F.regexp_extract("value", r"(?s)^(.*) ignored$", 1).alias("path")), "prune-lines"))
        wanted = questions.select("path").unionByName(questions.sparkSession.range(1).select(F.lit("").alias("path")))
        return known[0].join(wanted, "path", "left_semi").select("value")

    return ask


def gate(rules: DataFrame, config_name: str | None, enabled: bool = True, force_sync: bool = False) -> str | None:
    """Why ignored directories may not be skipped whatever the tree holds, or None if they may."""
    if not enabled:
        return "switched off"
    if force_sync:
        return "a forced sync takes no notice of ignore rules"
    if config_name != IGNORE_FILE:
        return f"the ignore file is {config_name or 'not set'}"
    kinds = ignore_rule_summary(rules).first()
    if not kinds["saw_header"] or kinds["unrecognized"]:
        return "the rule report can't be read"
    if kinds["has_reinclude"]:
        return "a rule includes files again"
    return None


def plan_pruning(directories: DataFrame, rules: DataFrame, ask: Ask, config_name: str | None = IGNORE_FILE, enabled: bool = True, force_sync: bool = False, sep: str = "/") -> Pruning:
    """The topmost ignored directories of ``directories`` (dir_key, depth from 1, nested_ignore), by the rule report
    ``rules`` (value) and the answers that ``ask`` gives. Names that the store can't read are never asked about, so they
    are never pruned, and what is below them is asked about on its own."""
    none = directories.select("dir_key").where("false")
    why = gate(rules, config_name, enabled, force_sync)
    if why:
        return Pruning(none, fallback=why)
    dirs = stored(directories.select("dir_key", "depth", "nested_ignore", parent_dir(F.col("dir_key"), sep).alias("up")), "prune-dirs")
    if not dirs.where("nested_ignore").isEmpty():
        return Pruning(none, fallback="an ignore file lies deeper in the tree")
    total, questions, pruned = dirs.count(), 0, [none]
    top = dirs.agg(F.min("depth").alias("first"), F.max("depth").alias("last")).first()
    left = dirs.where(F.col("depth") == top["first"]) if total else dirs
    for depth in range(top["first"] or 0, (top["last"] or -1) + 1):
        asked = left.where(ascii_safe(F.col("dir_key"))).select(F.col("dir_key").alias("path"))
        first, strange = _answered(asked, ask)
        second, odd = (none, False) if strange else _answered(probes(first.select(F.col("path").alias("dir_key")), sep=sep), ask)
        if strange or odd:
            return Pruning(none, total, 0, "an answer can't be read")
        questions += asked.count() + first.count()
        second = second.select(F.expr(f"left(path, length(path) - {len(sep + '__probe__')})").alias("dir_key"))
        pruned.append(second)
        if depth < top["last"]:
            alive = left.join(second, "dir_key", "left_anti").select(F.col("dir_key").alias("up"))
            left = stored(dirs.where(F.col("depth") == depth + 1).join(alive, "up", "left_semi"), "prune-left")
    return Pruning(stored(reduce(DataFrame.unionByName, pruned), "pruned"), total, questions)


def _answered(questions: DataFrame, ask: Ask) -> tuple[DataFrame, bool]:
    """(questions (path) that are ignored, whether a line can't be read or names a path that nobody asked about)."""
    lines = ask(questions).groupBy(parse_ignored_line(F.col("value")).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    met = stored(lines.join(questions.withColumn("asked", F.lit(True)), "path", "left").select("path", "asked"), "prune-answers")
    return met.where("asked").select("path"), not met.where("asked IS NULL").isEmpty()
