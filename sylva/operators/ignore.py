"""Ignore verdicts: parsed from the store's answers, checked for completeness, applied to files and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.messages import ignore_rule_line_kind, parse_add_refusal_line, parse_ignored_line, verdict_candidates
from sylva.functions.paths import ancestors, ascii_safe, path_key
from sylva.operators.containment import small, topmost

SAMPLES = 10


def split_by_ascii(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ASCII paths, others): the two are judged by different sources."""
    return paths.where(ascii_safe(F.col("path"))), paths.where(~ascii_safe(F.col("path")))


def verdicts_of(lines: DataFrame, requested: DataFrame) -> DataFrame:
    """(value, path, ignored, source): the readings of each verdict line (value) whose path was asked for."""
    read = lines.select("value", F.explode(verdict_candidates(F.col("value"))).alias("v")).select("value", "v.*")
    return read.join(requested.select("path").distinct(), "path", "left_semi").select("value", "path", "ignored", "source")


def ignored_of(lines: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ignored paths, unrecognized lines) of lines ``<path> ignored``."""
    read = lines.withColumn("path", parse_ignored_line(F.col("value")))
    asked = requested.select("path").distinct()
    return read.join(asked, "path", "left_semi").select("path").distinct(), read.where(F.col("path").isNotNull()).join(asked, "path", "left_anti").select("value").unionByName(read.where("path IS NULL").select("value"))


def refused_adds(lines: DataFrame, requested: DataFrame, policy: str = "unix") -> DataFrame:
    """Requested paths that a refused add names, compared by key."""
    read = lines.select(path_key(parse_add_refusal_line(F.col("value")), policy).alias("k")).where("k IS NOT NULL")
    return requested.withColumn("k", path_key(F.col("path"), policy)).join(read, "k", "left_semi").select("path").distinct()


def verdict_completeness(lines: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: how many lines no reading explains, how many paths have several verdicts or none, and ten of each."""
    got = verdicts_of(lines, requested)
    strange = lines.select("value").join(got.select("value").distinct(), "value", "left_anti")
    per = requested.select("path").distinct().join(got.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left")

    def counted(df: DataFrame, column: str, name: str) -> DataFrame:
        ten = df.select(column).orderBy(column).limit(SAMPLES).agg(F.sort_array(F.collect_list(column)).alias(f"{name}_samples"))
        return df.agg(F.count(F.lit(1)).alias(name)).crossJoin(ten)

    return counted(strange, "value", "unrecognized").crossJoin(counted(per.where("n > 1"), "path", "duplicated")).crossJoin(counted(per.where("n IS NULL"), "path", "missing"))


def apply_file_ignores(workspace: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``workspace`` with filtered set by verdicts; a file without verdict isn't ignored."""
    v = verdicts.groupBy("path").agg(F.bool_or("ignored").alias("_ignored"))
    return workspace.join(v, "path", "left").withColumn("filtered", F.coalesce("_ignored", F.lit(False))).select(*workspace.columns)


def ignored_paths(paths: DataFrame, verdicts: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(ignored paths, paths that refuse the run). Lenient: a positive verdict ignores, none refuses. Strict: every path
    needs exactly one verdict."""
    per = verdicts.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_or("ignored").alias("ignored"))
    at = paths.select("path").distinct().join(per, "path", "left")
    bad = at.where((F.coalesce("n", F.lit(0)) != 1) & F.lit(strict)).select("path")
    return at.where(F.coalesce("ignored", F.lit(False))).select("path"), bad


def ignore_rule_summary(lines: DataFrame) -> DataFrame:
    """One row (saw_header, has_reinclude, unrecognized) of an ignore-rule report."""
    kind = ignore_rule_line_kind(F.col("value"))
    some = lambda k: F.coalesce(F.bool_or(kind == k), F.lit(False))
    return lines.agg(some("header").alias("saw_header"), some("reinclude").alias("has_reinclude"), F.count_if(kind == "unrecognized").alias("unrecognized"))


def prune_gate(summary: DataFrame, directories: DataFrame, config_name: str, enabled: bool = True, force_sync: bool = False, expected: str = ".p4ignore") -> DataFrame:
    """One row (prune): ignored directories may be skipped only if nothing can include a file of theirs again."""
    nested = directories.agg(F.coalesce(F.bool_or("nested_ignore"), F.lit(False)).alias("nested"))
    fixed = enabled and not force_sync and config_name == expected
    ok = F.col("saw_header") & ~F.col("has_reinclude") & (F.col("unrecognized") == 0) & ~F.col("nested")
    return summary.crossJoin(nested).select((F.lit(fixed) & ok).alias("prune"))


def prunable_dirs(directories: DataFrame, verdicts: DataFrame, child: str = "__probe__", sep: str = "/") -> DataFrame:
    """Topmost directories (dir_key) of which both the directory and a synthetic child are ignored. Directories below a
    candidate need no question of their own, so they are dropped before the second round."""
    yes = verdicts.where("ignored").select("path").distinct()
    first = directories.join(yes, directories["dir_key"] == yes["path"], "left_semi").select("dir_key")
    probed = first.withColumn("path", F.concat("dir_key", F.lit(sep + child))).join(yes, "path", "left_semi").select("dir_key")
    return topmost(probed.select(F.lit("dir").alias("kind"), F.col("dir_key").alias("key")), sep).select(F.col("key").alias("dir_key"))


def probes(directories: DataFrame, child: str = "__probe__", sep: str = "/") -> DataFrame:
    """What the second round asks: a child that no rule was written for."""
    return directories.select(F.concat("dir_key", F.lit(sep + child)).alias("path"))


def ask_below(directories: DataFrame, pruned: DataFrame, sep: str = "/") -> DataFrame:
    """Directories that aren't below a pruned one."""
    up = directories.select("dir_key", F.explode(ancestors(F.col("dir_key"), sep)).alias("_at"))
    under = up.join(small(pruned.select(F.col("dir_key").alias("_at"))), "_at", "left_semi").select("dir_key").distinct()
    return directories.join(under, "dir_key", "left_anti")
