"""Containment joins: directories and the files below them.

A prefix join would compare every path with every directory. Here containment is equality on a directory key, which
hashes, shuffles and broadcasts like any other equi-join. Where entries cover paths, the entries lie at a handful of
depths, and a path has one prefix at each: a broadcast lookup a depth, so paths aren't multiplied and don't move. Where
all directories of a path are asked for, it is exploded into its ancestors, after paths were reduced to their directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import ancestors, is_under, parent_dir
from sylva.sources.tables import stored

#: Up to so many entries a scope is a predicate that reaches the scan; more go by a join.
PREDICATE_ENTRIES = 20
#: Entries of a table side that is broadcast, at most; counted before.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most BROADCAST_ROWS rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _parts(c: Column, sep: str) -> Column:
    """Number of components of an entry's key; 0 of a root, which ends with the separator."""
    return F.when(F.endswith(c, F.lit(sep)), F.lit(0)).otherwise(F.size(F.split(c, r"\\" if sep == "\\" else "/")))


def _by_depth(entries: DataFrame, sep: str) -> list[tuple[str, int, DataFrame]]:
    """(kind, depth, entries (key)) of the depths at which entries (kind, key) lie, files all at depth 0. The entries are
    written once, and a depth with at most BROADCAST_ROWS of them is marked for broadcast."""
    depth = F.when(F.col("kind") == "dir", _parts(F.col("key"), sep)).otherwise(0)
    known = stored(entries.select("kind", "key", depth.alias("n")).distinct(), "entries")
    counts = known.groupBy("kind", "n").count().collect()  # at most the depth of a path
    parts = [(r["kind"], r["n"], r["count"], known.where((F.col("kind") == r["kind"]) & (F.col("n") == r["n"])).select("key")) for r in counts]
    return [(kind, n, F.broadcast(part) if size <= BROADCAST_ROWS else part) for kind, n, size, part in sorted(parts, key=lambda x: x[:2])]


def _head(path: Column, kind: str, n: int, sep: str) -> Column:
    """What of a path equals the key of an entry of that kind and depth that covers it."""
    if kind != "dir":
        return path
    return F.substring_index(path, sep, n) if n else F.concat(F.substring_index(path, sep, 1), F.lit(sep))


def mark_covered(df: DataFrame, entries: DataFrame, key: str, mark: str, sep: str = "/", strict: bool = False) -> DataFrame:
    """``df`` with boolean ``mark``: an entry (kind, key) covers the path in column ``key``: a dir itself and all below it,
    a file exactly. A NULL path isn't covered. ``strict``: only what lies below a dir."""
    found = F.lit(False)
    depths = _by_depth(entries.where("kind = 'dir'") if strict else entries, sep)
    for i, (kind, n, at) in enumerate(depths):
        df = df.join(at.withColumnRenamed("key", f"_at{i}"), _head(F.col(key), kind, n, sep) == F.col(f"_at{i}"), "left")
        hit = F.col(f"_at{i}").isNotNull()
        found = found | (hit & (F.col(key) != F.col(f"_at{i}")) if strict else hit)
    return df.withColumn(mark, found).drop(*[f"_at{i}" for i in range(len(depths))])


def holding(entries: DataFrame, paths: DataFrame, sep: str = "/", strict: bool = False) -> DataFrame:
    """(kind, key) of the entries (kind, key) that cover one of the ``paths`` (p) at least; ``strict``: that hold one below
    them. A path is cut at the depths at which entries lie and looked up there; it is never exploded into its ancestors."""
    out = entries.sparkSession.createDataFrame([], "kind string, key string")
    for kind, n, at in _by_depth(entries.where("kind = 'dir'") if strict else entries, sep):
        cut = paths.where(F.col("p").isNotNull()).select("p", _head(F.col("p"), kind, n, sep).alias("key")).join(at, "key")
        out = out.unionByName((cut.where("p <> key") if strict else cut).select(F.lit(kind).alias("kind"), "key").distinct())
    return out


def covers(path: Column, entries: list[tuple[str, str]], sep: str = "/") -> Column:
    """The same for a few literal entries (kind, key), as a predicate on string prefixes that Parquet can push down."""
    found = F.lit(False)
    for kind, key in entries:
        hit = path == key
        if kind == "dir":
            hit = hit | F.startswith(path, F.lit(key if key.endswith(sep) else key + sep))
        found = found | hit
    return found


def _literal(entries: DataFrame) -> list[tuple[str, str]] | None:
    rows = entries.select("kind", "key").limit(PREDICATE_ENTRIES + 1).collect()
    return sorted({(r["kind"], r["key"]) for r in rows}) if len(rows) <= PREDICATE_ENTRIES else None


def keep_covered(df: DataFrame, entries: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Rows whose path an entry covers. Rows without a path are dropped."""
    few = _literal(entries)
    if few is not None:
        return df.where(covers(F.col(key), few, sep))
    return mark_covered(df, entries, key, "_covered", sep).where("_covered").drop("_covered")


def drop_covered(df: DataFrame, entries: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Rows whose path no entry covers. Rows without a path are kept."""
    few = _literal(entries)
    if few is not None:
        return df.where(~F.coalesce(covers(F.col(key), few, sep), F.lit(False)))
    return mark_covered(df, entries, key, "_covered", sep).where("NOT _covered").drop("_covered")


def scope_filter(df: DataFrame, scope: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Include part of a scope (role, kind, key)."""
    return keep_covered(df, scope.where("role = 'include'"), key, sep)


def scope_exclude(df: DataFrame, scope: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Exclude part, the implicit file with it. Apply it to depot, target and workspace alike, or files look deleted."""
    return drop_covered(df, scope.where("role IN ('exclude', 'implicit')"), key, sep)


def in_scope(df: DataFrame, scope: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """``df`` with boolean in_scope: covered by an include and by no exclude."""
    df = mark_covered(df, scope.where("role = 'include'"), key, "_in", sep)
    return mark_covered(df, scope.where("role <> 'include'"), key, "_out", sep).withColumn("in_scope", F.col("_in") & ~F.col("_out")).drop("_in", "_out")


def prune_dirs(df: DataFrame, pruned: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Rows that aren't below a pruned directory (dir_key)."""
    return drop_covered(df, pruned.select(F.lit("dir").alias("kind"), F.col("dir_key").alias("key")), key, sep)


def tracked_pruned_dirs(pruned: DataFrame, depot: DataFrame, sep: str = "/") -> DataFrame:
    """Pruned directories that hold tracked files; they must not be pruned after all."""
    held = holding(pruned.select(F.lit("dir").alias("kind"), F.col("dir_key").alias("key")), depot.select(F.col("client_key").alias("p")), sep, strict=True)
    return pruned.join(held.select(F.col("key").alias("dir_key")), "dir_key", "left_semi")


def topmost(entries: DataFrame, sep: str = "/") -> DataFrame:
    """Entries (kind, key, ...) that no other directory entry covers; of equal keys a directory stays."""
    first = entries.groupBy("key").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "key"]), F.struct("kind", F.col("path") if "path" in entries.columns else F.col("key"))).alias("r")).select("key", "r.*")
    return mark_covered(first, entries, "key", "_under", sep, strict=True).where("NOT _under").select(*entries.columns)


def list_directories(inventory: DataFrame, root: str, ignore_name: str = ".p4ignore", fold: bool = False, sep: str = "/") -> DataFrame:
    """(dir_key, depth, nested_ignore): every directory below the root that holds a file or a directory of one, and
    whether an ignore file lies in it at depth 2 or more below the root."""
    parent = parent_dir(F.col("path_key"), sep)
    name = F.element_at(F.split("path_key", r"\\" if sep == "\\" else "/"), -1)
    name, wanted = (F.lower(name), ignore_name.lower()) if fold else (name, ignore_name)
    base = root.rstrip(sep)
    own = inventory.where(F.startswith("path_key", F.lit(base + sep))).groupBy(parent.alias("own")).agg(F.bool_or(name == wanted).alias("ignore_file"))
    at = own.select(F.explode(ancestors(F.col("own"), sep)).alias("dir_key"), "own", "ignore_file")
    at = at.where(F.length("dir_key") > len(base) + (1 if not base else 0))
    level = F.size(F.split(F.substr("dir_key", F.lit(len(base) + 2)), r"\\" if sep == "\\" else "/"))
    return at.groupBy("dir_key").agg(F.first(level).alias("depth"), F.bool_or(F.col("ignore_file") & (F.col("own") == F.col("dir_key"))).alias("ignore_here")).select("dir_key", "depth", (F.col("ignore_here") & (F.col("depth") >= 1)).alias("nested_ignore"))


def unmatched_entries(scope: DataFrame, depot: DataFrame, inventory: DataFrame, sep: str = "/") -> DataFrame:
    """Include entries with no row on either side."""
    seen = depot.select(F.col("client_key").alias("p")).unionByName(inventory.select(F.col("path_key").alias("p")))
    included = scope.where("role = 'include'")
    return included.join(holding(included.select("kind", "key"), seen, sep), ["key", "kind"], "left_anti").select(*scope.columns)


def missing_roots(scope: DataFrame, inventory: DataFrame, sep: str = "/") -> DataFrame:
    """Include entries of kind dir with no file below: they are zero local files and no error, and the store's side counts."""
    roots = scope.where("role = 'include' AND kind = 'dir'")
    held = holding(roots.select("kind", "key"), inventory.select(F.col("path_key").alias("p")), sep, strict=True)
    return roots.join(held.select("key"), "key", "left_anti").select(*scope.columns)


def scope_matched(scope: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row: how many include entries matched something."""
    n = scope.where("role = 'include'").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(unmatched.agg(F.count(F.lit(1)).alias("u"))).select((F.col("n") - F.col("u")).alias("scope_matched"))


def intersect(a: DataFrame, b: DataFrame, sep: str = "/") -> DataFrame:
    """Intersection of two entry tables (kind, path, key): of nested directories the deeper, a file in a directory, equal
    files. Either entry lies in the other or they share nothing, so each side's ancestors meet the other by equality."""

    def below(x: DataFrame, y: DataFrame) -> DataFrame:
        up = x.select("kind", "path", "key", F.explode(ancestors(F.col("key"), sep)).alias("_at"))
        y = y.select(F.col("key").alias("_at"), F.col("kind").alias("_kind"))
        same = F.col("_at") == F.col("key")
        met = (F.col("_kind") == "dir") & (~same | (F.col("kind") == "file") | (F.col("kind") == "dir")) | (same & (F.col("kind") == F.col("_kind")))
        return up.join(y, "_at").where(met).select("kind", "path", "key")

    return below(a, b).unionByName(below(b, a)).dropDuplicates(["kind", "key"])


def dropped_targets(targets: DataFrame, includes: DataFrame, excludes: DataFrame, sep: str = "/") -> DataFrame:
    """Targets that aren't excluded and meet no include entry."""
    left = drop_covered(targets, excludes, "key", sep)
    up = lambda x, n: x.select(F.col("key").alias(n), F.col("kind").alias(f"{n}_kind"), F.explode(ancestors(F.col("key"), sep)).alias("_at"))
    inside = up(left, "t").join(includes.select(F.col("key").alias("_at"), F.col("kind").alias("k")), "_at").where((F.col("k") == "dir") | (F.col("_at") == F.col("t"))).select(F.col("t").alias("key"))
    around = up(includes, "i").join(left.select(F.col("key").alias("_at"), F.col("kind").alias("k")), "_at").where((F.col("k") == "dir") | (F.col("_at") == F.col("i"))).select(F.col("_at").alias("key"))
    return left.join(inside.unionByName(around).distinct(), "key", "left_anti")


def under_pairs(paths: DataFrame, dirs: DataFrame, sep: str = "/") -> DataFrame:
    """(path, dir_key) for each directory that holds a path strictly."""
    up = paths.select("path", F.explode(ancestors(F.col("path"), sep)).alias("dir_key"))
    return up.join(dirs, "dir_key").where(is_under(F.col("path"), F.col("dir_key"), sep)).select("path", "dir_key")
