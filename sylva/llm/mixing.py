"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. The documents' rates are those nearest in relative entropy to 1 that meet the
targets, with no rate above MOST: ``min(MOST, exp(lambda_s * size / mean_s))``, exponentially tilted by size. The dual
is convex with one multiplier a source (a document is in one source, so the Hessian is diagonal); all multipliers take
safeguarded Newton steps together, each step one distributed aggregation over the (source, size) histogram, which is
exact, as a rate depends on nothing else. Multipliers live in a table that is written to the shared folder between steps.
Every feasible target has a multiplier inside the bracket that the steps start from, so every feasible mix is solved.

Rates become whole copies by systematic rounding along each source ordered by size: a document gets the integers that
its piece of the running rate sum steps over. Sums are integers (2**-20ths), so reruns agree, and by partial summation a
source misses its target by about one document's size. The running sum is built from sums of small cells (source, size
class, hash bucket): windows run inside a cell, over the buckets of a size class, and over a source's size classes, whose
number has a bound, so a source or size that a third of all rows share is spread over BUCKETS tasks.

Targets: sources ordered by code point, NULL last, weigh 1, 2, 3, 1, ...; they share all words; a target stops at MOST
times the source's words and the excess is shared again by weight.

Only DataFrame functions are used. Defined cases: NULL and empty texts have size 0 and take 0; a source without words has
target 0; an empty table gives an empty result; repeated rows each get copies of their own; a NULL doc_id hashes as such;
``repeat_copies`` keeps extra columns of any name, ``mix`` refuses to keep one that it returns itself; a mix that doesn't
converge is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_rows, release, spool, words_of

MOST = 3
WEIGHTS = (1, 2, 3)
#: Rounds at most, and parts into which a round's grid divides a bracket.
STEPS, POINTS = 40, 12
TOLERANCE = 1e-9
BUCKETS = 256
_ONE = 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, n, target) from a table (source, size, n): water-filling under the caps.

    Sorted by cap per unit of weight, the first source that isn't filled to its cap by an equal share of what the sources
    before it leave fixes the level for all. One row a source passes through one task."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("sid", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped, weight_before = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most, F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("weight").over(every) - weight_before))
    per = per.withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("sid")))).over(every)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return per.select("source", "sid", "source_size", "n", target.alias("target"))


def rate(multiplier: Column, size: Column, mean: Column, most: int = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def exact_sum(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: each is taken to 12 decimals."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def solve(sizes: DataFrame, sources: DataFrame, most: int = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(sid, mean, lam) of the sources: Newton on the dual, kept inside a bracket; full sources get lam = 1e6.

    The bracket comes from the data: with every text at least as long as the shortest one with words, the multiplier that
    takes that one to the cap takes all, and log(target / source_size) times as much takes no more than the target. A round
    is one aggregation that tries POINTS multipliers of each source at once: the Newton points of both ends of its bracket
    and an even grid between them. So a bracket shrinks by the grid in the worst case and quadratically in the usual one."""
    shortest = sizes.where("size > 0").groupBy("sid").agg(F.min("size").alias("shortest"))
    used = sources.where((F.col("target") > 0) & (F.col("source_size") > 0)).join(shortest, "sid").withColumn("mean", F.col("source_size") / F.col("n"))
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    step = F.col("mean") / F.col("shortest")
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * step * (1 + 1e-9))
    high = F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(F.log(F.lit(float(most))) * step * (1 + 1e-9))
    none = F.lit(None).cast("double")
    state = used.select("sid", "mean", "target", F.when(full, F.lit(1e6)).otherwise(F.lit(0.0)).alias("lam"), low.alias("low"), high.alias("high"), full.alias("done"), none.alias("above"), none.alias("below"))
    state = spool(state, "multipliers")
    for _ in range(steps):
        inside = lambda x: F.when((x > F.col("low")) & (x < F.col("high")), x)
        grid = F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / POINTS)
        points = F.array_distinct(F.array_compact(F.concat(grid, F.array(F.col("high"), inside(F.col("above")), inside(F.col("below"))))))
        tried = sizes.join(state.where(~F.col("done")).select("sid", "mean", "target", F.explode(points).alias("lam")), "sid")
        tilt = rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size")
        free = F.when(tilt < most, words * F.col("size") / F.col("mean") * tilt).otherwise(F.lit(0.0))
        sums = tried.groupBy("sid", "target", "lam").agg(exact_sum(words * tilt).alias("taken"), exact_sum(free).alias("slope")).withColumn("gap", F.col("taken") - F.col("target"))
        newton = F.col("lam") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        under, over = F.when(F.col("gap") <= 0, F.col("lam")), F.when(F.col("gap") >= 0, F.col("lam"))
        ends = sums.groupBy("sid").agg(
            F.max(under).alias("new_low"), F.min(over).alias("new_high"), F.max_by(newton, under).alias("new_above"), F.min_by(newton, over).alias("new_below"),
            F.min(F.struct(F.abs("gap").alias("gap"), "lam")).alias("best"),
        )
        near = F.col("best.gap") <= F.greatest(F.col("target") * tolerance, F.lit(1e-6))
        low, high = F.coalesce("new_low", "low"), F.coalesce("new_high", "high")
        tight = high - low <= 1e-14 * F.greatest(F.abs(low), F.abs(high), F.lit(1.0))
        moved = state.join(ends, "sid", "left").select(
            "sid", "mean", "target", F.coalesce("best.lam", "lam").alias("lam"), low.alias("low"), high.alias("high"), (F.col("done") | near | tight).alias("done"), F.col("new_above").alias("above"), F.col("new_below").alias("below")
        )
        before, state = state, spool(moved, "multipliers")
        release(before)
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        if not state.where(~F.col("done")).isEmpty():
            raise RuntimeError(f"the mix didn't converge in {steps} rounds")
    return state.select("sid", "mean", F.round("lam", 10).alias("lam"))


def size_class(size: Column) -> Column:
    """Classes 1.6 % wide above 256 words: under 1,000 for any text that a row can hold."""
    return F.when(size < 256, size).otherwise(256 + F.floor(F.log(size / 256.0) * 64)).cast("int")


#: What ``mix`` adds; columns that are kept can't have these names.
RESULT = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with size, source_size, target and copies (0 to MOST)."""
    if clash := set(keep) & set(RESULT):
        raise ValueError(f"columns {sorted(clash)} are results of the mix")
    return _mixed(docs, keep).select("_kept.*", *[F.col(f"_{c}").alias(c) for c in RESULT])


def _mixed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(_kept, _size, _source_size, _target, _copies) of every row; what is kept is packed, so no name can clash."""
    sized = spool(docs.select("doc_id", "source", words_of(F.col("text")).alias("size")), "sized")
    sizes = spool(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = spool(targets(sizes), "sources")
    numbered = sizes.join(sources.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "n")
    solved = solve(numbered, sources)
    known = spool(sources.join(solved, "sid", "left").select(F.col("source").alias("_s"), "sid", "source_size", "target", "mean", "lam"), "known")
    known = F.broadcast(known) if known.count() <= broadcast_rows(known) else known  # one row a source
    narrow = set(keep) <= {"doc_id", "source"}
    packed = (sized if narrow else docs).select(F.struct(*keep).alias("_kept"), "doc_id", "source", F.col("size") if narrow else words_of(F.col("text")).alias("size"))
    cell = ["sid", "class", "bucket"]
    rows = _rated(packed, known)
    rows = rows.withColumn("upto", F.sum("rate").over(Window.partitionBy(*cell).orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(_offsets(_rated(sized, known), cell), cell, "left")  # every cell has one; an inner join would count words again to look for NULL
    end = F.col("offset") + F.col("upto") + _ONE // 2
    copies = (F.floor(end / _ONE) - F.floor((end - F.col("rate")) / _ONE)).cast("long")
    return rows.select("_kept", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.when(F.col("size") == 0, F.lit(0)).otherwise(copies).cast("long").alias("_copies"))


def _rated(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with their source's facts, rate in 2**-20ths, size class and bucket."""
    exact = F.when(F.col("lam").isNull() | (F.col("size") == 0), F.lit(0.0)).otherwise(rate(F.col("lam"), F.col("size"), F.col("mean")))
    at = rows.join(known, F.col("source").eqNullSafe(F.col("_s")))
    return at.withColumns({"rate": F.floor(exact * _ONE).cast("long"), "class": size_class(F.col("size")), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")})


def _offsets(rated: DataFrame, cell: list[str]) -> DataFrame:
    """Running rate sum of a source ahead of each cell; sums of cells, then of classes, so no window is long."""
    sums = rated.groupBy(*cell).agg(F.sum("rate").alias("sum"))
    classes = sums.groupBy("sid", "class").agg(F.sum("sum").alias("all"))
    ahead = Window.partitionBy("sid").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("sid", "class", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("in", F.coalesce(F.sum("sum").over(inside), F.lit(0))).join(classes, ["sid", "class"]).select(*cell, (F.col("base") + F.col("in")).alias("offset"))


def repeat_copies(docs: DataFrame) -> DataFrame:
    """Pipeline form: every row as often as the mix takes it; columns unchanged, whatever their names."""
    mixed = _mixed(docs, docs.columns).where(F.col("_copies") > 0)
    return mixed.select("_kept", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_kept.*")
