"""Refusals: a plan that rests on incomplete or contradictory facts is refused as a whole, before a sink is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.kinds import is_deleted_action

SAMPLES = 10
FIRST_DOWNLOAD = 100_000


class PlanRefused(Exception):
    """``rule`` names the guard; ``samples`` are up to ten of the rows that tripped it."""

    def __init__(self, rule: str, samples: list[str], total: int):
        shown = "".join(f"\n  {s}" for s in samples[:SAMPLES])
        more = f"\n  ... and {total - SAMPLES} more" if total > SAMPLES else ""
        super().__init__(f"refused by {rule}: {total} rows{shown}{more}")
        self.rule, self.samples, self.total = rule, samples[:SAMPLES], total


def samples(df: DataFrame, what: Column, order: Column | None = None) -> DataFrame:
    """One row (total, samples): a count and the first ten, without gathering the rest."""
    order = what if order is None else order
    first = df.select(what.alias("s"), order.alias("o")).orderBy("o").limit(SAMPLES).agg(F.sort_array(F.collect_list(F.struct("o", "s"))).alias("x")).select(F.col("x.s").alias("samples"))
    return df.agg(F.count(F.lit(1)).alias("total")).crossJoin(first)


def refuse_if_any(df: DataFrame, rule: str, what: Column, order: Column | None = None) -> None:
    r = samples(df, what, order).first()
    if r["total"]:
        raise PlanRefused(rule, list(r["samples"]), r["total"])


def refuse_errors(checked: DataFrame, rule: str, order: str = "seq", error: str = "error") -> None:
    """The first errors in input order, not in the order in which tasks met them."""
    refuse_if_any(checked.where(F.col(error).isNotNull()), rule, F.col(error), F.col(order))


def first_error(df: DataFrame, error: str = "error", order: str = "seq") -> DataFrame:
    """One row: the error that comes first in input order, and how many there are."""
    return df.where(F.col(error).isNotNull()).agg(F.min_by(error, order).alias("error"), F.count(F.lit(1)).alias("errors"))


def empty_target_guard(target: DataFrame, depot: DataFrame) -> None:
    """No record at the target although the depot has some: a failed query, not an order to delete all."""
    if target.isEmpty() and not depot.isEmpty():
        raise PlanRefused("empty_target", [], depot.count())


def case_conflicts(doomed: DataFrame, depot: DataFrame, target: DataFrame) -> DataFrame:
    """(client_key, depot_file) of live target records whose local path a planned deletion would hit under another
    spelling."""
    alive = depot.join(doomed.select("client_key").distinct(), "client_key", "left_semi").select("client_key", "depot_file")
    return alive.join(target.where(~is_deleted_action(F.col("action"))), "depot_file").select("client_key", "depot_file").distinct()


def first_download_counts(plan: DataFrame, depot: DataFrame) -> DataFrame:
    """One row (never_synced, synced, refuse): a first download of more than FIRST_DOWNLOAD files, and more than what is
    there, is not what a repair is for."""
    never = plan.agg(F.count_if((F.col("class") == "restore") & F.col("have_rev").isNull()).alias("never_synced"))
    synced = depot.agg(F.count_if(F.col("have_rev").isNotNull()).alias("synced"))
    return never.crossJoin(synced).withColumn("refuse", (F.col("never_synced") > FIRST_DOWNLOAD) & (F.col("never_synced") > F.col("synced")))


def protect_deletes(deletes: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deletes that no verdict protects, deletes without exactly one verdict that says yes or no): the second must be
    empty."""
    by = verdicts.groupBy("path").agg(F.count(F.lit(1)).alias("verdicts"), F.bool_or("ignored").alias("ignored"))
    at = deletes.join(by, deletes["client_file"] == by["path"], "left")
    unjudged = (F.coalesce("verdicts", F.lit(0)) != 1) | F.col("ignored").isNull()
    return at.where(~unjudged & ~F.col("ignored")).select(*deletes.columns), at.where(unjudged).select(*deletes.columns)
