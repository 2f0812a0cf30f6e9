"""The corpus pipeline: documents in, sharded training rows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Every stage takes an empty table, NULL in any column, empty and very long texts, repeated rows and ids, and extra columns
of any name; what happens to such rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontaminate, langid, mixing, ngram_join, sharding
from sylva.llm.common import documents, small_batches, spool


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: NULL and empty texts, texts without a letter, and texts of which the best
    language explains less than ``langid.MIN_SCORE`` of the n-grams. Repeated rows share their fate."""
    small_batches(spark)
    return langid.keep_identified(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id, NULL last; of rows that share id and
    text one stays, rows that share only the id are judged by their texts. Texts without a word all stay."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item within its error budget go; NULL and empty texts stay. Items that are NULL or have no
    word are no items."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, stay or go so that sources meet their target weights; NULL is a source of its own, the last. Rows without
    a word take nothing and go."""
    return mixing.repeat_copies(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard by its doc_id alone (NULL like the empty string) and a place of its own there; rows that
    repeat share the shard."""
    return sharding.shard_documents(docs, 24)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mix_sources", mix_sources), ("shard", shard)]

#: Language identification, the Jaccard join and the mix can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
