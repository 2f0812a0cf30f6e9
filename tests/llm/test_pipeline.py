"""The pipeline's stages against brute force on a small table, and the registered query."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sylva.llm import decontaminate, langid
from tests.llm.test_ngram_join import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    (_, language), (_, jaccard), (_, leaks), (_, mix), (_, shard) = cp.STAGES
    one = language(spark, docs, sf)
    assert one.columns == columns
    assert one.count() == langid.identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= langid.MIN_SCORE)).count() >= 0.99 * docs.count()
    rows = [tuple(r) for r in one.select("doc_id", "text").collect()]
    want = {d for d, _, c in brute(rows) if d == c}
    two = jaccard(spark, one, sf)
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == want
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    three = leaks(spark, two, sf)
    left = {r["doc_id"]: decontaminate.normalise(r["text"]) for r in three.collect()}
    assert three.columns == columns and not any(i in t for t in left.values() for i in items)
    gone = {r["doc_id"] for r in two.collect()} - set(left)
    assert gone == {r["doc_id"] for r in decontaminate.find_leaks(two, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    four = mix(spark, three, sf)
    assert four.columns == columns and set(Counter(r["doc_id"] for r in four.collect()).values()) <= {1, 2, 3}
    five = shard(spark, four, sf)
    assert Counter(r["doc_id"] for r in five.collect()) == Counter(r["doc_id"] for r in four.collect())


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 50 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_awkward_rows_through_every_stage(spark, tmp_path):
    """NULLs, repeats, clashing columns and an empty table, against a plain reading of the stages."""
    def words(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("aeiou" if k % 2 else "bdfgklmnprst") for k in range(6)) for _ in range(n))

    item = words(99, 30)
    rows = [(i, words(i, 40), "en", "s1") for i in range(1, 30)] + [(100 + i, words(i, 40) + " more", "en", "s2") for i in range(1, 10)]
    rows += [(7, words(7, 40), "en", "s1"), (7, "the quick brown fox jumps over the lazy dog and runs", "en", None), (None, words(60, 40), None, None), (None, words(60, 40), None, None)]
    rows += [(50, None, "en", "s1"), (51, "", None, "s1"), (52, "12 34", "en", "s1"), (53, words(53, 20) + " " + item.upper() + " " + words(54, 20), "en", "s1")]
    names = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, names)
    for extra in ("size", "target", "shard", "score", "key", "row", "_kept", "copies", "label", "n"):
        df = df.withColumn(extra, F.lit("x"))
    spark.createDataFrame([(1, item), (2, None), (3, "!!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, after = df, []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and docs.where("size = 'x' AND target = 'x' AND n = 'x'").count() == docs.count()
        docs = cp.spool(docs, "stage")
        after.append(Counter(r["text"] for r in docs.collect()))
    language, jaccard, leaks, mixed = after
    assert not {None, "", "12 34"} & set(language)
    groups = {t.removesuffix(" more") for t in language}
    assert len(jaccard) == len(groups) == sum(jaccard.values()) and {t.removesuffix(" more") for t in jaccard} == groups
    assert jaccard - leaks == Counter([rows[-1][1]]) and set(mixed) <= set(leaks) and set(mixed.values()) <= {1, 2, 3}
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == sum(mixed.values())
    docs = df.where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
