"""Decontamination, toxicity and language identification: brute force and held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import decontaminate as dc
from sylva.llm import langid, queries, toxicity


def edit_search(item, text):
    """Smallest edit distance of item to a substring of text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_myers_by_dynamic_programming(seed):
    rng = random.Random(seed)
    item, text = ("".join(rng.choice("abc ") for _ in range(n)) for n in (rng.randrange(1, 90), rng.randrange(0, 120)))
    masks = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    assert dc.myers_search(masks, len(item), text)[0] == edit_search(item, text)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


def test_matches_within_the_budget_and_not_beyond():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 60)))) for i in range(25)]
    matcher = dc.ItemMatcher(items)
    for i, item in items:
        k = dc.budget_of(item)
        for n in (0, k // 2, k, 3 * k + 8):
            text = " ".join(rng.choice(words) for _ in range(80)) + " " + edited(rng, item, n) + " " + " ".join(rng.choice(words) for _ in range(80))
            want = edit_search(item, dc.normalise(text))
            got = {m[0]: m[1] for m in matcher.matches(text)}
            assert got.get(i) == (want if want <= k else None)


def test_leaks_of_the_documents(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontaminate(spark, sf).collect()}
    exact = {(d, i) for d, t in docs for i, b in items if dc.normalise(b) in dc.normalise(t)}
    assert exact and exact <= got
    texts, bench = dict(docs), dict(items)
    for d, i in got - exact:
        b = dc.normalise(bench[i])
        assert edit_search(b, dc.normalise(texts[d])) <= dc.budget_of(b)


def test_leak_rows_and_blocks(spark):
    item = "a question that the model must answer well, with forty words or so"
    docs = spark.createDataFrame([(1, f"x {item.upper()} y", "e"), (1, f"x {item.upper()} y", "e"), (None, item, "e"), (2, None, "e"), (3, "", "e"), (4, "clean text " * 20000, "e")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "short"), (5, "another item that is nowhere to be found here")], "item_id long, text string")
    for chars in (8_000_000, 60):
        got = Counter((r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench, block_chars=chars).collect())
        assert got == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1}
        assert sorted(r["doc_id"] for r in dc.drop_leaks(docs, bench, block_chars=chars).collect()) == [2, 3, 4]
    assert dc.find_leaks(docs, bench.where("false")).count() == 0 and dc.find_leaks(docs.where("false"), bench).count() == 0
    assert dc.drop_leaks(docs, bench.where("false")).count() == 6


def test_blocks_and_benchmarks_in_one_worker(spark):
    """Blocks follow each other in one reused worker, where a new broadcast often gets the address of a freed one."""
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))) for i in range(24)]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in items], "doc_id long, text string").coalesce(1)
    for part in (items, items[:12], items[12:]):
        bench = spark.createDataFrame(part, "item_id long, text string")
        want, others = [(i, i) for i, _ in part], sorted({i for i, _ in items} - {i for i, _ in part})
        for chars in (8_000_000, 300):
            found = dc.find_leaks(docs, bench, block_chars=chars).coalesce(1)  # one task after another
            assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want
            assert sorted(r["doc_id"] for r in dc.drop_leaks(docs, bench, block_chars=chars).collect()) == others


def test_languages_held_out(spark):
    out = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[1] > 150 and held[0] > 0.97
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "x") for i in range(40)] + [(100 + i, "der hund und die katze " * 3, "de", "x") for i in range(30)]
    rows += [(200, None, "en", "x"), (201, "", "de", "x"), (202, "12 34 !?", None, "x"), (203, "the dog", None, "x"), (None, "die katze", None, "x"), (204, "word " * 300000, "en", "x"), (205, "qqqq", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[203][0] == "en" and got[None][0] == "de" and got[205] == ("en", 0.0)
    assert {r["lang_pred"] for r in langid.identify(df.where("lang IS NULL")).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0
    assert {r["doc_id"] for r in langid.keep_identified(df).collect()} >= {203, None} and not {r["doc_id"] for r in langid.keep_identified(df).collect()} & {200, 201, 202, 205}


def test_one_letter_has_a_language():
    filters = langid.build_filters({"en": langid.ngram_hashes(*next(langid._pieces(["I am a cat"])))[0]})
    langs, scores = langid.score_texts(filters, ["a", "é", "漢", "1", "!", "", None, "ab", "a" * 9])
    assert langs == ["en"] * 3 + ["und"] * 4 + ["en"] * 2 and scores[0] > 0.9


def test_many_languages_in_the_filters():
    rng = np.random.default_rng(0)
    grams = {f"l{i}": rng.integers(0, 2**63, 300).astype(np.uint64) for i in range(130)}
    filters = langid.build_filters(grams)
    for j, lang in enumerate(filters.langs):
        masks = langid.masks_of(filters, grams[lang])
        assert ((masks[:, j // 63] >> np.uint64(j % 63)) & np.uint64(1)).all()
    others = langid.masks_of(filters, rng.integers(0, 2**63, 20000).astype(np.uint64))
    seen = np.mean((others[:, 0] >> np.uint64(5)) & np.uint64(1))
    assert abs(seen - filters.fp[5]) < 0.01


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = docs.join(labels, "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"))  # a copy isn't held out
    held = texts.where("doc_id % 4 = 0").select("doc_id")
    model = toxicity.fit(docs, labels.join(texts.where("doc_id % 4 <> 0").select("doc_id"), "doc_id"))
    assert np.all(np.diff(model.thresholds) >= 0)
    got = toxicity.score(docs.join(labels, "doc_id").join(held, "doc_id"), model).select("toxic", (F.col("expected_severity") >= toxicity.REVIEW).alias("flag")).groupBy("toxic", "flag").count().collect()
    n = {(r["toxic"], r["flag"]): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.01 * n[(0, False)] and n[(1, True)] >= 4 * n.get((1, False), 0)


def test_ordinal_grades_rise_with_severity():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate((rng.integers(1000, 2000, 30), rng.choice(20, g * 3, replace=False) if g else np.zeros(0, int)))).astype(np.int64) for g in rng.integers(0, 4, 600)]
    toxic = np.array([bool((r < 20).any()) for r in rows])
    grades = toxicity.grades_of(rows, toxic)
    assert set(grades) == {0, 1, 2, 3} and (grades[~toxic] == 0).all()
    model = toxicity.fit_ordinal(rows, grades, toxicity.telling_cells(rows, toxic))
    x = np.array([model.weights[r].sum() for r in rows])
    mean = [x[grades == g].mean() for g in range(4)]
    assert mean == sorted(mean) and np.all(np.diff(model.thresholds) > 0)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "you idiot", "c"), (3, "you idiot", "c"), (None, "kind words " * 40000, "d")], "doc_id long, text string, grade string").drop("grade")
    labels = spark.createDataFrame([(3, 1), (1, 0)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.where("toxic = 0")), toxicity.fit(docs, labels.where("false"))):
        out = toxicity.score(docs, model).collect()
        assert len(out) == 5 and all(r["grade"] == 0 for r in out if not r["text"])
    assert toxicity.score(docs.where("false"), model).count() == 0
