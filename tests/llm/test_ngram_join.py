"""The n-gram Jaccard join against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import common
from sylva.llm import ngram_join as nj


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, n, component) of rows (doc_id, text) by comparing all pairs of sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in seen[x])
        for j, both in common.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for x in s:
            seen[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(spark, rows):
    got = nj.components(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(4)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_shingle_sets_by_brute_force(sf, spark):
    texts = ["", None, "a", "A b", "one two three", "a b c d", "a b c d a b c d a", "é É x y z\tw\x0bv", " lead and  trail ", "w " * 300_000, "x" * 700_000 + " y z w v"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t, s in zip(texts, nj.shingle_sets(texts), strict=True):
        assert len(s) == len(shingles(t)) and np.all(np.diff(s) > 0)
    assert nj.shingle_sets(["A b C d e"])[0].tolist() == nj.shingle_sets(["a  b\nc D E"])[0].tolist()


def test_documents(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(60)]
    rows = [(5, None), (3, ""), (4, " \n"), (7, "a b"), (6, "A  b"), (6, "A  b"), (None, "a b"), (None, "only null"), (9, "a b c"), (2, "a b c d e f g h i j"), (1, "a b c d e f g h i j k")]
    rows += [(20, " ".join(base)), (20, " ".join(base[:-1])), (21, " ".join(base[1:])), (None, " ".join(base[2:])), (22, "word " * 3000)]
    check(spark, rows)
    assert nj.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("seed", "long"), [(1, 48), (2, 6)])
def test_near_copies_and_common_passages(spark, seed, long, monkeypatch):
    """Large groups of near copies with and without their original, chains, and a passage in many documents."""
    monkeypatch.setattr(nj, "HEAVY", 8)
    monkeypatch.setattr(nj, "LONG", long)
    monkeypatch.setattr(nj, "BLOCK_SETS", 20)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for g, (size, length, edits, original) in enumerate([(60, 120, 2, True), (60, 90, 3, False), (30, 40, 1, True), (25, 12, 1, False), (40, 300, 8, False)]):
        base = [word() for _ in range(length)]
        chain = list(base)
        for i in range(size):
            w = list(chain if g == 4 else base)
            for _ in range(edits if i or not original else 0):
                w[rng.randrange(len(w))] = word()
            if g == 4:
                chain = w
            rows.append((n := n + 1, " ".join(w)))
    for _ in range(150):
        w = [word() for _ in range(rng.randrange(5, 250))]
        at = rng.randrange(len(w))
        rows.append((n := n + 1, " ".join(w[:at] + passage + w[at:])))
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("times", [2, 4])
@pytest.mark.parametrize("heavy", [4, 1000])
def test_repeated_near_copies(spark, times, heavy, monkeypatch):
    """Whole groups of near copies that occur several times, under one doc_id a text or under NULL."""
    monkeypatch.setattr(nj, "HEAVY", heavy)
    rng = random.Random(times)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for g in range(30):
        base = [word() for _ in range(rng.choice([12, 40, 120]))]
        for i in range(2 + g % 3):
            w = [*base[: len(base) - i % 2], *([word()] if i else [])]
            rows += [(None if g % 7 == 6 and i else 10 * g + i, " ".join(w))] * times
    rng.shuffle(rows)
    check(spark, rows)


def test_many_heavy_tokens_cost_no_more_a_text(spark):
    """2 million heavy tokens, the most there can be, and 4,000 texts in one task: a text must not go through all of them."""
    known = np.sort(np.random.default_rng(3).integers(-(2**63), 2**63, nj.HEAVY_MOST, dtype=np.int64))
    texts = spark.range(0, 4000, 1, 1).select(F.col("id").alias("key"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.concat(F.col("id"), F.lit("w"), x))).alias("text"))
    began = time.monotonic()
    assert nj.light_first(texts, spark.sparkContext.broadcast(known), 85).where(F.size("head") == nj.prefix_length(57, 2)).count() == 4000
    assert time.monotonic() - began < 30


def test_heads_from_spare_tokens(spark):
    """The same heads as from whole texts; they are left to the texts only where head and spare have too few light tokens."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(9, 300))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = np.unique(np.concatenate(nj.shingle_sets(texts)))
    heads = common.spool(nj.signatures(docs), "heads")
    fetched = []
    for share in (0, 0.05, 0.3, 0.8, 1):
        held = spark.sparkContext.broadcast(tokens[np.random.default_rng(2).random(len(tokens)) < share])
        want = {r["key"]: r["head"] for r in nj.light_first(heads.join(docs, "doc_id").select("key", "text"), held, 85).collect()}
        got = {r["key"]: r["head"] for r in nj.light_heads(heads, held, 85).collect()}
        assert all(head is None or head == want[key] for key, head in got.items()) and got.keys() == want.keys()
        fetched.append(sum(head is None for head in got.values()))
    assert fetched[0] == fetched[1] == 0 and 200 < fetched[-1] < 400


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in [(500, 500, 470), (500, 480, 0), (3, 4, 2), (40000, 39000, 38000), (700, 100, 100), (0, 5, 0)]:
        tokens = np.unique(rng.integers(-(2**63), 2**63, n + m, dtype=np.int64))
        a, b = np.sort(tokens[:n]), np.sort(np.concatenate((tokens[:both], tokens[n : n + m - both])))
        d = nj.least_difference(nj.parity_sketch(a), nj.parity_sketch(b))
        assert d <= len(a) + len(b) - 2 * both and d == nj.least_difference(nj.parity_sketch(b), nj.parity_sketch(a))
    assert nj.least_difference(nj.parity_sketch(a), nj.parity_sketch(a)) == 0


def test_keep_one_drops_only_copies(spark):
    """One row of each group, whatever its ids; a row that shares its id with a dropped copy stays."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    near = lambda i: " ".join(base[: 80 - i])
    rows = [(1, near(0), "a"), (5, near(1), "a"), (5, "a text that has nothing to do with the others", "a"), (1, near(0), "b"), (None, near(2), "a"), (None, near(2), "a")]
    rows += [(None, "nobody knows this", "a"), (None, "nobody knows this", "b"), (7, None, "a"), (7, None, "a"), (8, "", "a"), (9, "two words", "z"), (10, "Two  words", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").withColumn("row", F.lit(3)).withColumn("print", F.lit("p"))
    got = Counter((r["doc_id"], r["text"], r["label"]) for r in nj.keep_one(df).collect())
    assert got == Counter([rows[0], rows[2], rows[6], rows[8], rows[9], rows[10], rows[11]])
    assert nj.keep_one(df).columns == df.columns and nj.keep_one(df.where("false")).count() == 0


def test_shuffled_ways(spark, monkeypatch):
    """The same results when nothing may be broadcast whole."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([*base[: 59 - i % 3], f"v{i % 7}"])) for i in range(70)] + [(100 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(40)]
    check(spark, rows)


def test_keep_one_with_columns_that_have_no_order(spark):
    """A MAP column, with and without a repeated row: one of equal rows stays."""
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words, {"a": 1}), (1, words, {"a": 1}), (2, words + " x", {"b": 2}), (3, "other " * 3, None), (3, "other " * 3, None), (4, None, {}), (4, None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, facts map<string,int>")
    assert sorted((r["doc_id"], r["facts"] or {}) for r in nj.keep_one(docs).collect()) == [(1, {"a": 1}), (3, {}), (4, {}), (4, {})]
    assert nj.keep_one(docs.dropDuplicates(["doc_id"])).count() == 3
