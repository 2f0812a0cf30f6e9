"""Spelling variants against all pairs of a small vocabulary in plain Python."""

import random
import re
import zlib
from collections import Counter

from sylva.llm import variants

SCHEMA = "doc_id long, text string, word string, n string, run string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, set()
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(seed):
    """Chains of ever rarer variants, ties, double letters, words at both ends of the alphabet, runs cut by other characters."""
    rng = random.Random(seed)
    words = {"balloon": 400, "baloon": 50, "ballloon": 30, "balloons": 40, "baaloon": 4, "ballxons": 3, "ÀàÿÿÿÿÿÿZ": 200, "ÀàÿÿÿÿÿÿZz": 2, "Bàÿÿÿÿÿÿz": 2, "aaaaaaa": 300, "aaaaaaaa": 30, "aaaaaaaaa": 3, "bbbbbbbb": 30, "abcdefgh": 20, "bbcdefgh": 20, "cbcdefgh": 2, "short": 99, "l" * 3_000: 5, "l" * 2_999: 50}
    said = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w, k in words.items() for _ in range(k)]
    said += ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(1_500)]
    rng.shuffle(said)
    texts = [rng.choice([" ", "_", "1", "\n"]).join(said[k : k + 40]) for k in range(0, len(said), 40)]
    rows = [(k % 50 if k % 7 else None, t, "w", "n", "r") for k, t in enumerate(texts)]
    return rows + [(1, None, "w", "n", "r"), (2, "", "w", "n", "r"), *rows[:5]]


def test_against_all_pairs(spark):
    rows = rows_of(1)
    got = variants.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = brute(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert sum(w[1] is not None for w in want) > 5 and any(w[1] != w[2] and w[1] for w in want)


def test_filters_in_passes(spark):
    """Filters of one block a pass give the same pairs, and full filters (everything is known) only cost time."""
    words = spark.createDataFrame(sorted({(w, n) for w, _, _, n, _, _ in brute(rows_of(2)) if len(w) < 20}), "word string, n long")
    pairs = {tuple(r) for r in variants.near_pairs(words).collect()}
    assert pairs == {tuple(r) for r in variants.near_pairs(words, 8 * 64).collect()}
    listed = words.collect()
    assert {frozenset((a, b)) for a, _, b, _ in pairs} == {frozenset((a["word"], b["word"])) for a in listed for b in listed if near(a["word"], b["word"])}
    assert len(pairs) == len({frozenset((a, b)) for a, _, b, _ in pairs})


def test_empty_table(spark):
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []
