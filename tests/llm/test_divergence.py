"""The divergence audit against counts in plain Python, and the pointer sort against ``sorted``."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import divergence, pointers

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, code int, term string, n long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    groups, total, df, n = set(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((r[1] or "", r[2] or "", r[3] or "") for r in rows):
        groups.add((lang, source))
        terms = [lower(t) for t in TERM.findall(text)]
        total[lang].update(terms)
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = [t for t in total[lang] if df[lang][t] >= least]

        def shares(count, kept=kept):
            size = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept}

        def f(p, q):
            return (p - q) ** 2 // q

        own, base = shares(n[lang, source]), shares(total[lang])
        pairs = [(other, sum(f(own[t], q) for t, q in shares(n[lang, other]).items())) for lang_, other in groups if lang_ == lang and other != source]
        terms = [(t, f(own[t], base[t])) for t in kept if n[lang, source][t] and own[t] > base[t]]
        for part, items, most in (("pair", pairs, 10**9), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def awkward():
    rows = [
        ("The the THE cat's été Été", "en", "a"), ("the cat 12 日本語", "en", "b"), ("the cat \x00the", "en", "b"), ("the " * 500 + "x" * 5000, "en", None),
        ("x" * 5000 + " the " + "x" * 4999, "en", "c"), ("x" * 5000, "en", "c"), ("", "en", "empty"), (None, "en", "null"), ("12 34", "xx", "s"), ("12", "xx", "t"),
        (None, None, None), ("the", None, "a"), ("alone", "fr", "only"), ("le la", "fr", "only"), ("le la", "fr", "only"), ("le la", "fr", "only"),
    ]
    return [(k % 9, *r, 7, "the", None) for k, r in enumerate(rows)] * 2


@pytest.mark.parametrize(("sources", "cells", "slice_bytes"), [(1000, 1 << 20, 1 << 24), (2, 8, 1)])
def test_against_counts(spark, monkeypatch, sources, cells, slice_bytes):
    """NULL and empty texts, langs and sources, repeated rows and ids, ties, long terms, clashing columns; also by blocks of
    two sources and eight cells. Workers see the module's own numbers, so blocks are tested in this process."""
    rows = awkward()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 4)
    assert {tuple(r) for r in got.collect()} == brute(rows, 3, 4)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "CELLS", cells)
    sizes, terms = [5, 7, 0], [([0, 1], [2, 7]), ([0], [3])]
    batch = pa.RecordBatch.from_pylist([{"lang": "l", "codes": c, "ns": n, "terms": 2, "sizes": sizes, "begin": b} for c, n in terms for b in range(0, 3, sources)], pa.schema([("lang", pa.string()), ("codes", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64())), ("terms", pa.int64()), ("sizes", pa.list_(pa.int64())), ("begin", pa.int32())]))
    sums = {(r["one"], r["other"]): r["value"] for b in divergence._pair_sums(iter([batch])) for r in b.to_pylist()}
    count = np.array([[2, 7, 0], [3, 0, 0]])
    p = [[1 + 10**9 * (int(count[t, s]) + 1) // (sizes[s] + 2) for s in range(3)] for t in range(2)]
    assert sums == {(a, b): sum((r[a] - r[b]) ** 2 // r[b] for r in p) for a in range(3) for b in range(3)}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbz é日 1\n"), max_size=40), max_size=6))
def test_pointer_sort(texts):
    buf, starts, lengths, doc = pointers.pointers(pa.array(texts, pa.string()))
    want = [(lower(t), k) for k, text in enumerate(texts) for t in TERM.findall(text)]
    terms = pointers.terms_at(buf, starts, lengths).to_pylist()
    assert list(zip(terms, doc.tolist(), strict=True)) == want
    order, fresh = pointers.sort_pointers(buf, starts, lengths)
    ranked = sorted(range(len(want)), key=lambda i: (want[i][0].encode(), i))
    assert order.tolist() == ranked
    assert fresh.tolist() == [k == 0 or want[i][0] != want[ranked[k - 1]][0] for k, i in enumerate(ranked)]


def test_sizes_near_the_top_are_exact():
    """Counts of 10^13 words, where 10^9 times a count leaves 64 bits."""
    count, total = np.array([0, 3 * 10**12, 10**13 - 1]), np.array([10**13])
    assert divergence._shares(count, total).tolist() == [1 + 10**9 * (c + 1) // 10**13 for c in count.tolist()]
