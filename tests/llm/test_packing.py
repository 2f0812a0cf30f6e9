"""Packing: tokens against the tokenizer, placements against the contract, bounds against exhaustive search."""

import itertools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sylva.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, row string, length string, part int"
ODD = ["", " ", "It's O'Neill's 'REally", "<|endoftext|> x<|startoftext|>", "ÀÉ×÷ß ŒÙ́é İ ΣΑΣ", "a\x1cb\x85c\xa0d e \x00\x7f ''s12ab3", "日本語 テスト😀 ½²", "ſ K Å ǅ ª º µ ¹", "a​b ﻿c", "́ x ́"]


def tokens(text):
    return np.frombuffer(packing.encoder(PATH).ids(text), "<u4").tolist()


def test_tokens(spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert [tokens(t) for t in texts] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("abSßé÷ '1.\n"), max_size=60)))
def test_tokens_of_more_texts(text):
    assert tokens(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    assert tokens("one two three four five one") == WHOLE.encode("one two three four five one", add_special_tokens=False).ids


def fewest(lengths, capacity):
    """Sequences needed, by trying every way."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_fit(lengths):
    least, (where, offset, filled) = packing.lower_bound(np.array(lengths, np.int64), 20), packing.best_fit(np.array(lengths, np.int64), 20)
    assert -(-sum(lengths) // 20) <= least <= fewest(sorted(lengths, reverse=True), 20) <= len(filled)
    for k in range(len(filled)):
        own = sorted((o, n) for w, o, n in zip(where, offset, lengths, strict=True) if w == k)
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) == filled[k] <= 20


def test_bound_beats_area():
    assert packing.lower_bound(np.full(10, 1_100), 2_048) == 10
    assert packing.lower_bound(np.full(9, 700), 2_048) == 5  # two a sequence


def checked(rows, capacity):
    """The placements are gapless and within capacity; the number of sequences."""
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in at.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= capacity
    return len(at)


def test_awkward_rows(spark):
    """NULL and empty texts, a text of many pieces, exact multiples of the capacity, repeated rows and ids, clashing names."""
    exact = "a " * 63  # and the closing token
    texts = [*ODD, None, None, "word " * 5_000, exact, exact + "a", exact, "x"]
    docs = spark.createDataFrame([(None if k == 3 else k % 8, t, "r", "l", 1) for k, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs.repartition(3), PATH, 64).collect()
    want = []
    for k, t in enumerate(texts):
        ids = np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(None if k == 3 else k % 8, p, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for p, a in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    assert checked(rows, 64) == packing.lower_bound(np.array([w[3] for w in want]), 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_parts_exchange(spark):
    """Parts of about 50 pieces, a third of one length; what is left is packed again until the whole meets its bound."""
    pieces = spark.range(3_000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 700).otherwise(1 + F.xxhash64("id") % 900 + 900).cast("long").alias("length"))
    pieces = pieces.withColumn("length", F.least(F.greatest("length", F.lit(1)), F.lit(2048)))
    placed, certificates = packing.pack_pieces(pieces, part=50)
    rows = placed.collect()
    assert len(rows) == 3_000 and len({r["row"] for r in rows}) == 3_000
    all_lengths = np.array([r["length"] for r in rows])
    n, at_once = checked(rows, 2_048), len(packing.best_fit(all_lengths, 2_048)[2])
    rounds = {r["round"]: r for r in certificates.groupBy("round").agg(F.sum("sequences").alias("sequences"), F.sum("bound").alias("bound")).collect()}
    assert len(rounds) > 1
    assert packing.lower_bound(all_lengths, 2_048) <= n < rounds[0]["sequences"]
    assert n <= 1.02 * at_once
