"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces; a passage within k edits of the item must contain
one piece unchanged. An Aho-Corasick automaton finds all exact piece hits of all items in one walk over a document, and
each hit's neighbourhood is verified with Myers' bit-parallel edit distance (approximate substring search). Documents
never move: the test items, a stated query set, go to the documents in blocks of bounded size.

Texts are compared in lower case with every run of other characters than letters, digits and underscores as one space.
The budget is one rule for all items, ERROR_RATE of the item's characters; pieces are as short as that makes them, and
their more frequent hits cost verification, never budget. An item too short for one edit must occur unchanged, as whole
words.

Defined cases: NULL and empty documents match nothing; items that are NULL or have no word are no test items; equal items
all report; repeated documents all report; a NULL doc_id stays NULL, and ids beside it keep all their digits. Extra
columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of an item's characters that may be edited.
ERROR_RATE = 0.07
#: Characters of test items that one pass over the documents looks for.
BLOCK_CHARS = 8_000_000

_NOT_WORD = re.compile(r"\W+")


def normalise(text: str | None) -> str:
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def budget_of(item: str, rate: float = ERROR_RATE) -> int:
    """Edits allowed: ``rate`` of the length."""
    return int(rate * len(item))


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of nearly equal length, with their offsets."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_search(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any substring of ``text`` and the end of the first such substring.

    ``masks``: for each character the bits of the pattern positions that have it. Python integers serve as bit vectors
    of any width."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score, best, end = full, 0, length, length, 0
    for j, ch in enumerate(text, 1):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may start anywhere, so no carry comes in
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class ItemMatcher:
    """All test items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items, self.masks, self.budget = items, [], []
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, item) in enumerate(items):
            masks: dict[str, int] = defaultdict(int)
            for i, ch in enumerate(item):
                masks[ch] |= 1 << i
            k = budget_of(item, rate)
            self.masks.append(dict(masks))
            self.budget.append(k)
            for offset, piece in pieces_of(item, k):
                found[piece].append((n, offset))
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item number, distance, budget, end in the normalised text) of each item found, at its best place."""
        if not self.any or not text:
            return []
        text = normalise(text)
        whole = f" {text} "
        starts: dict[int, set[int]] = defaultdict(set)
        for at, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                starts[n].add(at - size + 1 - offset)
        out = []
        for n, places in starts.items():
            item, k = self.items[n][1], self.budget[n]
            if k == 0:
                if (at := whole.find(f" {item} ")) >= 0:
                    out.append((n, 0, 0, at + len(item)))
                    if first_only:
                        return out
                continue
            best = low = high = None
            for s in sorted(places):  # neighbouring places share a window
                a, b = max(0, s - k), s + len(item) + k
                if low is not None and a <= high:
                    high = max(high, b)
                    continue
                if low is not None:
                    best = self._better(best, n, text, low, high)
                low, high = a, b
            best = self._better(best, n, text, low, high)
            if best is not None and best[0] <= k:
                out.append((n, best[0], k, best[1]))
                if first_only:
                    return out
        return out

    def _better(self, best, n: int, text: str, low: int, high: int):
        item = self.items[n][1]
        window = text[low:high]
        at = window.find(item)
        d, end = (0, at + len(item)) if at >= 0 else myers_search(self.masks[n], len(item), window)
        return (d, low + end) if best is None or d < best[0] else best


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The test items as lists of (item_id, normalised text), each of about ``block_chars`` characters at most."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if chars <= block_chars else -(-2 * chars // block_chars)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == b) if n > 1 else items
        if block := [(r["item_id"], t) for r in rows.collect() if (t := normalise(r["text"]))]:
            yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


_built: dict[tuple[str, float], ItemMatcher] = {}


def _matcher(name: str, held, rate: float) -> ItemMatcher:
    """Once in a Python worker for each broadcast block. ``name`` is the block's own: a worker that serves many tasks may
    see another block's broadcast at the same address."""
    key = (name, rate)
    if key not in _built:
        _built.clear()
        _built[key] = ItemMatcher(held.value, rate)
    return _built[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, distance, budget, end_char) for each document and test item that it holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text"))  # pandas would round a long beside NULL
    schema = "doc_id string, item_id string, distance int, budget int, end_char long"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, block_chars):
        held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            matcher = _matcher(name, held, rate)
            for batch in batches:
                rows = [
                    (doc_id, None if matcher.items[n][0] is None else str(matcher.items[n][0]), d, k, end)
                    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                    for n, d, k, end in matcher.matches(text)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "end_char"])

        out = out.unionByName(docs.mapInPandas(search, schema))
    return out.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})


def holds_leak(text: Column, block, rate: float = ERROR_RATE) -> Column:
    """Boolean column: the text holds a test item of the broadcast block."""
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(name, block, rate)
        for texts in batches:
            yield pd.Series([bool(matcher.matches(x if isinstance(x, str) else None, first_only=True)) for x in texts], dtype=bool)

    return leaks(text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pipeline form: the rows that hold no test item; columns unchanged, nothing is shuffled."""
    for block in blocks(benchmark, block_chars):
        docs = docs.where(~holds_leak(F.col("text"), docs.sparkSession.sparkContext.broadcast(block), rate))
    return docs
