"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under their common form.

Vocabulary: runs of letters counted over whole texts; the words that are long and frequent enough stay, one row each.

Neighbourhood. Being near is symmetric, so every pair is looked for once: from its longer word by deleting a character, or
from the replaced character of the lower code point. A word's edits aren't written out: the hash of a word is a sum of
character times a power of a constant, so the hash of an edit follows from the word's by an addition, for all words of a
length and all edits at a place at once. The hashes probe Bloom filters in blocks of 512 bits, one filter a length, filled
by the vocabulary. Only edits that the filter knows become strings and are shuffled, to an exact join with the vocabulary,
which removes the false ones.

Size of what is broadcast: 2 bytes a word, FILTER_BYTES at most at a time. The words' blocks are dealt into as many ranges
as that takes, each a filter of its own, and the vocabulary is probed once a range; so a larger vocabulary means more
passes, not larger broadcasts.

Rows: every row counts, repeated ids and rows too; NULL text has no words, a NULL id reads as the empty string where the
run's noise is drawn. An empty table gives no rows. Among near words of equal n the least in code-point order is the form.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, release, spool

#: Fewest characters and occurrences of a word; its form must be so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many runs loses a character, by the checksum of document and run.
NOISE = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All characters of a word.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)

#: Bits of a filter that a word gets, places that it sets in its block of eight 64-bit numbers, bytes of a filter at most.
BITS, PLACES, FILTER_BYTES = 16, 6, 64 << 20
#: Words that are probed together.
TOGETHER = 4_096
BASE = np.uint64(0x9E3779B97F4A7C15)


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of letters of at least so many characters, as an array."""
    return F.regexp_extract_all("text", F.lit(rf"[A-Za-z\x{{C0}}-\x{{FF}}]{{{least},}}"), F.lit(0))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    run = docs.select("doc_id", F.explode(runs(docs, least_length)).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _matrix(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each word of this length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(length + 1, BASE))


def _hashes(chars: np.ndarray) -> np.ndarray:
    """Sum of character times BASE^(place + 1), modulo 2^64."""
    return (chars * _powers(chars.shape[1])[: chars.shape[1]]).sum(axis=1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    """One of ``blocks``, by the upper 32 bits."""
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _lane_bits(mixed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th place in a block, as (64-bit number, bit); places are steps of an odd number, by the lower 32 bits."""
    low = mixed & np.uint64(0xFFFFFFFF)
    place = ((low & np.uint64(0xFFFF)) + np.uint64(k) * ((low >> np.uint64(16)) | np.uint64(1))) & np.uint64(511)
    return place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))


class Filters:
    """Blocks of all lengths one after the other: those of a length from ``first[length]`` on, ``blocks[length]`` of them."""

    def __init__(self, words_by_length: dict[int, int]) -> None:
        self.blocks = {length: max(1, -(-n * BITS // 512)) for length, n in sorted(words_by_length.items())}
        ends = np.cumsum([0, *self.blocks.values()])
        self.first = dict(zip(self.blocks, ends.tolist(), strict=False))
        self.size = int(ends[-1])

    def places(self, length: int, mixed: np.ndarray) -> np.ndarray:
        return _block(mixed, self.blocks[length]) + np.uint64(self.first[length])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    words: dict[int, list[str]] = {}
    for word in batch.column("word").to_pylist():
        words.setdefault(len(word), []).append(word)
    for length, same in words.items():
        for k in range(0, len(same), TOGETHER):
            yield length, same[k : k + TOGETHER]


LANES = [f"w{k}" for k in range(8)]


def _fill(filters: Filters, begin: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks from begin to end - 1, as far as this task's words set bits there: (block, eight numbers)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((end - begin, 8), np.uint64)
        for batch in batches:
            for length, words in _by_length(batch):
                mixed = _mixed(_hashes(_matrix(words, length)))
                block = filters.places(length, mixed)
                here = (block >= begin) & (block < end)
                block, mixed = (block[here] - np.uint64(begin)).astype(np.int64), mixed[here]
                for k in range(PLACES):
                    lane, bit = _lane_bits(mixed, k)
                    np.bitwise_or.at(bits, (block, lane.astype(np.int64)), bit)
        used = np.flatnonzero(bits.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used + begin), *(pa.array(bits[used, k].view(np.int64)) for k in range(8))], ["block", *LANES])

    return fill


def _known(filters: Filters, bits: np.ndarray, begin: int, length: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes of edits of this length the blocks from ``begin`` on know."""
    if length not in filters.blocks:
        return np.empty(0, np.int64)
    mixed = _mixed(hashes)
    block = filters.places(length, mixed)
    left = np.flatnonzero((block >= begin) & (block < begin + len(bits)))
    block, mixed = (block[left] - np.uint64(begin)).astype(np.int64), mixed[left]
    for k in range(PLACES):
        lane, bit = _lane_bits(mixed, k)
        hit = (bits[block, lane.astype(np.int64)] & bit) != 0
        left, block, mixed = left[hit], block[hit], mixed[hit]
    return left


def _probe(filters: Filters, bits: object, begin: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, n, edit): the edits that the filter knows; ``bits`` is a broadcast array of blocks."""

    def edits(length: int, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        chars, power, blocks = _matrix(words, length), _powers(length), bits.value
        terms = chars * power[:length]
        whole = terms.sum(axis=1, dtype=np.uint64)
        before = np.zeros(len(words), np.uint64)
        after = (chars[:, 1:] * power[: length - 1]).sum(axis=1, dtype=np.uint64)  # what follows the place, moved down by one
        for place in range(length):
            # of equal characters side by side one is deleted, as either leaves the same word
            own = np.flatnonzero(chars[:, place] != chars[:, place + 1]) if place + 1 < length else np.arange(len(words))
            at = own[_known(filters, blocks, begin, length - 1, (before + after)[own])]
            yield at, [words[i][:place] + words[i][place + 1 :] for i in at.tolist()]
            higher = LETTERS[None, :] > chars[:, place, None]
            row, letter = np.nonzero(higher)
            at = _known(filters, blocks, begin, length, whole[row] + (LETTERS[letter] - chars[row, place]) * power[place])
            row, letter = row[at], letter[at]
            yield row, [words[i][:place] + chr(c) + words[i][place + 1 :] for i, c in zip(row.tolist(), LETTERS[letter].tolist(), strict=True)]
            before += terms[:, place]
            if place + 1 < length:
                after -= chars[:, place + 1] * power[place]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
            for length, words in _by_length(batch):
                found = [(words[i], edit) for at, made in edits(length, words) for i, edit in zip(at.tolist(), made, strict=True)]
                word, edit = [w for w, _ in found], [e for _, e in found]
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array([count[w] for w in word], pa.int64()), pa.array(edit, pa.string())], ["word", "n", "edit"])

    return probe


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): each pair of near words of ``words`` (word, n; distinct, read several times) once."""
    spark = words.sparkSession
    filters = Filters({r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()})
    step = max(1, filter_bytes // 64)
    edits = spark.createDataFrame([], "word string, n long, edit string")
    for begin in range(0, filters.size, step):
        end = min(begin + step, filters.size)
        blocks = words.mapInArrow(_fill(filters, begin, end), ", ".join(f"{c} long" for c in ["block", *LANES])).groupBy("block").agg(*(F.bit_or(c).alias(c) for c in LANES))
        table = blocks.toArrow()
        bits = np.zeros((end - begin, 8), np.uint64)
        bits[table.column("block").to_numpy() - begin] = np.stack([table.column(c).to_numpy() for c in LANES], axis=1).view(np.uint64)
        edits = edits.unionByName(words.mapInArrow(_probe(filters, spark.sparkContext.broadcast(bits), begin), "word string, n long, edit string"))
    return edits.join(words.select(F.col("word").alias("edit"), F.col("n").alias("other_n")), "edit").select("word", "n", F.col("edit").alias("other"), "other_n")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text). A word's form is its most frequent near
    word, if that has ``times`` times its occurrences; root is the end of the chain of forms. As n grows by ``times`` with
    every step, the chains are followed by doubling in a few rounds."""
    words = spool(vocabulary(docs, least_length, least_count), "variant-words")
    pairs = spool(near_pairs(words, filter_bytes), "variant-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), "other")).alias("best"))
    is_form = -F.col("best.neg") >= times * F.col("n")
    near = spool(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.neg")).alias("form_n")), "variant-forms")
    chains = spool(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = by_ids(chains, further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = spool(jumped, "variant-chains")
        moved = not jumped.where("moved").isEmpty()
        release(chains)
        chains = jumped.drop("moved")
        if not moved:
            break
    out = words.join(near, "word", "left")
    out = out.where("form IS NULL").withColumn("root", F.col("word")).unionByName(by_ids(out.where("form IS NOT NULL"), chains, "word", "inner"))
    return out.select("word", "form", "root", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
