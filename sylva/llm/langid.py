"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: slot ``j`` is an integer whose bit ``l`` says that language ``l``'s
Bloom filter has bit ``j`` set. A lookup ANDs the slots of an n-gram's hashes and so returns the set of *all* languages
that contain the n-gram. A document's language is decided by per-language popcounts over its n-grams, each corrected
for that language's false-positive rate.

Defined cases: NULL text, empty text and text without a letter are ``und`` with score 0; a text whose n-grams are in no
filter gets the language with most training documents and score 0; ties go to the language with more training
documents, then by code point; with nothing to learn from, every row is ``und``. Repeated rows are scored alike. Extra
columns pass through, but for columns called lang_pred, score or held_out, which ``identify`` replaces;
``keep_identified`` keeps columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
SIZES = (3, 4)
HASHES = 3
#: Code points handled at once; longer texts are walked in overlapping pieces.
PIECE = 100_000


@dataclass(frozen=True)
class LanguageFilters:
    """slots: (m, words) uint64, 63 languages a word; fp: false-positive rate of each language's filter."""

    langs: tuple[str, ...]
    slots: np.ndarray
    fp: np.ndarray


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all letter n-grams (a gap counts as one boundary mark) and the row that each belongs to."""
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    found, rows = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        ok = owner[:last] == owner[n - 1 :]
        for k in range(1, n - 1):
            ok &= letter[k : last + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h + codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        found.append(_mix(h))
        rows.append(owner[at])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and row numbers, about PIECE code points at a time; every row is closed by boundary marks."""
    held, rows, size = [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(f" {text} ") if text else np.zeros(0, np.uint32)
        for start in range(0, max(len(codes) - max(SIZES) + 1, min(len(codes), 1)), PIECE):  # a text of one letter is a piece, too
            part = codes[start : start + PIECE + max(SIZES) - 1]
            held.append(part)
            rows.append(np.full(len(part), i, np.int64))
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(rows)


def _slots_of(h: np.ndarray, m: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(m - 1)).astype(np.int64)


def build_filters(ngrams: dict[str, np.ndarray], bits_per_ngram: int = 16) -> LanguageFilters:
    """``ngrams``: each language's n-gram hashes, languages in order of preference on ties."""
    langs = tuple(ngrams)
    most = max((len(x) for x in ngrams.values()), default=1)
    m = 1 << max(10, int(np.ceil(np.log2(max(1, most * bits_per_ngram)))))
    slots = np.zeros((m, max(1, -(-len(langs) // 63))), np.uint64)
    for j, lang in enumerate(langs):
        for at in _slots_of(ngrams[lang], m):
            slots[at, j // 63] |= np.uint64(1) << np.uint64(j % 63)
    fill = np.array([float(np.mean((slots[:, j // 63] >> np.uint64(j % 63)) & np.uint64(1))) for j in range(len(langs))])
    return LanguageFilters(langs, slots, fill**HASHES)


def masks_of(filters: LanguageFilters, h: np.ndarray) -> np.ndarray:
    """For each n-gram hash the bitmask words of all languages that contain it."""
    out = np.full((len(h), filters.slots.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in _slots_of(h, len(filters.slots)):
        out &= filters.slots[at]
    return out


def score_texts(filters: LanguageFilters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    n_rows, n_langs = len(texts), len(filters.langs)
    hits, total = np.zeros((n_rows, n_langs)), np.zeros(n_rows)
    lettered = np.zeros(n_rows, bool)
    for codes, owner in _pieces(texts):
        lettered[owner[_letters()[np.minimum(codes, 0x10FFFF)]]] = True
        h, rows = ngram_hashes(codes, owner)
        total += np.bincount(rows, minlength=n_rows)
        masks = masks_of(filters, h)
        for j in range(n_langs):
            on = (masks[:, j // 63] >> np.uint64(j % 63)) & np.uint64(1)
            hits[:, j] += np.bincount(rows, weights=on, minlength=n_rows)
    if not n_langs:
        return [UNDETERMINED] * n_rows, [0.0] * n_rows
    share = np.clip((hits / np.maximum(total, 1)[:, None] - filters.fp) / np.maximum(1 - filters.fp, 1e-9), 0, 1)
    best = share.argmax(axis=1)
    return (
        [filters.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)],
        [float(share[i, b]) if lettered[i] else 0.0 for i, b in enumerate(best)],
    )


def fit(training: DataFrame, max_docs: int = 3000, top: int = 8000) -> LanguageFilters:
    """Learn filters from rows (text, lang): at most about ``max_docs`` whole texts a language, chosen by a hash of the
    text, and the ``top`` most frequent n-grams of each. Languages with most rows come first."""
    training = training.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = training.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    if not sizes:
        return build_filters({})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    sample = training.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for codes, owner in _pieces(list(part["text"])):
                    h, n = np.unique(ngram_hashes(codes, owner)[0].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "ngram": h, "n": n})

    counted = sample.mapInPandas(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(_by_lang())
    kept = counted.withColumn("rank", first).where(F.col("rank") <= top).select("lang", "ngram").toPandas()  # top x languages
    return build_filters({r["lang"]: kept.loc[kept["lang"] == r["lang"], "ngram"].to_numpy(np.int64).view(np.uint64) for r in sizes})


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")


def predict(filters: LanguageFilters, text: Column) -> Column:
    """Struct column (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = score_texts(filters, [x if isinstance(x, str) else None for x in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return scored(text)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def identify(docs: DataFrame, max_docs: int = 3000, top: int = 8000) -> DataFrame:
    """``docs`` with lang_pred, score and held_out; filters learnt from the rows that aren't held out."""
    filters = fit(docs.where(~held_out(F.col("doc_id"))), max_docs, top)
    others = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return docs.select(*others, held_out(F.col("doc_id")).alias("held_out"), predict(filters, F.col("text")).alias("score")).select(*others, "held_out", "score.lang_pred", "score.score")


#: Documents whose best language explains less than this share of their n-grams are rejected.
MIN_SCORE = 0.2


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pipeline form: the rows with a determined language; columns unchanged."""
    filters = fit(docs.where(~held_out(F.col("doc_id"))))
    judged = docs.select(F.struct(*docs.columns).alias("doc"), predict(filters, F.col("text")).alias("found"))
    return judged.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= min_score)).select("doc.*")
