"""Source divergence audit: how far the word use of each source of a language is from the other sources', and by which terms.

Counting. A task lays its texts out in slices of one buffer, sorts the pointers to all term starts (``pointers``), and
reads counts and document frequencies off the runs of equal terms; texts of one source lie together in a slice, so a run
falls into pieces by source. What leaves a task is one row a (slice, language, source, term), however often a term comes.
One shuffle by (language, term) brings them together.

Comparing. Smoothed shares are whole numbers of billionths and all arithmetic is exact in 64 bits. Pairs of sources are
never made term by term: a task lays a block of terms out as a matrix terms x sources and adds up one matrix sources x
sources a language. The best terms of a source are a top-k, which every task takes before anything is shuffled.

Rows: every row of ``documents`` is a document of its own, repeated ids and rows too. NULL text, language and source are the
empty string. An empty table gives no rows; a language without kept terms gives its pairs with value 0 and no terms. Ties
go by item in the order of UTF-8. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_ids, spool
from .pointers import pointers, slices, sort_pointers, terms_at

#: A language keeps the terms that are in at least so many of its documents.
LEAST_DOCUMENTS = 3
#: Terms listed for each source.
TOP_TERMS = 200
#: Cells of a block's matrix in a task; sources that a task compares with all others at a time.
CELLS, SOURCES = 1 << 20, 1_000


def _slice_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of each slice."""
    for table in slices(batches, "text"):
        langs, sources = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        by = np.argsort(group, kind="stable")
        texts = table.column("text").cast(pa.large_string()).combine_chunks().take(pa.array(by))
        buf, starts, lengths, doc = pointers(texts)
        if not len(starts):
            continue
        order, fresh = sort_pointers(buf, starts, lengths)
        doc = doc[order]
        own = group[by][doc]
        new_doc, new_group = fresh.copy(), fresh.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        new_group[1:] |= own[1:] != own[:-1]
        head = np.flatnonzero(new_group)
        at = order[head]
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(own[head] // len(sources.dictionary))),
                sources.dictionary.take(pa.array(own[head] % len(sources.dictionary))),
                terms_at(buf, starts[at], lengths[at]),
                pa.array(np.diff(head, append=len(order))),
                pa.array(np.add.reduceat(new_doc.astype(np.int64), head)),
            ],
            ["lang", "source", "term", "n", "df"],
        )


def _share(count: str, total: str, terms: str) -> str:
    """1 + floor(10^9 * (count + 1) / (total + terms)), as SQL; long division by thousands, so that nothing overflows."""
    a, d = f"({count} + 1) * 1000", f"({total} + {terms})"
    rest = f"({a} % {d}) * 1000"
    return f"(1 + (({a} div {d}) * 1000 + ({rest} div {d})) * 1000 + ((({rest}) % {d}) * 1000 div {d}))"


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays; ``total`` holds the terms, too."""
    share, rest = np.zeros_like(count), count + 1
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // total
        rest = rest % total
    return share + 1


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, one, other, value): what this task's terms add to the value of each pair of sources. A row is a term: its
    language, the number of kept terms and the sizes of all sources there, ``codes`` and ``ns`` of those that have it, and
    the first source ``begin`` of those to compare."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        langs, begins = batch.column("lang").dictionary_encode(), batch.column("begin").to_numpy()
        codes, ns = batch.column("codes"), batch.column("ns")
        offsets = codes.offsets.to_numpy()
        # a column's values start at its first offset
        flat_codes, flat_ns = codes.values.to_numpy(), ns.values.to_numpy()
        offsets_ns = ns.offsets.to_numpy()
        lang_of = langs.indices.to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            for begin in np.unique(begins[lang_of == code]):
                rows = np.flatnonzero((lang_of == code) & (begins == begin))
                totals = np.array(batch.column("sizes")[rows[0]].as_py(), np.int64) + batch.column("terms")[rows[0]].as_py()
                n = len(totals)
                end = min(begin + SOURCES, n)
                sum_ = sums.setdefault((lang, int(begin)), np.zeros((end - begin, n), np.int64))
                for block in np.array_split(rows, -(-len(rows) * n // CELLS)):
                    have = offsets[block + 1] - offsets[block]
                    row = np.repeat(np.arange(len(block)), have)
                    step = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
                    count = np.zeros((len(block), n), np.int64)
                    count[row, flat_codes[np.repeat(offsets[block], have) + step]] = flat_ns[np.repeat(offsets_ns[block], have) + step]
                    q = _shares(count, totals[None, :])
                    for one in range(begin, end):
                        away = q[:, one, None] - q
                        sum_[one - begin] += (away * away // q).sum(axis=0)
    for (lang, begin), sum_ in sums.items():
        m, n = sum_.shape
        one, other = np.repeat(np.arange(begin, begin + m), n), np.tile(np.arange(n), m)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (m * n), pa.string()), pa.array(one, pa.int32()), pa.array(other, pa.int32()), pa.array(sum_.ravel())], ["lang", "one", "other", "value"])


def count_terms(docs: DataFrame, groups: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, counts): the kept terms with all their occurrences, counts an array of (code, n) over the sources
    that have the term, as many as ``groups`` (lang, source, code) has for the language at most."""
    parts = docs.mapInArrow(_slice_counts, "lang string, source string, term string, n long, df long")
    parts = by_ids(parts, groups, ["lang", "source"], "inner").select("lang", "term", "code", "n", "df").repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "code").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("code", "n")).alias("counts"))
    return terms.where(F.col("df") >= least).drop("df")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source), as the module says: part ``pair`` compares a
    source with every other of its language, part ``term`` has the ``top`` terms that a source uses more than its language."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    named = rows.select("lang", "source").distinct().withColumn("code", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = spool(named, "divergence-groups")
    kept = spool(count_terms(rows, groups, least), "divergence-terms")

    own = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.code").alias("code")).agg(F.sum("c.n").alias("size"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    stats = groups.join(own, ["lang", "code"], "left").join(kinds, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    stats = spool(stats, "divergence-sizes")

    each = by_ids(kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.code", "c.n"), stats, ["lang", "code"], "inner")
    shares = each.select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "size", "terms")).alias("p"), F.expr(_share("total", "lang_size", "terms")).alias("q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    sizes = stats.groupBy("lang").agg(F.max("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("code", "size")))["size"].alias("sizes"))
    blocks = by_ids(kept.select("lang", F.col("counts.code").alias("codes"), F.col("counts.n").alias("ns")), sizes, "lang", "inner")
    blocks = blocks.withColumn("begin", F.explode(F.sequence(F.lit(0), F.size("sizes") - 1, F.lit(SOURCES))))
    sums = blocks.select("lang", "codes", "ns", "terms", "sizes", "begin").mapInArrow(_pair_sums, "lang string, one int, other int, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value")).where("one <> other")
    bare = stats.where("terms = 0").select("lang", F.col("code").alias("one"))
    none = bare.join(bare.withColumnRenamed("one", "other"), "lang").where("one <> other").withColumn("value", F.lit(0).cast("long"))
    names = groups.select("lang", F.col("code").alias("one"), "source")
    items = groups.select("lang", F.col("code").alias("other"), F.col("source").alias("item"))
    pairs = by_ids(by_ids(sums.unionByName(none), names, ["lang", "one"], "inner"), items, ["lang", "other"], "inner")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(best)
