"""N-gram Jaccard self-join, size-aware and heavy-light, with exact components.

A document is the set of its distinct 4-word shingles; two documents link when 100 * |A n B| >= PERCENT * |A u B|.

Signatures. Tokens (64-bit shingle hashes) have one global order: light tokens first, then heavy ones, each by hash. Two
linked sets share, for every c up to their overlap, c tokens of their first n - ceil(0.85 n) + c. *Small* sets are sure to
meet by the fixed-size subsets (pairs, c = 2) of that prefix; *large* sets by scanning the inverted lists of its single
tokens (c = 1). The boundary between small and large is where the cost of one more set's subsets reaches that of scanning
its lists, with the mean list length measured on the data; sets near the boundary do both. A token is heavy if it is in
many prefixes by hash order; so passages that many documents share don't make lists, unless nearly all of a set is heavy.

Lists. Pairs are not emitted for all of a list. Each list first compares all its members with one hub, the member that
shares most (a copy's original shares most with its copies); verified links are contracted into components; the next round
compares only members of different components, by other hubs; the last round compares every remaining cross pair of
every list. Long lists go through blocks in the later rounds. So a link is left out only where its ends are in one component already.

Verification is exact on whole texts; before texts are fetched, parity sketches of a few bits a token drop pairs whose
symmetric difference is proved too large. Equal sets are one node from the start. Components are found by minimum-label
propagation with pointer jumping over tables in the shared folder.

Defined cases: NULL text or text without words has no shingle and is alone, its component its own doc_id; fewer than four
words make one shingle; repeated rows and equal sets share a component; a NULL doc_id takes part, and never is a component
id unless alone; an empty table gives an empty result; extra columns are ignored by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, join_counted, release, spool

WORDS = 4
PERCENT = 85
#: A token in this many prefixes by hash order is heavy; doubled until at most HEAVY_MOST tokens are (32 MB broadcast).
HEAVY = 12
HEAVY_MOST = 2_000_000
#: Hub rounds before the round that compares all remaining cross pairs.
HUB_ROUNDS = 2
#: Lists from this length on are compared in blocks of about BLOCK_SETS sets.
LONG = 48
BLOCK_SETS = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 17  # the arrays of a block stay in the cache
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE)
            down = np.full(size, _BASE_INVERSE)
            up[0] = down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one block and the offsets at which they start: a polynomial over the bytes, mixed."""
    codes = np.frombuffer(data, np.uint8)
    gap = _SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(codes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))
    h = (sums[ends] - sums[starts]) * down[starts]
    return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _blocks(data: bytes) -> Iterator[bytes]:
    """The data in blocks that end between words; a block is longer only for the sake of a longer word."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _windows(h: np.ndarray, w: int) -> np.ndarray:
    """The hash of every ``w`` words in a row."""
    last = max(0, len(h) - w + 1)
    out = np.full(last, w, np.uint64)
    for k in range(w):
        out = _mix(out * np.uint64(0xFF51AFD7ED558CCD) + h[k : k + last])
    return out.view(np.int64)


def _distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))] if len(tokens) else tokens


def _shingles(h: np.ndarray) -> np.ndarray:
    return _distinct(_windows(h, min(WORDS, max(1, len(h)))))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; short texts are hashed together, long ones in blocks."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        h, starts = word_hashes(b" ".join(d for _, d in held))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for _, d in held)]))
        whole = _windows(h, WORDS)  # those across two texts are left out
        for (i, _), a, b in zip(held, cuts, cuts[1:], strict=False):
            out[i] = _distinct(whole[a : b - WORDS + 1]) if b - a >= WORDS else _shingles(h[a:b])
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
        if len(data) > _BLOCK:
            out[i] = _shingles(np.concatenate([word_hashes(b)[0] for b in _blocks(data)]))
            continue
        if size + len(data) >= _BLOCK and held:
            flush()
            size = 0
        held.append((i, data))
        size += len(data) + 1
    if held:
        flush()
    return out


def prefix_length(n: int, c: int, percent: int = PERCENT) -> int:
    return min(n, n - (percent * n + 99) // 100 + c)


def spare_length(q: int) -> int:
    """How many tokens are kept beside a head of ``q``, to take the places of its heavy ones."""
    return q // 4 + 8


def _key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).view(np.int64))


def parity_sketch(tokens: np.ndarray) -> bytes:
    """For each of 2**k hash cells, 2**k at least twice the set size up to 2**15, whether it holds an odd number of
    tokens. Two sketches differ in at most as many cells as the sets' symmetric difference has tokens."""
    size = 1 << min(15, max(6, int(2 * len(tokens)).bit_length()))
    cells = np.bincount((tokens.view(np.uint64) >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference of two sets; the larger sketch is folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    """A column of lists of 64-bit numbers, NULL for None."""
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in parts)])
    values = pa.array(np.concatenate([np.zeros(0, np.int64), *(x for x in parts if x is not None)]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([x is None for x in parts], pa.bool_()))


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, print, n, key, head, spare, sketch) of every row: what finds the row again, set size, set hash, the
    first tokens by hash order, a few that follow them, and the parity sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["text"].to_pylist())
            first = [prefix_length(len(s), 2, percent) for s in sets]
            made = {
                "n": pa.array([len(s) for s in sets], pa.int32()),
                "key": pa.array([_key(s) for s in sets], pa.int64()),
                "head": _lists([s[:q] for s, q in zip(sets, first, strict=True)]),
                "spare": _lists([s[q : q + spare_length(q)] for s, q in zip(sets, first, strict=True)]),
                "sketch": pa.array([parity_sketch(s) for s in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "row", "print")} | made)

    return findable(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(sign, "doc_id long, row long, print long, n int, key long, head array<long>, spare array<long>, sketch binary")


def _found_by() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("row"), F.xxhash64("text").alias("print")]


def findable(docs: DataFrame) -> DataFrame:
    """(doc_id, row, print, text): row and print tell rows with different texts apart, even if ids are NULL or repeat."""
    return docs.select("doc_id", *_found_by(), "text")


def heavy_tokens(heads: DataFrame) -> tuple[np.ndarray, float]:
    """Sorted heavy tokens, a bounded number, as the limit rises until HEAVY_MOST are left; and the mean list length that
    a member of a light token's list meets (the sum of squared list lengths over the sum of lengths)."""
    n = F.col("count")
    counts = heads.select(F.explode("head").alias("token")).groupBy("token").count()
    counts = spool(counts.groupBy(F.when(n >= HEAVY, F.col("token")).alias("token")).agg(F.sum(n).alias("count"), F.sum(n * n).alias("squares")), "heavy")
    light = counts.where("token IS NULL").first()
    heavy, limit = counts.where("token IS NOT NULL"), HEAVY
    while heavy.where(n >= limit).count() > HEAVY_MOST:
        limit *= 2
    return np.sort(heavy.where(n >= limit).select("token").toPandas()["token"].to_numpy(np.int64)), light["squares"] / light["count"] if light else 0.0


def among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``tokens`` are in the sorted ``known``, by a binary search each: np.isin sorts all of ``known`` at every call."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def light_heads(heads: DataFrame, heavy, percent: int) -> DataFrame:
    """(key, row, print, n, head) with heavy tokens last, from heads and spare tokens; head is NULL where these have too
    few light ones and aren't the whole set. ``heavy``: a broadcast sorted array."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            lists = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch["head"], batch["spare"])]
            (first, ends), (more, more_ends) = lists
            bad, bad_more = among(first, known), among(more, known)
            sums = np.concatenate(([0], np.cumsum(bad)))
            out = [first[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            for i in np.flatnonzero(sums[ends[1:]] > sums[ends[:-1]]):
                mine, rest = slice(ends[i], ends[i + 1]), slice(more_ends[i], more_ends[i + 1])
                tokens, m = np.concatenate((first[mine], more[rest])), np.concatenate((bad[mine], bad_more[rest]))
                q = len(out[i])
                if len(tokens) == batch["n"][i].as_py():
                    out[i] = np.concatenate((tokens[~m], tokens[m]))[:q]
                else:
                    out[i] = light[:q] if len(light := tokens[~m]) >= q else None
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("key", "row", "print", "n")} | {"head": _lists(out)})

    return heads.select("key", "row", "print", "n", "head", "spare").mapInArrow(order, "key long, row long, print long, n int, head array<long>")


def light_first(texts: DataFrame, heavy, percent: int) -> DataFrame:
    """(key, n, head) of (key, text) rows with heavy tokens last. ``heavy``: a broadcast sorted array."""

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = heavy.value
        for batch in batches:
            sets = shingle_sets(list(batch["text"]))
            masks = [among(s, known) for s in sets]
            heads = [np.concatenate((s[~m], s[m]))[: prefix_length(len(s), 2, percent)] for s, m in zip(sets, masks, strict=True)]
            yield pd.DataFrame({"key": batch["key"], "n": np.array([len(s) for s in sets], np.int32), "head": heads})

    return texts.mapInPandas(order, "key long, n int, head array<long>")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, text) of the nodes (key, row, print)."""
    return by_ids(findable(docs), nodes.select("key", "row", "print"), ["row", "print"], "inner").select("key", "text")


def boundary(mean: float, percent: int) -> int:
    """Largest set size whose pair subsets cost no more than scanning its lists, at the mean list length that a member
    of a list meets (long lists go by hubs and cost no more than their length)."""
    size = 0
    while size < 2_000 and (q := prefix_length(size + 1, 2, percent)) * (q - 1) / 2 <= max(1, q - 1) * max(2.0, mean):
        size += 1
    return size


def postings(prefixes: DataFrame, small: int, percent: int) -> DataFrame:
    """(signature, key, n) of every node: subsets of small sets, single tokens of large ones and of those that a large
    one may link with."""
    t = F.col("head")
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.xxhash64(x, y, F.lit(2)))))
    none = F.array().cast("array<long>")
    subsets = F.when(F.col("n") <= small, pairs).otherwise(none)
    singles = F.when(F.col("n") * 100 > small * percent, F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1)))).otherwise(none)
    return prefixes.where(F.size("head") > 0).select("key", "n", F.explode(F.concat(subsets, singles)).alias("signature"))


def distinct_lists(found: DataFrame) -> DataFrame:
    """(signature, members) of the lists with more than one member, one for each set of members: the tokens of a passage
    have the same list again and again. Sets are told apart by their number and two 64-bit sums of member hashes, in which a key that
    came twice would cancel: ``found`` has a (signature, key) once at most."""
    lists = found.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where(F.col("members") > 1)
    return lists.groupBy("members", "x", "y").agg(F.min("signature").alias("signature")).select("signature", "members")


def close_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) less those whose sketches alone show that they can't link. ``sketches``: (key, n, sketch)."""

    @F.pandas_udf("boolean")
    def may_link(n_a: pd.Series, a: pd.Series, n_b: pd.Series, b: pd.Series) -> pd.Series:
        # 100 * both >= percent * either, with both + either = n_a + n_b and either - both = the difference
        most = ((100 - percent) * (n_a + n_b)) // (100 + percent)
        return pd.Series([least_difference(x, y) <= m for x, y, m in zip(a, b, most, strict=True)], dtype=bool)

    named = lambda side: sketches.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    at = pairs.join(named("a"), "a").join(named("b"), "b")
    return at.where(may_link("n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. ``texts``: (key, text) of one document of each node."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            once = batch.drop_duplicates("b")
            hubs = dict(zip(once["b"], shingle_sets(list(once["text_b"])), strict=True))
            mine = shingle_sets(list(batch["text_a"]))
            keep = []
            for s, b in zip(mine, batch["b"], strict=True):
                both = len(np.intersect1d(s, hubs[b], assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(hubs[b]) - both))
            yield batch.loc[keep, ["a", "b"]]

    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def connect(links: DataFrame) -> DataFrame:
    """(key, label) of every node of ``links`` (a, b): the smallest key of its component."""
    edges = spool(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = spool(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("key"), "label"), "labels")
    held = labels
    while True:
        near = edges.join(labels, edges["v"] == labels["key"]).groupBy("u").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["key"] == near["u"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = better.join(labels.select(F.col("key").alias("label"), F.col("label").alias("far")), "label", "left")
        after = spool(jump.select("key", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        release(held)
        if after.where(F.col("old") != F.col("label")).isEmpty():
            release(edges)
            return after.select("key", "label")
        held, labels = after, after.select("key", "label")


def prefixes_of(docs: DataFrame, heads: DataFrame, heavy: np.ndarray, percent: int) -> list[DataFrame]:
    """Spooled tables (key, n, head) that together have the nodes, heads in the global order; ``heads`` are by hash order.
    Texts are fetched only where the spare tokens don't make up for the heavy ones."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)
    made = spool(light_heads(heads, held, percent), "prefixes")
    short = made.where("head IS NULL")
    if short.isEmpty():
        return [made]
    again = light_first(texts_of(docs, short), held, percent).dropDuplicates(["key"])  # repeated rows are found again each
    return [made, spool(again, "again")]


def hub_pairs(now: DataFrame, lists: DataFrame) -> DataFrame:
    """Every member of a list with the list's hub, unless their components are the same."""
    at = join_counted(now, lists.select("signature", "members", "hub"), ["signature"], "members")
    return at.select("key", "n", "label", F.col("hub.key").alias("key2"), F.col("hub.n").alias("n2"), F.col("hub.label").alias("label2"))


def cross_pairs(now: DataFrame, lists: DataFrame) -> DataFrame:
    """Every member outside of its list's largest component with every member of other components."""
    at = join_counted(now, lists.select("signature", "members", "largest"), ["signature"], "members")
    odd = at.where(F.col("label") != F.col("largest")).select("signature", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    return at.select("signature", "key", "n", "label").join(odd, "signature").select("key", "n", "label", "key2", "n2", "label2")


def block_pairs(now: DataFrame, lists: DataFrame, labels: DataFrame | None, sketches: DataFrame, percent: int, first_only: bool) -> DataFrame:
    """Close pairs (a, b) of long lists. A group of near copies fills many long lists with much the same members; so all
    lists with one largest component form one group: that component and the odd members of its lists. Odd members meet
    the whole group block by block; only pairs that the sketches leave become rows. ``first_only``: of each member and
    block only the pair with the smallest key, so a clique gets few hubs instead of all its pairs."""
    at = join_counted(now, lists.select("signature", "members", "largest"), ["signature"], "members")
    seen = at.groupBy("largest", "key").agg(F.first("label").alias("label"))
    if labels is not None:  # members of the component that are in other lists only
        rest = seen.select("largest").distinct().withColumn("label", F.col("largest"))
        more = labels.join(rest, "label").select("largest", "key", "label")
        seen = seen.unionByName(more).groupBy("largest", "key").agg(F.first("label").alias("label"))
    sizes = seen.groupBy("largest").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    rows = spool(seen.join(sketches, "key").join(sizes, "largest").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "group")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    fields = ["largest", "i", "j", "key", "label", "n", "sketch"]
    left = rows.where(F.col("label") != F.col("largest")).withColumn("j", every).withColumn("i", F.col("block")).select(*fields)
    right = rows.withColumn("i", every).withColumn("j", F.col("block")).select(*fields)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size, mine in _by_sketch_size(a):
            for other, theirs in _by_sketch_size(b):
                width = min(size, other)
                x, y = _folded(mine["sketch"], size, width), _folded(theirs["sketch"], other, width)
                n_y, key_y, label_y = (theirs[c].to_numpy() for c in ("n", "key", "label"))
                for row, n, key, label in zip(x, mine["n"], mine["key"], mine["label"], strict=True):
                    difference = np.bitwise_count(y ^ row).sum(axis=1, dtype=np.int64)
                    hit = np.flatnonzero((difference <= ((100 - percent) * (n_y + n)) // (100 + percent)) & (label_y != label))
                    near = key_y[hit]
                    found += [(min(key, k), max(key, k)) for k in (near[:0] if not len(near) else [int(near.min())] if first_only else near.tolist())]
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"])

    return left.groupBy("largest", "i", "j").cogroup(right.groupBy("largest", "i", "j")).applyInPandas(compare, "a long, b long")


def _by_sketch_size(rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from rows.groupby(rows["sketch"].map(len))


def _folded(sketches: pd.Series, size: int, width: int) -> np.ndarray:
    out = np.frombuffer(b"".join(map(bytes, sketches)), np.uint8).reshape(-1, size)
    while out.shape[1] > width:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return np.ascontiguousarray(out).view(np.uint64)


def link_members(docs: DataFrame, nodes: DataFrame, members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame | None:
    """(key, label) of all linked nodes of the lists ``members`` (signature, key, n, weight); None without links.

    Texts are fetched only for pairs that the sketches leave."""
    links = labels = None
    for turn in range(HUB_ROUNDS + 1):
        now = members.withColumn("label", F.col("key"))
        if labels is not None:
            now = spool(members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")), "now")
        rank = F.struct((-F.col("weight") if turn == 0 else F.xxhash64("key", F.lit(turn))).alias("rank"), "key", "n", "label")
        groups = now.groupBy("signature", "label").agg(F.count(F.lit(1)).alias("c"), F.min(rank).alias("hub"))
        lists = groups.groupBy("signature").agg(F.sum("c").alias("members"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("largest"), F.min("hub").alias("hub"))
        lists = spool(lists.where(F.col("most") < F.col("members")), "lists")
        if lists.isEmpty():
            break
        last, blocks = turn == HUB_ROUNDS, turn > 0
        short = lists.where(F.col("members") < LONG) if blocks else lists
        pairs = cross_pairs(now, short) if last else hub_pairs(now, short)
        pairs = pairs.where((F.col("label") != F.col("label2")) & (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent))
        pairs = pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()
        close = close_pairs(pairs, sketches, percent)
        if blocks:
            close = close.unionByName(block_pairs(now, lists.where(F.col("members") >= LONG), labels, sketches, percent, not last)).distinct()
        close = spool(close, "close")
        ends = close.select(F.col("a").alias("key")).unionByName(close.select(F.col("b").alias("key"))).distinct()
        texts = spool(texts_of(docs, spool(nodes.join(ends, "key", "left_semi"), "named")).dropDuplicates(["key"]), "texts")
        found = spool(verify(close, texts, percent), "links")
        release(texts, close, lists, now)
        links = found if links is None else links.unionByName(found)
        labels = connect(links)
        if last:
            break
    return labels


def one_a_key(rows: DataFrame, several: DataFrame) -> DataFrame:
    """One row of each key of ``rows``. ``several``: (key, row, print) of the sets that several rows have, with the row
    that stays; only these are looked up, and only these can be there twice."""
    once = by_ids(rows, several.select("key"), ["key"], "left_anti")
    return once.unionByName(by_ids(rows, several, ["key", "row", "print"], "left_semi").dropDuplicates(["key"]))


def placed(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, print, n, key) of every row of ``docs`` (doc_id, text), and (key, copies, component_id, label, row,
    print) of each distinct set: its component's smallest doc_id, the component's own name, and a row that has the set."""
    signed = spool(signatures(docs, percent), "signed")
    nodes = spool(signed.where(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "print")).alias("at")).select("key", "first", "copies", "at.row", "at.print"), "nodes")
    several = nodes.where("copies > 1").select("key", "row", "print")
    heads = one_a_key(signed.where(F.col("n") > 5).select("key", "row", "print", "n", "head", "spare"), several)
    heavy, mean = heavy_tokens(heads)
    parts = prefixes_of(docs, heads, heavy, percent)
    prefixes = reduce(DataFrame.unionByName, (part.where("head IS NOT NULL").select("key", "n", "head") for part in parts))
    found = postings(prefixes, boundary(mean, percent), percent)
    shared = spool(distinct_lists(found), "shared")
    held = spool(join_counted(found, shared, ["signature"], "members"), "members")
    release(*parts, shared)
    weights = held.groupBy("key").agg(F.sum("members").alias("weight"))  # a set that shares much with many is a good hub
    members = spool(held.drop("members").join(weights, "key"), "weighted")
    reps = one_a_key(signed.select("key", "row", "print", "n", "sketch"), several).join(weights.select("key"), "key", "left_semi")
    sketches = spool(reps.select("key", "n", "sketch"), "sketches")
    release(held)
    labels = link_members(docs, nodes, members, sketches, percent)
    release(members, sketches)
    ids = nodes.select("key", "copies", F.col("first").alias("component_id"), F.col("key").alias("label"), "row", "print")
    if labels is not None:
        merged = nodes.join(labels, "key")
        merged = merged.select("key", F.col("label").alias("named")).join(merged.groupBy(F.col("label").alias("named")).agg(F.min("first").alias("least")), "named")
        ids = spool(ids.join(merged, "key", "left").withColumns({"component_id": F.when(F.col("named").isNull(), F.col("component_id")).otherwise(F.col("least")), "label": F.coalesce("named", "label")}).drop("least", "named"), "ids")
    return signed.select("doc_id", "row", "print", "n", "key"), ids


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    rows, ids = placed(docs, percent)
    out = join_counted(rows.where(F.col("n") > 0).select("doc_id", "n", "key"), ids.select("key", "copies", "component_id"), ["key"], "copies").select("doc_id", "n", "component_id")
    alone = rows.where(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pipeline form, columns unchanged: of each component exactly one row stays, that with the smallest doc_id, NULL last,
    then by a hash of the text, then by its other columns; rows without words all stay."""
    rows, ids = placed(docs.select("doc_id", "text"), percent)
    keepers = spool(ids.groupBy("label").agg(F.min(F.struct("row", "print")).alias("at")).select("at.row", "at.print"), "keepers")
    some = rows.where(F.col("n") > 0).groupBy("row", "print").agg(F.count(F.lit(1)).alias("times"))
    marked = some.join(keepers.withColumn("stays", F.lit(True)), ["row", "print"], "left")
    dropped = spool(marked.where("stays IS NULL").select("row", "print"), "dropped")
    repeated = spool(marked.where("stays AND times > 1").select("row", "print"), "repeated")
    named = docs.select(F.struct(*docs.columns).alias("_doc"), *_found_by())
    kept = by_ids(named, dropped, ["row", "print"], "left_anti")
    if not repeated.isEmpty():
        once = by_ids(kept, repeated, ["row", "print"], "left_semi").groupBy("row", "print").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))  # columns of any type, maps too
        kept = by_ids(kept, repeated, ["row", "print"], "left_anti").select("_doc").unionByName(once.select("_doc"))
    return kept.select("_doc.*")
