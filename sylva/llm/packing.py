"""Best-fit packing of tokenised documents into sequences of fixed capacity, with certified bin counts and repacking.

Documents are tokenised where they lie and cut only if longer than a sequence; from there on a piece is a row of six
numbers. Pieces are dealt at random into parts of about PART, each small enough for a task. A part is packed by best-fit
decreasing; dual-feasible functions of its lengths give a lower bound for its sequences. If the two meet, the part is
certified: only its emptiest sequence goes on. A part with a gap keeps the sequences that waste nothing and gives all others
away. What goes on is dealt anew, so parts exchange documents, and is packed again; a new round counts only if it needs fewer
sequences than the one before, and the rounds end when the whole of what is left meets its bound, or nothing is gained.

Rows: every row is a document of its own, repeated ids and rows too; NULL text is empty and an empty text is one closing
token. NULL ids stay NULL. An empty table gives no rows. Other columns aren't read. Equal lengths go in the order of the
pieces' numbers.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import release, spool

CAPACITY = 2_048
#: The token that closes every document.
CLOSING = 0
#: Pieces in a part, about; rounds of exchange at most.
PART, ROUNDS = 8_192, 8
#: Words whose tokens a worker remembers.
REMEMBERED = 600_000

#: Texts of these characters alone are split here as the tokenizer's own rule says: lower-cased, then contractions, runs of
#: letters, single digits, runs of other signs.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7EÀ-ÿ]*")
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D\x20a-z0-9ß-öø-ÿ]+")
WORD = re.compile(r"[^\x09-\x0D\x20]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Known(dict):
    """Words and their ids as little-endian 32-bit numbers, learnt from the model when first asked for; forgotten all at once
    when they get too many."""

    def __init__(self, model: object) -> None:
        self.model = model
        self.letters = {c: "".join(_byte_letters()[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[unit] = array("I", [t.id for t in self.model.tokenize(unit if unit.isascii() else unit.translate(self.letters))]).tobytes()
        return ids


class Encoder:
    """Token ids of whole texts by a tokenizer file, each distinct word asked for once. White space parts words and stands
    for no token, so a word's ids don't depend on its surroundings. A word of plain characters goes to the model itself, one
    with others through the whole tokenizer, and so does a text with a special token's string."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)")
        self.known = Known(self.whole.model)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, UNIT.findall(text.lower())))

    def _full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if self.special.search(text):
            return self._full(text)
        if PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join(self._plain(word) if PLAIN.fullmatch(word) else self._full(word) for word in WORD.findall(text))


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)


def cut(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text) to pieces (doc_id, piece, start, length, ids_crc32)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, closing = encoder(path).ids, np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(batch.column("text")):
                ids = np.frombuffer(ids_of(text.as_py() or "") + closing, "<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((row, piece, start, len(part), zlib.crc32(part.tobytes())))
            at, piece, start, length, crc = (np.array(rows, np.int64).reshape(-1, 5)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these lengths (1 to capacity) need at least: the best of two families of dual-feasible
    functions, each of which maps lengths so that no sequence can hold more than 1 of the images."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    n, size = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    # f_k: lengths above capacity - k count 1, lengths below k count 0, the others their share
    k = np.arange(capacity // 2 + 1)
    below = np.maximum(k - 1, 0)
    best = ((n[capacity] - n[capacity - k]) + -(-(size[capacity - k] - np.where(k > 0, size[below], 0)) // capacity)).max()
    # u_k: a share x stays if (k + 1) x is whole, else floor((k + 1) x) / k
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        exact, times = (k + 1) * x % capacity == 0, (k + 1) * x // capacity
        image = np.where(exact, x * k, times * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((count * image).sum()) // (k * capacity)))
    return int(best)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (sequence of each piece, its offset there, tokens in each sequence). Open sequences are kept by
    the room they have left, and the rooms that occur as bits of one number, so the best fit is its lowest bit from the
    length on."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: dict[int, list[int]] = {}
    bits, filled = 0, []
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, at = capacity, len(filled)
            filled.append(0)
        where[i], offset[i] = at, filled[at]
        filled[at] += length
        left = room - length
        if left:
            rooms.setdefault(left, []).append(at)
            bits |= 1 << left
    return where, offset, np.array(filled, np.int64)


PLACED = "sequence_id long, offset long, sequences long, bound long, goes_on boolean"


def _pack_part(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        lengths, rows = part["length"].to_numpy(), part["row"].to_numpy()
        where, offset, filled = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        name = np.full(len(filled), np.iinfo(np.int64).max)
        np.minimum.at(name, where, rows)
        goes_on = np.arange(len(filled)) == np.argmin(filled) if len(filled) == bound else filled < capacity
        return part.assign(sequence_id=name[where], offset=offset, sequences=len(filled), bound=bound, goes_on=goes_on[where])

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(placed, certificates) of ``pieces`` (row: a number of its own, length; other columns are kept, as long as none is named
    like a column of PLACED or ``part``). placed adds sequence_id, the least row number in the sequence, and offset;
    certificates has (round, part, sequences, bound) of every part packed, the last round's parts being what is left."""
    columns = pieces.columns
    placed = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    left, before, certificates = pieces.where(F.col("length") < capacity), None, []
    for round_ in range(rounds):
        n = left.count()
        if not n:
            break
        parts = -(-n // part)
        dealt = left.select(*columns, F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts)).alias("part"))
        now = spool(dealt.groupBy("part").applyInPandas(_pack_part(capacity), f"{schema}, part long, {PLACED}"), "packing-round")
        parts_of = now.groupBy("part").agg(F.first("sequences").alias("sequences"), F.first("bound").alias("bound"))
        total, bound = parts_of.agg(F.sum("sequences"), F.sum("bound")).first()
        if before is not None and total >= before:
            placed = placed.unionByName(kept_on.select(*columns, "sequence_id", "offset"))
            release(now)
            break
        certificates.append(parts_of.select(F.lit(round_).alias("round"), "part", "sequences", "bound"))
        done = now
        if parts > 1 or total > bound:
            done, kept_on = now.where(~F.col("goes_on")), now.where("goes_on")
            before = kept_on.select("sequence_id").distinct().count()
            left = kept_on
        placed = placed.unionByName(done.select(*columns, "sequence_id", "offset"))
        if parts == 1 and total == bound:
            break
    else:
        placed = placed.unionByName(kept_on.select(*columns, "sequence_id", "offset"))
    empty = pieces.sparkSession.createDataFrame([], "round int, part long, sequences long, bound long")
    return placed, functools.reduce(DataFrame.unionByName, certificates, empty)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) by the tokenizer file at ``tokenizer``, which every executor must have: (doc_id,
    piece, start, length, ids_crc32, row), row a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(cut(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return spool(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    placed, _ = pack_pieces(tokenised(docs, tokenizer, capacity), capacity)
    return placed.drop("row")
