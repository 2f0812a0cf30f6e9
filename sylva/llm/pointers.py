"""Word-start pointers over Arrow text buffers, sorted by multikey quicksort.

A slice of texts is one byte buffer. A pointer is where a term starts in it, so sorting terms moves numbers only. The sort
takes eight bytes of every term as one big-endian key, and goes on to the next eight only within runs of equal keys;
pointers of equal terms end up side by side, in text order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What each byte is in a term: A-Z lower-cased, a-z and all bytes of characters outside ASCII as they are, the rest 0.
TERM_BYTES = np.arange(256, dtype=np.uint8)
TERM_BYTES[:0x80] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 0 for c in range(0x80)]

#: Texts are taken together up to so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of at least one row and about SLICE_BYTES of ``column``, in the order of ``batches``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pointers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with 0 outside terms, where terms start, their lengths in bytes, the text each is in). No term goes from
    one text into the next; NULL must have been replaced."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    buf = TERM_BYTES[raw]
    on = buf != 0
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    filled = ends[:-1] < ends[1:]
    head, tail = ends[:-1][filled], ends[1:][filled] - 1
    first[head], last[tail] = on[head], on[tail]
    starts = np.flatnonzero(first)
    return buf, starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(ends[1:], starts, side="right")


def sort_pointers(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): pointers in order of their terms' bytes, equal terms in the order given, and whether the term at a
    place of that order differs from the one before it. Terms hold no byte 0."""
    n = len(starts)
    order, fresh = np.arange(n), np.zeros(n, bool)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, dtype=">u8", buffer=padded, strides=(1,))
    at, run, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(at):
        part = order[at]
        left = np.clip(lengths[part] - depth, 0, 8)
        beyond = ((8 - left) * 8).astype(np.uint64)
        key = eight[np.minimum(starts[part] + depth, len(buf))].astype(np.uint64)
        key = np.where(left > 0, (key >> (beyond % 64)) << (beyond % 64), 0).astype(np.uint64)
        by = np.lexsort((key, run)) if depth else np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[at] = part
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        fresh[at[new]] = True
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        depth += 8
        more = (np.diff(head, append=len(at)) > 1) & (np.maximum.reduceat(lengths[part], head) > depth)
        at, run = at[more[run]], run[more[run]]
    return order, fresh


def terms_at(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The terms at these pointers, as strings."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    data = buf[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
