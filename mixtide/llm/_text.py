"""Vectorised text kernel: words of whole Arrow string columns as 64-bit hashes, in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased unless asked otherwise. A word's hash is a polynomial
of its bytes modulo 2**64, read off prefix sums, then mixed; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive documents: hash, byte range in data, and for each document its range of words."""

    data: np.ndarray  # bytes, lower-cased where asked
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i] .. bounds[i + 1]
    first: int  # index of the first document in the batch
    sums: np.ndarray

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash that the bytes start .. end would have as a word."""
        return mix((self.sums[end] - self.sums[start]) * _power(len(self.sums))[1][start])

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about size bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array, size: int = BLOCK, lower: bool = True) -> Iterator[Words]:
    data, offsets = string_buffers(column)
    for i, j in blocks(offsets, size):
        at = offsets[i : j + 1] - offsets[i]
        raw = data[offsets[i] : offsets[j]]
        n = len(raw)
        low = _LOWER[raw] if lower else raw
        gap = _SPACE[raw]
        begins = np.ones(n + 1, dtype=bool)
        begins[1:] = False
        begins[at] = True
        first = ~gap
        first[1:] &= gap[:-1] | begins[1:n]
        last = ~gap
        last[:-1] &= gap[1:] | begins[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start])
        yield Words(low, start, end, h, np.searchsorted(start, at), i, sums)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words with their documents' numbers; a document of fewer words gives its whole sequence."""
    factor = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) + k) % (1 << 64) | 1) for k in range(n)]
    count = np.diff(w.bounds)
    doc = np.repeat(np.arange(w.n_docs), count)
    m = len(w.hash)
    if m >= n:
        out = w.hash[: m - n + 1] * factor[0]
        for k in range(1, n):
            out = out + w.hash[k : m - n + 1 + k] * factor[k]
        whole = np.arange(m - n + 1) + n <= w.bounds[1:][doc[: m - n + 1]]
        out, doc = mix(out[whole]), doc[: m - n + 1][whole]
    else:
        out, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([mix((w.hash[w.bounds[d] : w.bounds[d + 1]] * np.array(factor[: count[d]])).sum(keepdims=True) + np.uint64(count[d]))[0] for d in short], dtype=np.uint64)
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def distinct_by_document(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, and the documents' bounds in them. doc must ascend."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
