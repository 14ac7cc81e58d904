"""Word and shingle hashes of Arrow text columns, in numpy.

Words are maximal runs of letters, digits and bytes above ASCII after lower
casing; everything else separates.  Hashes are 64 bits wide.  A text of one to
four words has one shingle, made of all its words; a text without words has
none.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Texts are worked on in blocks of about this many bytes (at least one text).
BLOCK_BYTES = 512 << 10

_PRIME = np.uint64(0x100000001B3)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEPS = (np.arange(1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
#: Factors of the words of a text that is too short for a whole shingle.
SHORT_STEPS = _STEPS[40:]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        tables = []
        for base in (_PRIME, inverse):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the places where its texts start and end."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text, so that memory doesn't follow the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > limit or i - start >= 32_768):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


class Words:
    """Hashes of the words of a column; `at` has where each text's words start and end."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(pc.utf8_lower(column))
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = _WORD[data]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:]
        self.starts = np.flatnonzero(start[:n])
        stop = inside[:n] & (~inside[1:] | first[1:])
        self.ends = np.flatnonzero(stop) + 1
        up, down = _power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n words from each place on; those over a text's end are to be left out by the caller."""
        out = np.zeros(len(self.hashes), np.uint64)
        for k in range(n):
            if k < len(out):
                out[: len(out) - k] += self.hashes[k:] * _STEPS[k]
        return mix(out)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes, number per text), in the order of the texts."""
        grams = self.grams(SHINGLE)
        keep = np.ones(len(grams), bool)
        counts = np.maximum(self.counts - (SHINGLE - 1), 0)
        for i in range(1, SHINGLE):  # the last four places of a text start no whole shingle
            last = self.at[1:] - i
            keep[last[last >= self.at[:-1]]] = False
        for t in np.flatnonzero((self.counts > 0) & (self.counts < SHINGLE)):
            a, b = self.at[t], self.at[t + 1]
            grams[a] = mix((self.hashes[a:b] * SHORT_STEPS[: b - a]).sum(keepdims=True, dtype=np.uint64))[0]
            keep[a] = True
            counts[t] = 1
        return grams[keep], counts


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each occurs."""
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: shared count over the larger counts' sum; 0 without shingles."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared) if total else 0.0
