"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact check.

The size of the windows follows the item: about half its words, so that a
passage with one word changed, added or left out still has an untouched window.
A window's 64-bit SimHash is taken over its word pairs, for every place of
every text.  All windows of the items are kept by four blocks of 16 bits; a
fingerprint within three bits of another agrees with it in one block at least,
so looking up four blocks finds all of them.  Each hit places the item in the
text, and windows of the item's own size there are compared exactly: weighted
Jaccard similarity of five-word shingles, 0.8 or more.

An item of one to four words has one shingle, all its words: it is found where
these words stand in this order, at any place.

Null texts are empty and match nothing, as items without words do.  Ids of any
type, null ones among them, are carried; repeated items match each for itself,
equal rows once.  Texts are read whole, and columns of other names are kept or
left out as they are.  An empty table on either side gives no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.arrays import SHINGLE, SHORT_STEPS, Words, blocks, mix, similarity, weighted
from siltstone.llm.storage import mapped

SIMILARITY, RADIUS = 0.8, 3
#: Window sizes grow by a third; the largest keeps the byte counters below 128.
SIZES = tuple(dict.fromkeys(int(3 * (4 / 3) ** k) for k in range(13)))
#: Items that are searched for in one pass over the documents; more take more passes.
ITEMS = 20_000
_CHUNK = 8192
_SHORT = SHORT_STEPS
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_HIGH, _GATHER = np.uint64(0x8080808080808080), np.uint64(0x0102040810204080)


def window_size(words: int) -> int:
    return max(s for s in SIZES if s <= max(SIZES[0], (words + 1) // 2))


class Fingerprints:
    """SimHash of all windows over a sequence of words.

    Eight 64-bit integers hold a place's 64 bits as bytes; their running sums
    give the 64 counts of any window by one subtraction each.
    """

    def __init__(self, pairs: np.ndarray):
        self.sums = np.zeros((8, len(pairs) + 1), np.uint64)
        for k, byte in enumerate(pairs.view(np.uint8).reshape(-1, 8).T):
            np.cumsum(_SPREAD[byte], out=self.sums[k, 1:])

    def blocks(self, size: int, start: int, stop: int) -> list[np.ndarray]:
        """Four arrays of 16 bits for the windows of `size` words that begin at start to stop."""
        span = size - 1  # of pairs
        lift = np.uint64(int.from_bytes(bytes([127 - span // 2] * 8)))
        lanes = []
        for k in range(8):
            x = self.sums[k, start + span : stop + span] - self.sums[k, start:stop]
            x += lift
            x &= _HIGH
            x >>= np.uint64(7)
            x *= _GATHER
            x >>= np.uint64(56)
            lanes.append(x)
        return [lanes[2 * k] | (lanes[2 * k + 1] << np.uint64(8)) for k in range(4)]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] | (parts[1] << np.uint64(16)) | (parts[2] << np.uint64(32)) | (parts[3] << np.uint64(48))


class Index:
    """Fingerprints of the items' windows by size and block, and the items' shingles."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()))
        self.lengths = words.counts
        shingles, counts = words.shingles()
        self.shingles = [weighted(s) for s in np.split(shingles, np.cumsum(counts)[:-1])]
        prints = Fingerprints(words.grams(2))
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, (a, n) in enumerate(zip(words.at.tolist(), self.lengths.tolist(), strict=False)):
            if n >= SHINGLE:
                size = window_size(n)
                places = n - size + 1
                found.setdefault(size, []).append((joined(prints.blocks(size, a, a + places)), np.full(places, item), np.arange(places)))
        # short items by their number of words: sorted hashes and the items that have them
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SHINGLE):
            own = np.flatnonzero(self.lengths == n)
            if len(own):
                keys = np.array([self.shingles[i][0][0] for i in own], np.uint64)
                order = np.argsort(keys, kind="stable")
                self.short[n] = keys[order], own[order]
        self.sizes = {}
        for size, parts in found.items():
            values, items, offsets = (np.concatenate(x) for x in zip(*parts, strict=True))
            by_block = []
            for k in range(4):
                keys = (values >> np.uint64(16 * k)) & np.uint64(0xFFFF)
                order = np.argsort(keys, kind="stable")
                by_block.append((order, np.searchsorted(keys[order], np.arange(65537, dtype=np.uint64))))
            self.sizes[size] = (values, items, offsets, by_block, [np.diff(b) > 0 for _, b in by_block])

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of a word where an item would begin, item) for windows within the radius of one of the item's."""
        pairs = words.grams(2)
        prints = Fingerprints(pairs)
        ends = np.repeat(words.at[1:], words.counts)
        for size, (values, items, offsets, by_block, there) in self.sizes.items():
            last = len(pairs) - size + 1
            for start in range(0, last, _CHUNK):
                stop = min(last, start + _CHUNK)
                parts = prints.blocks(size, start, stop)
                any_hit = there[0][parts[0]]
                for k in (1, 2, 3):
                    any_hit = any_hit | there[k][parts[k]]
                at = np.flatnonzero(any_hit)
                at = at[start + at + size <= ends[start + at]]
                if not len(at):
                    continue
                own = joined([p[at] for p in parts])
                for k, (order, bounds) in enumerate(by_block):
                    keys = parts[k][at].astype(np.int64)
                    n = bounds[keys + 1] - bounds[keys]
                    which = np.repeat(np.arange(len(at)), n)
                    entry = order[np.repeat(bounds[keys] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    near = np.bitwise_count(own[which] ^ values[entry]) <= RADIUS
                    if near.any():
                        yield start + at[which[near]] - offsets[entry[near]], items[entry[near]]

    def short_hits(self, words: Words) -> Iterator[tuple[int, int]]:
        """(place, item) where the words of a short item stand in a text."""
        ends = np.repeat(words.at[1:], words.counts)
        for n, (keys, items) in self.short.items():
            sums = np.zeros(max(0, len(words.hashes) - n + 1), np.uint64)
            for k in range(n):
                sums += words.hashes[k : k + len(sums)] * _SHORT[k]
            sums = mix(sums)
            low, high = np.searchsorted(keys, sums), np.searchsorted(keys, sums, "right")
            for at in np.flatnonzero((high > low) & (np.arange(len(sums)) + n <= ends[: len(sums)])).tolist():
                for item in items[low[at] : high[at]].tolist():
                    yield at, item

    def matches(self, column: pa.Array, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): the best window for each text and item that has one."""
        words = Words(column)
        best: dict[tuple[int, int], tuple[int, int, float]] = {}
        for at, item in self.short_hits(words):
            t = int(np.searchsorted(words.at, at, "right")) - 1
            best.setdefault((t, item), (at - int(words.at[t]), int(self.lengths[item]), 1.0))
        found = list(self.hits(words))
        if not found:
            return [(t, item, *x) for (t, item), x in sorted(best.items())]
        starts, items = (np.concatenate(x) for x in zip(*found, strict=True))
        grams = words.grams(SHINGLE)
        for start, item in np.unique(np.stack([starts, items]), axis=1).T.tolist():
            n = int(self.lengths[item])
            # an item may begin before the text does; the hit itself lies inside
            inside = min(max(start, 0) + n // 2, len(words.hashes) - 1)
            t = int(np.searchsorted(words.at, inside, "right")) - 1
            low, high = int(words.at[t]), int(words.at[t + 1])
            for first in (start, start - 1, start + 1):
                for length in (n, n - 1, n + 1):
                    a, b = max(first, low), min(first + length, high)
                    if b - a >= SHINGLE:
                        s = similarity(weighted(grams[a : b - SHINGLE + 1]), self.shingles[item])
                        if s >= threshold and s > best.get((t, item), (0, 0, 0.0))[2]:
                            best[t, item] = (a - low, b - a, s)
        return [(t, item, *x) for (t, item), x in sorted(best.items())]


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """Items in lists of bounded size; each list goes over the documents once."""
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct()
    n = rows.count()
    turns = max(1, -(-n // ITEMS))
    for turn in range(turns):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn) if turns > 1 else rows
        yield sorted(part.collect(), key=lambda r: (r.item_id is None, str(r.item_id), r.text))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): each item in each text that holds it, at its best place."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    kind, out = to_arrow_type(benchmark.schema["item_id"].dataType), None
    for rows in _passes(benchmark):
        items = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index([t for _, t in items.value])
            ids = [i for i, _ in items.value]
            for batch in batches:
                for block in blocks(batch):
                    found = index.matches(block.column("text"), threshold)
                    texts, which, first, n, like = zip(*found, strict=True) if found else ([],) * 5
                    columns = [block.column("doc_id").take(pa.array(texts, pa.int64())), pa.array([ids[i] for i in which], kind), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(like, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        part = mapped(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts hold no item; nothing is shuffled."""
    for rows in _passes(benchmark):
        items = docs.sparkSession.sparkContext.broadcast([r.text for r in rows])

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items.value)
            for batch in batches:
                for block in blocks(batch):
                    clean = np.ones(len(block), bool)
                    clean[[m[0] for m in index.matches(block.column("text"), threshold)]] = False
                    yield block.filter(pa.array(clean))

        docs = mapped(docs, run, docs.schema)
    return docs
