"""Quality classifier: support vectors over n-grams scaled by naive Bayes ratios.

Features are indicators of hashed n-grams: a text's words, and one to three
neighbouring word shapes (runs of letters, capitals, digits and signs, and
whether a word repeats the one before).  Each indicator is scaled by its class
log-count ratio; a linear hinge-loss model over them is fitted by dual
coordinate descent and blended with the ratios.  Margins of rows set aside
calibrate the score.

Nulls and empty texts get the score of no features.  Equal texts have equal scores, repeated rows a row each; texts of any
length are scored whole.  An empty table gives an empty one, and a sample without both classes a constant
model.  Only id, text and (for training) label are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.arrays import _power_tables, blocks, buffers, mix
from siltstone.llm.labels import hinge, logistic, sample, sigmoid
from siltstone.llm.storage import mapped

BITS = 18
#: Labelled rows for training, at most.
SAMPLE = 3_000
#: Share of the fitted weights against the mean weight of the ratios.
BLEND = 0.75

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct features of each text, one text after the other; where each text's begin and end)."""
    data, offsets = buffers(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(start[:n])
    ends = np.flatnonzero(inside[:n] & (~inside[1:] | first[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    words = _hashed(data, starts, ends)
    shape = _SHAPE[data]
    kept = inside[:n].copy()
    kept[1:] &= (shape[1:] != shape[:-1]) | start[1:n]
    index = np.cumsum(kept) - 1
    shapes = _hashed(shape[kept], index[starts], index[ends - 1] + 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = np.where(same, shapes ^ np.uint64(0x5555555555555555), shapes)
    mask = np.uint64((1 << BITS) - 1)
    parts, owners = [words & mask, mix(shapes) & mask], [text, text]
    pair = mix(shapes[:-1] * np.uint64(3) + shapes[1:])
    near = text[1:] == text[:-1]
    parts.append(pair[near] & mask)
    owners.append(text[1:][near])
    triple = mix(pair[:-1] * np.uint64(5) + shapes[2:])
    near = text[2:] == text[:-2]
    parts.append(triple[near] & mask)
    owners.append(text[2:][near])
    keys = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(parts))
    return (keys & mask).astype(np.int64), np.searchsorted(keys, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(BITS))


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        found, at = features(column)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[found], dtype=np.float64)])
        return sigmoid(self.slope * (sums[at[1:]] - sums[at[:-1]]) + self.offset)


def train(rows: list[np.ndarray], truth: np.ndarray) -> Model:
    """A constant score where only one label, or none, is there."""
    size = 1 << BITS
    if truth.sum() < 2 or (1 - truth).sum() < 2:
        p = (truth.sum() + 1) / (len(truth) + 2)
        return Model(np.zeros(size, np.float32), 1.0, float(np.log(p / (1 - p))))

    def fitted(some: np.ndarray) -> np.ndarray:
        counts = np.ones((2, size))
        for i in some:
            counts[int(truth[i]), rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        share = truth[some].mean()
        cost = np.where(truth[some] > 0, 0.5 / share, 0.5 / (1 - share))
        scaled = [ratio[rows[i]] for i in some]
        # rows have as many features as their texts are long: scale them to like norms for the fit
        w = hinge([rows[i] for i in some], [v / max(1e-9, np.linalg.norm(v)) for v in scaled], truth[some], size, cost)
        return ratio * (BLEND * w + (1 - BLEND) * np.abs(w).mean())

    order = np.random.default_rng(5).permutation(len(rows))
    parts = np.array_split(order, 4)
    margins = np.zeros(len(rows))
    for k, part in enumerate(parts):
        w = fitted(np.concatenate([p for j, p in enumerate(parts) if j != k]))
        margins[part] = [w[rows[i]].sum() for i in part]
    slope, offset = logistic(margins / (scale := max(1e-9, np.abs(margins).std())), truth)
    return Model((fitted(order) / scale).astype(np.float32), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Model:
    """Train on at most `limit` labelled rows; what comes to the driver are their features."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("found", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found, at = features(block.column("text"))
                yield pa.RecordBatch.from_arrays([block.column("label").cast(pa.int32()), pa.array([found[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema.names)

    got = sorted(tuple(r) for r in mapped(sample(docs, labels, label, limit), run, schema).collect())
    return train([np.frombuffer(f, "<i4").astype(np.int64) for _, f in got], np.array([float(y > 0) for y, _ in got]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with score, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(shared.value.scores(pc.fill_null(block.column("text"), "")))], schema.names)

    return mapped(docs.select(*keep, "text"), run, schema)
