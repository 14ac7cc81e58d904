"""Language identification by averaged hashed subword embeddings.

Every pair and triple of bytes around the letters of a lower-cased text, word
ends included, has an embedding in a hashed table; their average goes through a
linear softmax.  Table and softmax are trained by stochastic gradient descent
in numpy.  A temperature fitted on rows set aside makes the score a
probability, and texts below a score that hardly any of those rows fall below
are rejected.  As all is linear up to the softmax, a text's logits are the mean
of one small vector per subword: whole texts cost a few look-ups a byte.

Texts that are null, empty or without letters are `und` with score 0 and are rejected.  Equal texts have equal predictions, repeated
rows a row each.  An empty table gives an empty one.  Only id, text and (for training) the language are read, whatever other
columns are called; ties between languages go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import blocks, buffers
from siltstone.llm.labels import fold, sample
from siltstone.llm.storage import mapped

BUCKETS, WIDTH, EPOCHS = 4096, 16, 15
#: Labelled rows for training, at most.
SAMPLE = 2_000
#: Share of the rows set aside that may be rejected, and the score above which nothing is.
REJECTED, SURE = 0.001, 0.5
UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:256] = np.arange(128, 256)


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: the buckets of the pair and triple in whose middle it is, and whether it is part of a letter."""
    code = _LETTER[data]
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    pair = ((before << np.uint32(8)) | code) * np.uint32(0x9E3779B1)
    triple = (((before << np.uint32(16)) | (code << np.uint32(8)) | after) + np.uint32(0x1000001)) * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return pair >> shift, (triple ^ (triple << np.uint32(13))) >> shift, code > 0


def histograms(column: pa.Array) -> np.ndarray:
    """Share of each bucket among a text's subwords; a row of zeros for a text without letters."""
    data, offsets = buffers(pc.utf8_lower(column))
    pair, triple, there = subwords(data)
    out = np.zeros((len(column), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        on = there[a:b]
        n = np.bincount(pair[a:b][on], minlength=BUCKETS) + np.bincount(triple[a:b][on], minlength=BUCKETS)
        out[i] = n / max(1, n.sum())
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> logits
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the likeliest language, its calibrated probability) of each text."""
        data, offsets = buffers(pc.utf8_lower(column))
        logits = np.zeros((len(column), len(self.langs)))
        if len(data):
            pair, triple, there = subwords(data)
            places = np.flatnonzero(there)
            at = np.searchsorted(places, offsets)
            pair, triple = pair[places], triple[places]
            n = 2 * np.diff(at)
            some = np.flatnonzero(n)
            for k in range(len(self.langs) if len(some) else 0):
                one = np.ascontiguousarray(self.table[:, k])
                logits[some, k] = np.add.reduceat(one[pair] + one[triple], at[some], dtype=np.float64) / n[some]
        z = (logits + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def train(texts: list[str], langs: list[str], buckets: np.ndarray | None = None, seed: int = 3) -> Model:
    x = histograms(pa.array(texts, pa.large_string())) if buckets is None else buckets
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, rest = order[: len(y) // 5], order[len(y) // 5 :]
    table, soft, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    soft += rng.normal(0, 0.1, soft.shape)
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for start in range(0, len(rest), 32):
            rows = rest[start : start + 32]
            mean = x[rows] @ table
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = x[rows].T @ (p @ soft.T)
            soft -= rate * (mean.T @ p)
            bias -= 0.1 * rate * p.sum(0)
            table -= 40 * rate * back
    z = x[held] @ table @ soft + bias
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.02, 20, 60):
        s = z / t
        loss = -(s[np.arange(len(held)), y[held]] - s.max(1) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))).mean() if len(held) else 0.0
        if loss < best:
            best, temperature = loss, float(t)
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    top = (p / p.sum(1, keepdims=True)).max(1) if len(held) else np.ones(1)
    least = min(SURE, float(np.quantile(top, REJECTED)))
    return Model(names, (table @ soft).astype(np.float32), bias.astype(np.float64), temperature, least)


def fit(docs: DataFrame, limit: int = SAMPLE) -> Model | None:
    """Train on at most `limit` rows with a text and a lang outside the held-out fold; None without such rows."""
    rows = docs.filter((fold("doc_id", 4) != 2) & F.col("text").isNotNull())
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = histograms(block.column("text"))
                where = [np.flatnonzero(f) for f in found]
                yield pa.RecordBatch.from_arrays([block.column("label").cast(pa.string()), pa.array([w.astype("<i4").tobytes() for w in where]), pa.array([f[w].tobytes() for f, w in zip(found, where, strict=True)])], schema.names)

    got = mapped(sample(rows, rows, "lang", limit), run, schema).collect()
    got = [r for r in got if len(r.at)]
    if not got:
        return None
    got.sort(key=lambda r: (r.label, r.at, r.share))  # tasks end in any order
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, "<i4")] = np.frombuffer(r.share, np.float32)
    return train([], [r.label for r in got], x)


def _predicted(block: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, accepted); texts without a letter are `und` with score 0."""
    there = pc.fill_null(pc.match_substring_regex(block.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None:
        return np.full(len(block), UNKNOWN, object), np.zeros(len(block)), np.zeros(len(block), bool)
    best, score = model.scores(block.column("text"))
    return np.where(there, np.array(model.langs, object)[best], UNKNOWN), np.where(there, score, 0.0), there & (score >= model.least)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with lang_pred, score and accepted, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                lang, score, accepted = _predicted(block, shared.value)
                yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], schema.names)

    return mapped(docs.select(*keep, "text"), run, schema)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is recognised."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield block.filter(pa.array(_predicted(block, shared.value)[2]))

    return mapped(docs, run, docs.schema)
