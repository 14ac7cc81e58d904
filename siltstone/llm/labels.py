"""Bounded samples of labelled rows, and pieces that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, label) of at most `limit` labelled ids, the first by a hash of their id; an id is one row.

    Ids are chosen without reading texts; the chosen ones, whose number is
    bounded by `limit`, are broadcast to the scan of the documents.  Of several rows
    of an id the least label counts, and of its texts (with that label, where the
    documents hold the labels themselves) the one with the least hash.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    if labels is docs:
        found = docs.select("doc_id", "text", F.col(label).alias("label")).join(F.broadcast(chosen), ["doc_id", "label"])
    else:
        found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    return one.select("x.text", "label")


def logistic_weights(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights that turn rows of evidence into log-odds (Newton steps, with smoothed targets)."""
    pos, neg = truth.sum(), len(truth) - truth.sum()
    target = np.where(truth > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        slope = x.T @ (p - target) + 1e-2 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
    return w


def logistic(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds."""
    slope, offset = logistic_weights(np.stack([margins, np.ones(len(margins))], 1), truth)
    return float(max(slope, 1e-3)), float(offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hinge(rows: list[np.ndarray], values: list[np.ndarray], truth: np.ndarray, size: int, cost: np.ndarray, epochs: int = 15, seed: int = 1) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent; each row is given by its features and their values."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    sign = np.where(truth > 0, 1.0, -1.0)
    norms = np.array([float(v @ v) for v in values]) + 1e-12
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * values[i]
                alpha[i] = new
    return w
