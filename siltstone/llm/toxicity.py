"""Toxicity by a subsequence string kernel: support vectors over Nyström landmarks.

A text is a bag of sentences, a sentence one of units: words reduced to their
letters (digits and "@" read as the letters they stand for, signs inside a word
dropped, runs of single letters joined).  The kernel of two units counts common
subsequences of three letters, word ends included, each weighted by DECAY to
the power of the stretch it spans, so letters put in between only weaken a
match.  Units are mapped to features by Nyström landmarks and a linear
hinge-loss model is fitted by dual coordinate descent.  Which unit makes a
labelled sentence toxic is learnt by turns: the model picks the best unit of
each toxic text, and the highest-scored units of clean ones become examples.

The decision function is linear in the subsequences' weights, so it collapses
into one table over letter triples; scoring a whole text is fifteen look-ups a
letter (one for each pair of distances).  A text is scored by its best unit and by how much of it lies over the margin.

Nulls, empty texts and texts without letters score as no unit at all.  Equal texts have equal scores, and
repeated rows have a row each; a text of any length is scored whole, in blocks.  An empty table gives an empty one.
Only the id, the text and (for training) the label are read, so other columns may have any name.  With
fewer than two labelled texts of either class, or no unit that is clearly commoner among toxic ones, the
model is a constant: the rate of toxic rows.

Training is bounded by SAMPLE labelled rows; of copies of a text, which say nothing new of its words, one is used.  From these
rows it takes as negatives the 1,500 commonest clean units and as many others, then up to five of each clean
text's units that score highest, 8,000 at most; units of over 40 letters aren't taken for toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.arrays import blocks, buffers
from siltstone.llm.labels import hinge, logistic_weights, sample, sigmoid
from siltstone.llm.storage import mapped

DECAY, LETTERS = 0.6, 40
#: Letters that a subsequence spans at most; wider ones would weigh less than DECAY ** SPAN each and are left out.
SPAN = 7
#: Distances of a triple's second and third letter.
GAPS = tuple((a, b) for total in range(2, SPAN) for a in range(1, total) for b in (total - a,))
LANDMARKS, TURNS = 64, 3
#: Labelled rows for training, at most.
SAMPLE = 5_000

_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[0x80:0xC0] = 27 + np.arange(64) % 13  # other letters by the bytes after their first
for _sign, _letter in zip("013457@", "oieasta", strict=True):
    _CODE[ord(_sign)] = ord(_letter) - 96
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def unit_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with a 0 before and after each unit, where units begin, the text of each unit)."""
    data, offsets = buffers(pc.utf8_lower(column))
    breaks = _SPACE[data]
    word = np.cumsum(breaks)
    places = np.flatnonzero(_CODE[data])
    if not len(places):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, places, "right") - 1
    fresh = np.ones(len(places), bool)
    fresh[1:] = (word[places[1:]] != word[places[:-1]]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(places)))
    # a single letter after a single letter continues its unit
    spelt = np.zeros(len(starts), bool)
    spelt[1:] = (lengths[1:] == 1) & (lengths[:-1] == 1) & (text[starts[1:]] == text[starts[:-1]])
    fresh[starts[spelt]] = False
    starts = np.flatnonzero(fresh)
    at = np.arange(len(places)) + np.cumsum(fresh)
    out = np.zeros(len(places) + len(starts) + 1, np.uint8)
    out[at] = _CODE[data[places]]
    return out, at[starts], text[starts]


def _norms(longest: int) -> np.ndarray:
    """The kernel's own value of a unit of each length (its ends counted), were all its subsequences different."""
    n = np.arange(longest + 1)
    total = sum(np.maximum(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in GAPS)
    return np.sqrt(np.maximum(total, DECAY**6))


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first place, triple, weight) of the triples that lie inside one unit, its ends included."""
    ends = np.cumsum(codes == 0)
    wide = codes.astype(np.int32)
    for a, b in GAPS:
        n = len(codes) - a - b
        if n <= 0:
            continue
        triple = (wide[:n] * LETTERS + wide[a : a + n]) * LETTERS + wide[a + b : a + b + n]
        inside = ends[a + b - 1 : a + b - 1 + n] == ends[:n]  # no end strictly between
        yield np.flatnonzero(inside), triple[inside], DECAY ** (a + b + 1)


@lru_cache(20_000)
def profile(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The unit's subsequences and their weights, scaled by its length's norm."""
    codes, _, _ = unit_codes(pa.array([unit], pa.large_string()))
    found = list(_triples(codes))
    keys, where = np.unique(np.concatenate([t for _, t, _ in found] or [np.zeros(0, np.int32)]), return_inverse=True)
    weights = np.bincount(where, np.concatenate([np.full(len(t), w) for _, t, w in found] or [np.zeros(0)]), len(keys))
    return keys, weights / _norms(len(codes))[len(codes)]


@dataclass
class Model:
    table: np.ndarray
    bias: float
    weights: np.ndarray  # of the evidence below

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(decision value of each unit, its text)."""
        codes, starts, text = unit_codes(column)
        if not len(starts):
            return np.zeros(0), text
        sums = np.zeros(len(codes), np.float32)
        for places, triples, weight in _triples(codes):
            sums[places] += self.table[triples] * np.float32(weight)
        lengths = np.diff(np.append(starts, len(codes))) + 1
        totals = np.add.reduceat(sums, starts - 1, dtype=np.float64)
        return totals / _norms(int(lengths.max()))[lengths] + self.bias, text

    def evidence(self, values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Of each text: its best unit, how much of it lies over the margin, and 1."""
        best = np.full(n, -3.0)
        np.maximum.at(best, text, values)
        over = np.bincount(text, np.clip(values, 0, 2), n)
        units = np.maximum(1, np.bincount(text, minlength=n))
        return np.stack([np.clip(best, -3, 4), np.log(1 + 1000 * over / units), np.minimum(over, 4), np.ones(n)], 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.evidence(*self.units(column), len(column)) @ self.weights)


def variants(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with letters put in, as a writer would who hides it."""
    out = []
    for _ in range(4):
        k = int(rng.integers(1, len(unit)))
        out.append(unit[:k] + chr(97 + int(rng.integers(26))) + unit[k:])
    return out


def distinct_bags(bags: list[list[str]]) -> list[int]:
    """One of each group of bags that are copies: those that agree in two least hashes of their rarer units."""
    spread = Counter(u for b in bags for u in b)
    seen: set[tuple] = set()
    out = []
    for i, b in enumerate(bags):
        rare = [u.encode() for u in b if spread[u] <= max(30, len(bags) // 50) and len(u) > 2]
        keys = set()
        for k in range(6 if len(rare) >= 8 else 0):
            least = sorted((crc32(u, k * 7919), u) for u in rare)[:2]
            keys.add((k, *(u for _, u in least)))
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def train(bags: list[list[str]], truth: np.ndarray, seed: int = 11) -> Model:
    """bags: the distinct units of each labelled text."""
    # a copied text says nothing new about its words
    once = distinct_bags(bags)
    bags, truth = [bags[i] for i in once], truth[once]
    rng = np.random.default_rng(seed)
    # a third of the texts calibrates
    aside = rng.random(len(bags)) < 1 / 3
    all_bags, all_truth = bags, truth
    bags, truth = [b for b, a in zip(bags, aside, strict=True) if not a], truth[~aside]
    toxic = [b for b, t in zip(bags, truth, strict=True) if t and b]
    clean = [b for b, t in zip(bags, truth, strict=True) if not t and b]
    rate = (truth.sum() + 1) / (len(truth) + 2)
    constant = Model(np.zeros(LETTERS**3, np.float32), 0.0, np.array([0, 0, 0, np.log(rate / (1 - rate))]))
    if len(toxic) < 2 or len(clean) < 2:
        return constant
    bad, good = Counter(u for b in toxic for u in b), Counter(u for b in clean for u in b)

    def typical(u: str) -> float:
        """Evidence, in log-likelihood, that a unit is commoner among toxic texts."""
        p, q = bad[u], good[u]
        all_p, all_q = len(toxic), len(clean)
        if p * all_q <= q * all_p:
            return 0.0
        terms = [(p, all_p), (q, all_q)]
        ll = lambda k, n, r: k * np.log(r) + (n - k) * np.log(1 - r) if 0 < r < 1 else 0.0
        whole = (p + q) / (all_p + all_q)
        return 2 * sum(ll(k, n, k / n) - ll(k, n, whole) for k, n in terms)

    weight = {u: typical(u) for u in bad if 3 <= len(u) <= 40}
    strong = 18.0
    picked = Counter(u for b in toxic if (u := max(b, key=lambda x: (weight.get(x, 0.0), x))) and weight.get(u, 0.0) >= strong)
    if not picked:
        return constant
    common = sorted(good, key=lambda u: (-good[u], u))
    others = [u for u in common[:1500] if u not in picked] + [common[i] for i in rng.permutation(len(common))[:1500] if common[i] not in picked]
    landmarks = [u for u, _ in picked.most_common(LANDMARKS // 2)]
    landmarks += others[: LANDMARKS // 4] + others[-(LANDMARKS - len(landmarks) - LANDMARKS // 4) :]
    phi = np.zeros((len(landmarks), LETTERS**3), np.float32)
    for i, u in enumerate(landmarks):
        keys, w = profile(u)
        phi[i, keys] = w
    values, vectors = np.linalg.eigh(phi @ phi.T + 1e-4 * np.eye(len(landmarks)))
    root = vectors / np.sqrt(values) @ vectors.T

    def nystrom(units: list[str]) -> np.ndarray:
        k = np.stack([phi[:, keys] @ w for keys, w in map(profile, units)])
        return np.hstack([k @ root, np.ones((len(units), 1))])

    negatives = list(dict.fromkeys(others))
    model = constant
    sizes = [len(b) for b in bags]
    flat = [u for b in bags for u in b]

    def decided(units: list[str]) -> np.ndarray:
        return model.units(pa.array(units, pa.large_string()))[0]

    for _ in range(TURNS):
        positives = [v for u in picked for v in (u, *variants(u, rng))]
        x = nystrom(positives + negatives)
        y = np.r_[np.ones(len(positives)), np.zeros(len(negatives))]
        cost = np.where(y > 0, 30.0, 1.0)
        index = np.arange(x.shape[1])
        w = hinge([index] * len(x), list(x), y, x.shape[1], cost, epochs=30)
        model = Model((root @ w[:-1] @ phi).astype(np.float32), float(w[-1]), constant.weights)
        found = decided(flat)
        per_bag = np.split(found, np.cumsum(sizes)[:-1])
        again: Counter = Counter()
        hard: Counter = Counter()
        for b, f, t in zip(bags, per_bag, truth, strict=True):
            if not len(f):
                continue
            best = int(f.argmax())
            if t and f[best] > 0 and weight.get(b[best], 0.0) > 0:
                again[b[best]] += 1
            elif not t:
                hard.update(b[i] for i in np.flatnonzero(f > -0.5)[:5])
        picked = Counter({u: n for u, n in again.items() if weight[u] >= 4}) or picked
        negatives = list(dict.fromkeys(negatives + [u for u in hard if u not in picked]))[-8000:]
    rest = [b for b, a in zip(all_bags, aside, strict=True) if a]
    owner = np.repeat(np.arange(len(rest)), [len(b) for b in rest])
    evidence = model.evidence(decided([u for b in rest for u in b]), owner, len(rest))
    model.weights = logistic_weights(evidence, all_truth[aside])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Train on at most `limit` labelled rows; what comes to the driver are all their distinct units."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("units", T.StringType())])
    letters = np.array([" ", *map(chr, range(97, 123)), *(bytes([0xC3, next(b for b in range(0xA0, 0xB7) if _CODE[b] == k)]).decode() for k in range(27, LETTERS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                rows = []
                for text in block.column("text"):
                    codes, _, _ = unit_codes(pa.array([text.as_py() or ""], pa.large_string()))
                    rows.append(" ".join(sorted(set("".join(letters[codes]).split()))))
                yield pa.RecordBatch.from_arrays([block.column("label").cast(pa.int32()), pa.array(rows, pa.string())], schema.names)

    got = sorted(tuple(r) for r in mapped(sample(docs, labels, label, limit), run, schema).collect())
    return train([u.split() for _, u in got], np.array([float(y > 0) for y, _ in got]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with score, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(shared.value.scores(pc.fill_null(block.column("text"), "")))], schema.names)

    return mapped(docs.select(*keep, "text"), run, schema)
