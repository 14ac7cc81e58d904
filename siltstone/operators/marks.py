"""Which of a table of patterns each text holds: one pass over the texts for all of them, by Arrow's kernels within Spark's tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Cases = tuple[tuple[str, str], ...]


def _holds(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _lists(held: np.ndarray, names: list[str]) -> pa.Array:
    """A row of flags as the list of their names."""
    offsets = np.concatenate([[0], held.sum(axis=1).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names, pa.string()).take(pa.array(np.nonzero(held)[1])))


def labels(texts: pa.Array, cases: Cases) -> pa.Array:
    """Of each text the labels whose pattern it holds, in order; of a null text none."""
    return _lists(np.column_stack([_holds(texts, p) for _, p in cases]), [label for label, _ in cases])


def names(texts: pa.Array, patterns: tuple[str, ...]) -> pa.Array:
    """Of each text the distinct first groups of the patterns, pattern by pattern; only texts that hold a pattern are taken apart."""
    out: list[dict[str, None]] = [{} for _ in range(len(texts))]
    for p in patterns:
        known = re.compile(p.replace(r"\s", r"[ \t\n\f\r]"), re.ASCII)
        for i in np.nonzero(_holds(texts, p))[0]:
            out[i].update(dict.fromkeys(known.findall(texts[i].as_py())))
    return pa.array([list(x) for x in out], pa.list_(pa.string()))


def tokens(texts: pa.Array, words: tuple[str, ...]) -> pa.Array:
    """Of each text those of words (lower-case letters) that are among its ordered_tokens: looked for in the text as it is, in each of the ways in which no change of case splits them."""
    held = np.zeros((len(texts), len(words)), bool)
    for n, w in enumerate(words):
        mixed = "|".join(w[:k].upper() + w[k:] for k in range(1, len(w)))
        ways = [rf"(?:^|[^A-Za-z0-9]){w}(?:[^a-z0-9]|$)", rf"(?:^|[^A-Z]){w.upper()}(?:[^A-Za-z0-9]|$)", *([rf"(?:^|[^A-Z])(?:{mixed})(?:[^a-z0-9]|$)"] if mixed else [])]
        near = np.nonzero(_holds(texts, f"(?i){w}"))[0]  # few texts hold a word at all
        if len(near):
            held[near, n] = _holds(texts.take(pa.array(near)), "|".join(ways))
    out = _lists(held, list(words))
    # the two characters outside of ASCII whose lower case is a letter of it
    odd = np.nonzero(_holds(texts, "[\u212a\u0130]"))[0]
    if len(odd):
        lists = out.to_pylist()
        for i in odd:
            own = set(re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", texts[i].as_py()).lower()))
            lists[i] = [w for w in words if w in own]
        out = pa.array(lists, pa.list_(pa.string()))
    return out


def marked(rows: DataFrame, cases: dict[str, tuple[str, Cases]], drop: tuple[str, ...] = (), found: dict[str, tuple[str, tuple[str, ...]]] | None = None, held: dict[str, tuple[str, tuple[str, ...]]] | None = None, more: tuple[T.StructField, Callable[[pa.RecordBatch], pa.Array]] | None = None) -> DataFrame:
    """rows without the columns of `drop`, with an array of labels for each of cases: its name -> (column of text, labels with their patterns).

    found: likewise, but with patterns of one group each, whose distinct values make the array; held: likewise, but with words, of which those that are tokens make it; more: a last column, and what makes it of a batch.  Patterns are RE2's, as in the SQL.
    """
    found, held = found or {}, held or {}
    keep = [f for f in rows.schema.fields if f.name not in drop]
    schema = T.StructType([*keep, *[T.StructField(name, T.ArrayType(T.StringType())) for name in (*cases, *found, *held)], *([more[0]] if more else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *[labels(batch.column(column), own) for column, own in cases.values()], *[names(batch.column(column), own) for column, own in found.values()], *[tokens(batch.column(column), own) for column, own in held.values()], *([more[1](batch)] if more else [])], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
