"""What files hold of the tasks' terms and phrases: found in one pass over the texts, and met with the tasks without a shuffle of their pairs.

Terms and phrases of a block of tasks are broadcast as numbers.  A file has one row of the numbers that its path, text and
summary hold; a second pass over these rows makes the evidence of each task and file that meet, by numpy within Spark's tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import tasks as K

#: Tasks, and characters of them, that are met in one pass at most; pairs of files and tasks that are made at a time.
BLOCK, CHARACTERS, CELLS = 1000, 4 << 20, 1 << 16
IDS, WORDS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
_SPLIT, _CAMEL = re.compile("[^a-z0-9]+"), re.compile("([a-z0-9])([A-Z])")
_GENERIC = frozenset(K.GENERIC_WORDS)
#: What finds the values of a field in a text, by the field.
Finders = dict[str, Callable[[str], list[str]]]


def blocks(tasks: DataFrame) -> list[DataFrame]:
    """The tasks in blocks that a hash deals out; about half full, so that uneven ones stay within the bound."""
    size = tasks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("task")), F.lit(0)).alias("chars")).first()
    many = max(1, -(-2 * size["n"] // BLOCK), -(-2 * size["chars"] // CHARACTERS)) if size["n"] > BLOCK // 2 or size["chars"] > CHARACTERS // 2 else 1
    return [tasks] if many == 1 else [tasks.filter(F.pmod(F.xxhash64("task_id"), F.lit(many)) == b) for b in range(many)]


def _tokens(text: str) -> list[str]:
    """ordered_tokens of a text."""
    return [t for t in _SPLIT.split(_CAMEL.sub(r"\1 \2", text).lower()) if t]


def _plain(value: str) -> bool:
    """Whether a value is one token as it stands: of small ASCII letters alone."""
    return value.isascii() and value.isalpha() and value.islower()


class _Known:
    """Numbers of the terms and phrases that tokens hold."""

    def __init__(self, terms: list[str], phrases: list[str]):
        self.term, self.phrase = {t: i for i, t in enumerate(terms)}, {p: i for i, p in enumerate(phrases)}

    def terms(self, tokens: list[str]) -> list[int]:
        return [self.term[t] for t in dict.fromkeys(tokens) if len(t) >= 3 and t in self.term]

    def pairs(self, tokens: list[str]) -> set[int]:
        return {self.phrase[p] for a, b in zip(tokens, tokens[1:]) if (p := f"{a} {b}") in self.phrase and not (a in _GENERIC and b in _GENERIC)}


def _values(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int, str]]]:
    """(field, pos, value) of each row."""
    values = batch.column("values")
    flat, at = values.flatten(), 0
    rows = list(zip(*[flat.field(f).to_pylist() for f in ("field", "pos", "value")]))
    for n in pc.fill_null(pc.list_value_length(values), 0).to_pylist():
        yield rows[at : at + n]
        at += n


def _with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pc.is_valid(batch.column("path"))) if batch.column("path").null_count else batch


def held(texts: DataFrame, terms: list[str], phrases: list[str], fields: tuple[str, ...], finders: Finders | None = None) -> DataFrame:
    """One row for each file, of numbers in terms and phrases.

    texts: path, text, path_tokens, api_terms, secret and values, an array of (field, pos, value); finders find more values in the text.  `held` has what rarity is
    counted by: terms, then phrases by their number and len(terms), and -1 where the path has a token.  Values that hold nothing are left out, the others stand by field and pos.
    """
    ids = ("path_terms", "api_ids", "text_terms", "head_phrases", "any_phrases", "held", "v_field")
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("secret", T.BooleanType()), *[T.StructField(c, IDS) for c in ids], T.StructField("v_value", WORDS), T.StructField("v_terms", T.ArrayType(IDS)), T.StructField("v_phrases", T.ArrayType(IDS)),
    ])
    block = texts.sparkSession.sparkContext.broadcast((terms, phrases))
    order, finders = {f: k for k, f in enumerate(fields)}, finders or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        terms, phrases = block.value
        known, automaton = _Known(terms, phrases), ahocorasick.Automaton()
        for p, i in known.phrase.items():
            automaton.add_word(p, i)
        if phrases:
            automaton.make_automaton()
        search = automaton.iter if phrases else lambda text: ()

        @lru_cache(100_000)
        def of(value: str) -> tuple[list[int], list[int], set[int]]:
            tokens = [value] if _plain(value) else _tokens(value)
            return known.terms(tokens), sorted({i for _, i in search(" ".join(tokens))}), known.pairs(tokens)

        for batch in _with_path(batches):
            made: list[tuple] = []
            for path, tokens, api, text, values in zip(batch.column("path").to_pylist(), batch.column("path_tokens").to_pylist(), batch.column("api_terms").to_pylist(), batch.column("text"), _values(batch)):
                text, head = text.as_py() or "", _tokens(path)
                words, first = _tokens(text), " ".join(head)
                early: dict[int, bool] = {}
                for end, i in search(f"{first} {' '.join(words)}"):
                    if i not in early:  # the first occurrence ends first
                        early[i] = end < len(first)
                of_path = {known.term[t] for t in tokens if t in known.term}
                rare, near, kept = {*of_path, *([-1] if tokens else [])}, known.pairs(head), []
                for field, pos, value in (*values, *((f, pos, v) for f, find in finders.items() for pos, v in enumerate(find(text)))):
                    if value is not None:
                        own, found, two = of(value)
                        rare.update(own)
                        near |= two
                        if own or found:
                            kept.append((order.get(field, len(order)), pos, value, own, found))
                kept.sort(key=lambda x: x[:2])
                made.append((path, sorted(i for i in of_path if len(terms[i]) >= 3), known.terms(api or ()), known.terms(words), [i for i, e in early.items() if e], list(early), [*rare, *(i + len(terms) for i in near)], *([x[k] for x in kept] for k in (0, 2, 3, 4))))
            path, *lists = zip(*made) if made else [[]] * 12
            kinds = [pa.list_(pa.int32())] * 7 + [pa.list_(pa.string())] + [pa.list_(pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), batch.column("secret"), *[pa.array(list(x), k) for x, k in zip(lists, kinds)]], schema.names)

    return texts.select("path", "text", "path_tokens", "api_terms", "secret", "values").mapInArrow(run, schema)


def occurring(texts: DataFrame, terms: list[str], phrases: list[str], finders: Finders | None = None) -> DataFrame:
    """(i, n): of how many files the number i is in `held`, added up within each of Spark's tasks, so that no row of a file is handed on; without finders the texts are not looked into."""
    block, finders = texts.sparkSession.sparkContext.broadcast((terms, phrases)), tuple((finders or {}).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, phrases = block.value
        known, counts = _Known(terms, phrases), Counter()

        @lru_cache(200_000)
        def of(value: str) -> tuple[int, ...]:
            tokens = _tokens(value)
            return (*known.terms(tokens), *(i + len(terms) for i in known.pairs(tokens)))

        for batch in _with_path(batches):
            texts = batch.column("text") if finders else [None] * len(batch)
            for path, tokens, text, values in zip(batch.column("path").to_pylist(), batch.column("path_tokens").to_pylist(), texts, _values(batch)):
                text = text.as_py() if finders else None
                rare = {i + len(terms) for i in known.pairs(_tokens(path))}
                rare.update(known.term[t] for t in tokens if t in known.term)
                if tokens:
                    rare.add(-1)
                for value in {v for *_, v in values if v is not None}.union(*(find(text) for find in finders if text)):
                    if not _plain(value):
                        rare.update(of(value))
                    elif len(value) >= 3 and value in known.term:
                        rare.add(known.term[value])
                counts.update(rare)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["i", "n"])

    return texts.select("path", *(["text"] if finders else []), "path_tokens", "values").mapInArrow(run, "i int, n long")


def counted(rare: DataFrame, terms: list[str], phrases: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(term, df), (phrase, df), and the number of files whose path has a token, of (i, n) of files; no more rows than there are terms and phrases come to the driver."""
    spark, n = rare.sparkSession, len(terms)
    found = dict(map(tuple, rare.groupBy("i").agg(F.sum("n")).collect()))
    frame = lambda items, at, name: spark.createDataFrame([(x, found[i + at]) for i, x in enumerate(items) if i + at in found], f"{name} string, df long")
    return frame(terms, 0, "term"), frame(phrases, n, "phrase"), found.get(-1, 0)


class Postings:
    """Of each item (by number) the tasks that have it, with what they say of it."""

    def __init__(self, size: int, item: list[int], task: list[int], **columns: list):
        order = np.argsort(np.array(item, np.int64), kind="stable")
        self.ends = np.concatenate([[0], np.bincount(np.array(item, np.int64), minlength=size).cumsum()]).astype(np.int64)
        self.task = np.array(task, np.int64)[order]
        self.columns = {k: np.array(v, np.float64)[order] for k, v in columns.items()}

    def met(self, column: pa.Array, n_tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of lists of items: row * n_tasks + task, the posting, and the item of each that meets."""
        rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        items = column.flatten().to_numpy().astype(np.int64)
        n = self.ends[items + 1] - self.ends[items]
        at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(self.ends[items], n)
        return np.repeat(rows, n) * n_tasks + self.task[at], at, np.repeat(items, n)


def meetings(rows: DataFrame, n_tasks: int, terms: Postings, phrases: Postings, texts: list[str], fields: tuple[str, ...]) -> DataFrame:
    """One row for each task (`_t`, its number) and file that meet; rows: those of `held` with near_terms and any columns of a file, which stay.

    texts: the phrases.  terms say weight, mills, concrete, vague and other of a task's term, phrases say weight and literal.
    """
    used = {"path_terms", "api_ids", "text_terms", "head_phrases", "any_phrases", "held", "v_field", "v_value", "v_terms", "v_phrases", "near_terms"}
    keep = [f for f in rows.schema.fields if f.name not in used]
    long, double, flag = T.LongType(), T.DoubleType(), T.BooleanType()
    kinds = {"_t": T.IntegerType(), "path_weight": double, "path_concrete": long, "path_vague": flag, "path_other": flag, "content_hits": long, "content_weight": long, "text_concrete": long, "text_vague": flag, "text_other": flag}
    for f in fields:
        kinds |= {f: T.StringType(), f"{f}_weight": double, f"{f}_hits": long}
    kinds |= {"api_hits": long, "named_dependency": flag, "path_phrase": double, "any_phrase": double, "literals": WORDS}
    schema = T.StructType([*keep, *[T.StructField(k, v) for k, v in kinds.items()]])
    block = rows.sparkSession.sparkContext.broadcast((terms, phrases, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, phrases, texts = block.value
        names = pa.array(texts, pa.string())
        step = max(1, CELLS // n_tasks)
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                size = len(batch) * n_tasks
                say = terms.columns

                def count(key: np.ndarray, what: np.ndarray | None = None, n: int = size) -> np.ndarray:
                    return np.bincount(key, what, n)

                def most(key: np.ndarray, what: np.ndarray, n: int = size) -> np.ndarray:
                    out = np.full(n, -1.0)
                    np.maximum.at(out, key, what)
                    return out

                path, p, _ = terms.met(batch.column("path_terms"), n_tasks)
                text, x, _ = terms.met(batch.column("text_terms"), n_tasks)
                near, api = (count(terms.met(batch.column(c), n_tasks)[0]) for c in ("near_terms", "api_ids"))
                early, e, _ = phrases.met(batch.column("head_phrases"), n_tasks)
                anywhere, a, item = phrases.met(batch.column("any_phrases"), n_tasks)
                by_path, by_text, any_phrase = most(path, say["weight"][p]), count(text), most(anywhere, phrases.columns["weight"][a])
                met = (by_path >= 0) | (by_text > 0) | (near > 0) | (any_phrase >= 0)
                # values: the best of each file and field, the first of equals
                v_field = batch.column("v_field").flatten().to_numpy()
                n, file = len(v_field), np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("v_field")).to_numpy())
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                if n:
                    by_term, k, _ = terms.met(batch.column("v_terms").flatten(), n_tasks)
                    by_phrase, j, _ = phrases.met(batch.column("v_phrases").flatten(), n_tasks)
                    weight = most(np.concatenate([by_term, by_phrase]), np.concatenate([say["weight"][k], phrases.columns["weight"][j]]), n * n_tasks).reshape(n, n_tasks)
                    concrete = count(by_term, say["concrete"][k], n * n_tasks).reshape(n, n_tasks)
                    group = np.concatenate([[True], (file[1:] != file[:-1]) | (v_field[1:] != v_field[:-1])])
                    starts = np.nonzero(group)[0]
                    top = np.maximum.reduceat(weight, starts, axis=0)
                    first = np.minimum.reduceat(np.where((weight == top[group.cumsum() - 1]) & (weight >= 0), np.arange(n)[:, None], n), starts, axis=0)
                    for f in range(len(fields) + 1):
                        own = v_field[starts] == f
                        where = np.full((len(batch), n_tasks), n)
                        where[file[starts[own]]] = first[own]
                        met |= where.ravel() < n
                        best[f] = where.ravel()
                keys = np.nonzero(met)[0]
                row, task = keys // n_tasks, keys % n_tasks
                longs = lambda x: pa.array(x[keys].astype(np.int64))
                some = lambda key, what: count(key, what) > 0
                none = lambda x: pa.array(x[keys], mask=x[keys] < 0)
                out = {
                    "_t": pa.array(task.astype(np.int32)), "path_weight": none(by_path), "path_concrete": longs(count(path, say["concrete"][p])), "path_vague": pa.array(some(path, say["vague"][p])[keys]),
                    "path_other": pa.array(some(path, say["other"][p])[keys], mask=by_path[keys] < 0), "content_hits": longs(by_text), "content_weight": longs(count(text, say["mills"][x])),
                    "text_concrete": longs(count(text, say["concrete"][x])), "text_vague": pa.array(some(text, say["vague"][x])[keys]), "text_other": pa.array(some(text, say["other"][x])[keys], mask=by_text[keys] == 0),
                }
                for f, name in enumerate(fields):
                    at = best[f][keys] if n else np.zeros(len(keys), np.int64)
                    gone, safe = at >= n, np.minimum(at, max(n - 1, 0))
                    out[name] = batch.column("v_value").flatten().take(pa.array(at, pa.int64(), mask=gone))
                    for what, kind in (("weight", np.float64), ("hits", np.int64)):
                        out[f"{name}_{what}"] = pa.array((weight if what == "weight" else concrete)[safe, task].astype(kind), mask=gone) if n else pa.nulls(len(keys), pa.float64() if what == "weight" else pa.int64())
                said = phrases.columns["literal"][a] > 0
                order = np.argsort(anywhere[said], kind="stable")
                offsets = np.concatenate([[0], count(anywhere[said])[keys].cumsum()]).astype(np.int32)
                out |= {
                    "api_hits": longs(api), "named_dependency": pa.array(near[keys] > 0), "path_phrase": none(most(early, phrases.columns["weight"][e])), "any_phrase": none(any_phrase),
                    "literals": pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(item[said][order]))),
                }
                files = batch.select([f.name for f in keep]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*files.columns, *[out[k] for k in kinds]], schema.names)

    return rows.mapInArrow(run, schema)
