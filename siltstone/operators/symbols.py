"""Symbols with their extents, bodies and callers: where a definition starts and ends, what stands within it, who calls it."""

from __future__ import annotations

import ast
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.source import SYMBOLS
from siltstone.operators.phrases import contained

_HIDDEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", re.S)
#: Words before a bracket that are no calls (fixed values), and what a call looks like.
NO_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "class", "super", "import", "export")
CALL = r"\b([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?)\s*\("

#: The same for Java: what was read of a name isn't given back, since a shorter one can't be called.
_CALL = r"\b([A-Za-z_$][A-Za-z0-9_$]*+(?:\.[A-Za-z_$][A-Za-z0-9_$]*+)?+)\s*+\("

#: Characters of bodies that one batch holds, about.
SENT = 8 << 20

_FOUND = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("owner", T.StringType())])


def _python(text: str) -> list[tuple]:
    """Classes anywhere with their methods, and functions of the module; a text that doesn't parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    out = [(n.name, "function", n.lineno, n.end_lineno, None) for n in tree.body if isinstance(n, functions)]
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            out.append((c.name, "class", c.lineno, c.end_lineno, None))
            out += [(f"{c.name}.{m.name}", "method", m.lineno, m.end_lineno, c.name) for m in c.body if isinstance(m, functions)]
    return out


def _braced(text: str, heads: list[tuple[int, str, str]]) -> list[tuple]:
    """Symbols of heads (line, name, kind), in order, each as far as the braces that it opens; braces in strings and comments don't count."""
    bare = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")
    heads = [h for h in heads if bare[h[0] - 1].strip()]
    braces = [i for i, line in enumerate(bare) if "{" in line]
    if not braces:
        return [(name, kind, line, line, None) for line, name, kind in heads]
    after = list(accumulate(line.count("{") - line.count("}") for line in bare))
    open_ = list(accumulate(line.count("(") - line.count(")") for line in bare))
    # a head may go on over lines: in brackets, or up to a brace on its own
    on = [bare[k].lstrip().startswith("{") for k in range(1, len(bare))]
    closed, head_end = _first_low(after), _first_low([len(text) + 1 if k < len(on) and on[k] else n for k, n in enumerate(open_)])
    out = []
    for line, name, kind in heads:
        i = line - 1
        brace = bisect_left(braces, i)
        opens = min(braces[brace] if brace < len(braces) else len(bare) - 1, head_end(i, open_[i - 1] if i else 0))
        out.append((name, kind, line, (closed(opens, after[i - 1] if i else 0) if "{" in bare[opens] else i) + 1))
    return _owned(out)


def _first_low(values: list[int]) -> Callable[[int, int], int]:
    """Of a place and a bound the first place from there whose value isn't above the bound, or else the last place; blocks that are above it are passed over."""
    wide = max(1, math.isqrt(len(values)))
    low = [min(values[k : k + wide]) for k in range(0, len(values), wide)]

    def first(k: int, most: int) -> int:
        while k < len(values) and values[k] > most:
            k += wide if k % wide == 0 and low[k // wide] > most else 1
        return min(k, len(values) - 1)

    return first


def _owned(found: list[tuple]) -> list[tuple]:
    """Symbols (name, kind, first, last) in the order of their lines with their owner: of those of another name or kind that start on an earlier line and end no earlier, the latest, the first of a line.

    What may still be around is kept as a stack, the latest on top.
    """
    out, stack = [], []
    for line, group in groupby(found, key=lambda s: s[2]):
        same = list(group)
        while stack and stack[-1][3] < line:
            stack.pop()
        out += [(*s, next((x[0] for x in reversed(stack) if x[3] >= s[3] and x[:2] != s[:2]), None)) for s in same]
        for s in reversed(same):
            if s[3] > line:
                if stack and stack[-1][:2] == s[:2] and stack[-1][3] <= s[3]:
                    stack.pop()  # it owns nothing that the new one doesn't
                stack.append(s)
    return out


def extents(files: DataFrame, bodies: bool = False) -> DataFrame:
    """(path, name, kind, first, last, owner) of files (path, text, language): lines from 1, both ends inclusive; with `body`, the lines, if asked for.

    Python is parsed, JavaScript and Go are followed by their braces; a method's owner is its class, in braces
    the innermost symbol around.  Null texts and other languages have no symbols.
    """
    schema = T.StructType([*_FOUND, *([T.StructField("body", T.StringType())] if bodies else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: dict[int, list[tuple]] = {}
            for n, (language, kind, row, line, name) in enumerate(_found(batch.column("text"), batch.column("language"))):
                if language != "python":
                    for r, at, x in zip(row.tolist(), line.tolist(), name.to_pylist(), strict=True):
                        heads.setdefault(r, []).append((at, n, x, kind))
            out, size = [], 0
            for r, (path, language) in enumerate(zip(batch.column("path").to_pylist(), batch.column("language").to_pylist(), strict=True)):
                if r not in heads and language != "python" or (text := batch.column("text")[r].as_py()) is None:
                    continue
                own = _python(text) if language == "python" else _braced(text, [(at, name, kind) for at, _, name, kind in sorted(heads[r])])
                lines = text.split("\n") if bodies and own else []
                for s in own:
                    out.append((path, *s, *(["\n".join(lines[s[2] - 1 : s[3]])] if bodies else [])))
                    size += 100 + (len(out[-1][-1]) if bodies else 0)
                    if size > SENT:
                        yield _batch(out, schema)
                        out, size = [], 0
            yield _batch(out, schema)

    return files.select("path", "text", "language").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in schema]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], schema.names)


def bodies(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols with `body`: the lines of each."""
    met = symbols.join(files.select("path", F.split("text", "\n").alias("lines")), "path")
    return met.withColumn("body", F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n")).drop("lines")


def named(symbols: DataFrame, keywords: DataFrame) -> DataFrame:
    """The symbols whose name holds a keyword (term), whatever the case; all where there are no keywords."""
    terms = keywords.select(F.lower("term").alias("phrase"))
    if terms.isEmpty():
        return symbols
    names = symbols.select("name").distinct()
    met = contained(names.select("name", F.lower("name").alias("text")), terms).select("name").distinct()
    return symbols.join(met, "name", "left_semi")


def touched(symbols: DataFrame, ranges: DataFrame, block: int = 64) -> DataFrame:
    """(path, name, first, last, lines): symbols that changed ranges (path, start, stop) meet, and how many changed lines they hold.

    Symbols and ranges are joined on the blocks of lines that they cover, so no file's symbols meet all of its ranges.
    """
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block)))
    left = symbols.select("path", "name", "first", "last", cover("first", "last").alias("block"))
    right = ranges.select("path", "start", "stop", cover("start", "stop").alias("block"))
    inside = F.least("last", "stop", (F.col("block") + 1) * block - 1) - F.greatest("first", "start", F.col("block") * block) + 1
    met = left.join(right, ["path", "block"]).withColumn("lines", inside).filter("lines > 0")
    return met.groupBy("path", "name", "first", "last").agg(F.sum("lines").alias("lines"))


def _pieces(texts: pa.Array, sep: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of all texts, the row of each, and where each row's parts start; null texts are as empty ones."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), sep)
    starts = parts.offsets.to_numpy()
    return parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(starts)), starts - starts[0]


def _first(texts: pa.Array, pattern: str, group: str) -> tuple[np.ndarray, pa.Array]:
    """Which texts hold the pattern, and what its group (as it is written) is there."""
    at = np.nonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False))[0]
    return at, pc.struct_field(pc.extract_regex(texts.take(pa.array(at)), pattern.replace(group, f"(?P<name>{group[1:]}", 1)), "name")


def _found(texts: pa.Array, languages: pa.Array) -> Iterator[tuple[str, str, np.ndarray, np.ndarray, pa.Array]]:
    """Language, kind, rows, lines (from 1) and names of what the lines define, for each pattern."""
    for language, patterns in SYMBOLS.items():
        own = np.nonzero(pc.fill_null(pc.equal(languages, language), False).to_numpy(zero_copy_only=False))[0]
        lines, row, starts = _pieces(texts.take(pa.array(own)), "\n")
        for kind, pattern in patterns:
            at, name = _first(lines, pattern, r"(\w+)")
            yield language, kind, own[row[at]], at - starts[row[at]] + 1, name


def line_symbols(files: DataFrame) -> DataFrame:
    """(path, line, name, kind, language) of files (path, text, language): a line gives one symbol for each of the language's patterns that it holds; one pass over the texts."""
    schema = "path string, line int, name string, kind string, language string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, kind, row, line, name in _found(batch.column("text"), batch.column("language")):
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(row), np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(row)), pa.array(line.astype(np.int32)), name, same(kind), same(language)], ["path", "line", "name", "kind", "language"])

    return files.select("path", "text", "language").mapInArrow(run, schema)


SYMBOL_LIST = T.StructField("symbols", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())])))


def symbol_lists(texts: pa.Array, language: str) -> pa.Array:
    """SYMBOL_LIST of texts of one language: in the order of lines, of each line in that of the patterns."""
    own: list[list[tuple]] = [[] for _ in range(len(texts))]
    for n, (_, kind, row, line, name) in enumerate(_found(texts, pa.array([language] * len(texts), pa.string()))):
        for r, at, x in zip(row.tolist(), line.tolist(), name.to_pylist(), strict=True):
            own[r].append((at, n, x, kind))
    return pa.array([[{"name": x, "kind": kind} for _, _, x, kind in sorted(o)] for o in own], pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())])))


def names(files: DataFrame) -> DataFrame:
    """(path, name, defined, called) of files (path, text, language): what a row's lines define and what it calls (the last part of a name), each name once; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rows, found = [], []
            for _, _, row, _, name in _found(texts, batch.column("language")):
                rows.append(row)
                found.append(name)
            defined = sum(map(len, rows))
            # a call is a name at the end of what stands before a bracket
            parts, row, starts = _pieces(texts, "(")
            before = np.ones(len(parts), bool)
            before[starts[1:] - 1] = False
            parts, row = parts.filter(pa.array(before)), row[before]
            at, name = _first(parts, CALL.removesuffix(r"\(") + "$", r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?)")
            real = pc.invert(pc.is_in(pc.replace_substring_regex(name, r"\..*", ""), pa.array(NO_CALLS)))
            rows.append(row[at][real.to_numpy(zero_copy_only=False)])
            found.append(pc.replace_substring_regex(name.filter(real), r".*\.", ""))
            row = pa.array(np.concatenate(rows))
            flag = np.arange(len(row)) < defined
            each = pa.table({"row": row, "name": pa.concat_arrays(found), "defined": pa.array(flag), "called": pa.array(~flag)}).group_by(["row", "name"]).aggregate([("defined", "max"), ("called", "max")])
            out = pa.table({"path": batch.column("path").take(each["row"].combine_chunks()), "name": each["name"], "defined": each["defined_max"], "called": each["called_max"]})
            yield from out.to_batches()

    return files.select("path", "text", "language").mapInArrow(run, "path string, name string, defined boolean, called boolean")


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def calls(files: DataFrame) -> DataFrame:
    """(path, base): the last part of each name that a file calls, each once."""
    found = F.regexp_extract_all("text", F.lit(_CALL), 1)
    return files.select("path", F.explode(found).alias("name")).filter(~F.element_at(F.split("name", r"\."), 1).isin(*NO_CALLS)).select("path", base_name(F.col("name")).alias("base")).distinct()


def callers(scored: DataFrame, selected: DataFrame, symbols: DataFrame, called: DataFrame, boost: float = 90.0) -> DataFrame:
    """scored (task_id, path, score, reasons) with points for files that call symbols (path, name) of a task's selected files (task_id, path).

    One symbol gives `boost`, more give twice that; the first by name is the reason.  Selected files themselves gain nothing.
    """
    wanted = selected.select("task_id", "path").join(symbols.select("path", base_name(F.col("name")).alias("base")), "path").select("task_id", "base").distinct()
    others = scored.select("task_id", "path").join(selected.select("task_id", "path"), ["task_id", "path"], "left_anti")
    met = others.join(called, "path").join(wanted, ["task_id", "base"])
    gains = met.groupBy("task_id", "path").agg(F.count("*").alias("n"), F.min("base").alias("first"))
    both = scored.join(gains, ["task_id", "path"], "left")
    amount = F.least(F.coalesce("n", F.lit(0)) * boost, F.lit(2 * boost))
    reason = F.when(F.col("n").isNotNull(), F.array(F.concat(F.lit("caller of "), "first"))).otherwise(F.array().cast("array<string>"))
    return both.select("task_id", "path", (F.col("score") + amount).alias("score"), F.concat("reasons", reason).alias("reasons"))
