"""Ranking documents for many tasks at once, each under a running token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import ordered_tokens, rarity

_CAMEL = re.compile(rb"([a-z0-9])([A-Z])")
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Cells of the block of documents times tasks, and rows kept until the next pruning.
_CELLS, _ROWS = 1_000_000, 200_000
#: Tasks of a block and bytes of their texts; and how many times more partitions are ranked from one level to the next.
_TASKS, _BYTES, _FACTOR = 2_000, 16 << 20, 8


def _terms(text: str) -> set[bytes]:
    """What ordered_tokens gives, as a set; two letters have lower case in ASCII without being ASCII."""
    raw = _CAMEL.sub(rb"\1 \2", text.encode())
    if "K" in text or "İ" in text:
        raw = raw.replace("K".encode(), b"k").replace("İ".encode(), b"i ")
    return set(raw.translate(_SPLIT).split())


def _counted(docs: DataFrame, known: set[bytes]) -> DataFrame:
    """(term, df) of the known terms; a partition adds them up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column("text"):
                for t in _terms(text.as_py()) & known:
                    counts[t] = counts.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

    return docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _within(rows: pa.Table, budget: int) -> pa.Table:
    """Rows (k, score, doc_id, tokens) that start within their task's budget, in order."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("k", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
    k, tokens = rows.column("k").to_numpy(), rows.column("tokens").to_numpy()
    before = np.cumsum(tokens) - tokens
    first = np.searchsorted(k, k)
    return rows.filter(pa.array(before - before[first] <= budget))


def _kept(rows: pa.Table, bounds: tuple[np.ndarray, pa.Array] | None) -> pa.Table:
    """Rows that come no later than the bound of their task: a score, and an id among equal scores."""
    if bounds is None or not rows.num_rows:
        return rows
    k = rows.column("k")
    score = pa.array(bounds[0]).take(k.combine_chunks())
    first = pc.less_equal(rows.column("doc_id"), bounds[1].take(k.combine_chunks()))
    return rows.filter(pc.or_(pc.greater(rows.column("score"), score), pc.fill_null(first, True)))


def _near(docs: DataFrame, shared: Broadcast, budget: int, bounds: Broadcast | None = None, step: int = 1) -> DataFrame:
    """(k, score, doc_id, tokens) of what starts within a task's budget in a partition of documents; with a step, in every step-th partition."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("score", T.LongType()), docs.schema["doc_id"], T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % step:
            return
        code, starts, task, gain, within, need, literals = shared.value
        size = len(need)
        limits = None if bounds is None else bounds.value
        least = np.ones(size, np.int64) if limits is None else np.maximum(1, limits[0])
        vocabulary, held, waiting = set(code), [], 0

        def prune() -> None:
            nonlocal held, waiting
            rows = _within(_kept(pa.concat_tables(held), limits), budget)
            held, waiting = [rows], 0
            k, score, tokens = (rows.column(c).to_numpy() for c in ("k", "score", "tokens"))
            full = np.bincount(k, tokens, size) > budget
            low = np.full(size, np.iinfo(np.int64).max)
            np.minimum.at(low, k, score)
            least[full] = low[full]

        for batch in batches:
            most = min(64, max(1, _CELLS // max(1, size)))
            for at in range(0, batch.num_rows if size else 0, most):
                block = batch.slice(at, most)
                texts = block.column("text").to_pylist()
                found = [[code[t] for t in _terms(x) & vocabulary] for x in texts]
                codes = np.array([c for f in found for c in f], np.int64)
                lengths = starts[codes + 1] - starts[codes]
                doc = np.repeat(np.repeat(np.arange(len(texts)), [len(f) for f in found]), lengths)
                pick = np.repeat(starts[codes] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                cell = doc * size + task[pick]
                cells = len(texts) * size
                held_terms = np.bincount(cell, minlength=cells).reshape(-1, size)
                score = np.minimum(60_000, 10 * np.bincount(cell, gain[pick], cells).astype(np.int64)).reshape(-1, size)
                whole = np.bincount(cell, within[pick], cells).reshape(-1, size) >= need
                for d, i in zip(*np.nonzero(whole & (held_terms > 0)), strict=True):
                    if literals[i] in texts[d]:
                        score[d, i] += 360_000
                d, k = np.nonzero((score >= least) & (held_terms > 0))
                tokens = np.array([max(1, len(x) // 4) for x in texts], np.int64)
                held.append(pa.table([pa.array(k), pa.array(score[d, k]), block.column("doc_id").take(pa.array(d)), pa.array(tokens[d])], schema.names))
                waiting += len(d)
                if waiting > _ROWS:
                    prune()
        if held:
            prune()
            yield from held[0].combine_chunks().to_batches()
        held.clear()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _chosen(near: DataFrame, budget: int) -> DataFrame:
    """near with rank and running sum, where a row starts within its task's budget."""
    w = Window.partitionBy("k").orderBy(F.desc("score"), "doc_id")
    ranked = near.select("k", "doc_id", "score", "tokens", F.row_number().over(w).cast("long").alias("rank"), F.sum("tokens").over(w).alias("running"))
    return ranked.filter(F.col("running") - F.col("tokens") <= budget)


def _bounds(docs: DataFrame, shared: Broadcast, budget: int, size: int, step: int, known: Broadcast | None) -> tuple[np.ndarray, pa.Array]:
    """For each task the last row that its budget reaches in every step-th partition, by bounds that are known.

    Whatever comes after it in the order of scores comes after a full budget in the whole table as well.  A task whose
    budget these partitions don't fill has no bound.  Partitions of a wider step are among these, so known bounds get no weaker.
    """
    chosen = _chosen(_near(docs, shared, budget, known, step), budget)
    last = chosen.filter(F.col("running") > budget).groupBy("k").agg(F.min_by(F.struct("score", "doc_id"), "running").alias("r"))
    found = last.select("k", "r.score", "r.doc_id").toArrow()
    score = np.zeros(size, np.int64)
    score[found.column("k").to_numpy()] = found.column("score").to_numpy()
    place = np.full(size, -1, np.int64)
    place[found.column("k").to_numpy()] = np.arange(found.num_rows)
    ids = found.column("doc_id").combine_chunks()
    return score, ids.take(pa.array(place, mask=place < 0))


def _ranked_block(docs: DataFrame, wanted: list[Row], item_id: T.StructField, budget: int) -> DataFrame:
    spark = docs.sparkSession
    own = [sorted({t.encode() for t in r.tokens if len(t) >= 3}) for r in wanted]
    known = {t for terms in own for t in terms}
    n = docs.agg(F.count("*").alias("n"))
    points = F.round(rarity(F.col("df"), F.col("n")) * 1000, 0).cast("long")
    weight = {r.term.encode(): r.points for r in _counted(docs, known).join(F.broadcast(n)).select("term", points.alias("points")).collect()}
    code = {t: i for i, t in enumerate(sorted(weight))}
    # a text that holds a task's text has its inner terms as they are; the first and the last may be cut
    inner = [{t.encode() for t in r.tokens[1:-1] if len(t) >= 3} for r in wanted]
    pairs = sorted((code[t], i, weight[t], t in inner[i]) for i, terms in enumerate(own) for t in terms if t in code)
    of, task, gain, within = (np.array([p[j] for p in pairs], np.int64) for j in range(4))
    starts = np.searchsorted(of, np.arange(len(code) + 1))
    shared = spark.sparkContext.broadcast((code, starts, task, gain, within, np.array([len(x) for x in inner], np.int64), [r.text for r in wanted]))
    bounds, step, partitions = None, _FACTOR, docs.rdd.getNumPartitions()
    while step * _FACTOR < partitions:
        step *= _FACTOR
    while wanted and 1 < step < partitions:
        bounds = spark.sparkContext.broadcast(_bounds(docs, shared, budget, len(wanted), step, bounds))
        step //= _FACTOR
    chosen = _chosen(_near(docs, shared, budget, bounds), budget)
    ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(wanted)], T.StructType([T.StructField("k", T.LongType()), item_id]))
    return chosen.join(F.broadcast(ids), "k").select("item_id", "doc_id", (F.col("score") / 1000.0).alias("score"), "rank", "tokens", "running")


def rank_for_tasks(docs: DataFrame, tasks: DataFrame, budget: int = 50_000, top: int | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank, tokens, running, selected): the best documents for each task (item_id, text).

    Score: rarity of the task's terms that a document holds, up to 60 points, and 360 for holding the
    task's text whole.  A task's documents are those that start within its budget: all that fit, and the
    first that doesn't; `top` takes the best of these, after the budget.  Tasks are taken in blocks of about
    2,000 tasks or 16 MB, of which one at a time is on the driver.  A partition of documents passes on what
    starts within the budget by its own running sums: these are never above the whole ones, so nothing is
    lost.  Of many partitions a few are ranked first, then eight times as many and so on: the row at which they
    fill a task's budget bounds that task in all others, so each level passes on about eight times the result, whatever
    the number of partitions, and all levels before the last read a seventh of the table.
    Rows without id or text are left out.
    """
    docs = docs.select("doc_id", "text").dropna()
    asked = tasks.select("item_id", "text").dropna()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // _TASKS), -(-size.bytes // _BYTES))
    asked = asked.select("*", ordered_tokens(F.col("text")).alias("tokens"))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [_ranked_block(docs, asked.filter(block == i).collect(), tasks.schema["item_id"], budget) for i in range(blocks)]
    out = reduce(DataFrame.unionByName, parts)
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.withColumn("selected", F.col("running") <= budget)
