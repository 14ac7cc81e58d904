"""Hard negatives by exact integer scores, worked out in residues.

Scores are inner products of integer vectors.  In float32 a product of matrices is exact
only below 2^24, so the matrices are multiplied modulo several primes below 1,024 (residues
about zero, the inner dimension cut so that no sum reaches 2^24), and the signed score is put together
from its residues by the Chinese remainder theorem in mixed radix.  As many primes are taken as the
largest possible score of the two blocks needs.

Anchors and rows meet in a grid of cells: a cell holds one block of anchors and one share of the
rows, which pass through a task as a stream after the anchors; a block of anchors is repeated for each
share and a row for each block.  Every anchor meets every row once.  A cell returns its best few
for each anchor; windows over those of all cells select the result.

Two passes: the first finds each anchor's positives (its best rows of the same label), the second, for
each anchor and positive, the best rows of another label whose score is within the window that the
positive's score gives.

Rows with a null id, label or vector, or a null or non-finite component, take no part.  Vectors of
different lengths meet as if the shorter ended in zeros; an empty vector scores 0.  Repeated rows are rows
of their own: each copy of an anchor has results, and its other copies may be its positives.  Ties go to the smaller
id.  Tables without anchors or rows give no rows.  Only the three named columns are read.  Scores of
2^62 and more are refused with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.storage import mapped, stored

SCALE = 256
#: Anchors of a block, about; rows of a share, about; least number of cells.
BLOCK, SHARE, CELLS = 2_048, 1 << 21, 48
#: float32 holds all integers up to this.
_EXACT = 1 << 24
PRIMES = [p for p in range(1_023, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


def integers(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(256 * x) of a list column as a matrix; short rows end in zeros, and `width` cuts or fills all."""
    if not pa.types.is_large_list(column.type):
        column = column.cast(pa.large_list(column.type.value_type))
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(SCALE * flat)
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise ArithmeticError("a component times 256 has 62 bits or more")
    sizes = np.diff(at)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)
    row = np.repeat(np.arange(len(column)), sizes)
    keep = place < width
    out[row[keep], place[keep]] = values[keep].astype(np.int64)
    return out


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(x, p)
    r[r > p // 2] -= p
    return r.astype(np.float32)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    x = np.mod(x, p)
    x[x > p // 2] -= p
    return x


class Residues:
    """A matrix whose residues by each prime are kept."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.most = int(np.abs(rows).max(initial=0))
        self._by: dict[int, np.ndarray] = {}

    def by(self, p: int) -> np.ndarray:
        if p not in self._by:
            self._by[p] = _residues(self.rows, p)
        return self._by[p]


def scores(a: Residues, b: Residues) -> np.ndarray:
    """All inner products of the rows of two matrices of the same width, exactly."""
    width = a.rows.shape[1]
    bound = width * a.most * b.most
    if bound >= 1 << 62:
        raise ArithmeticError("scores may have 62 bits or more")
    total = np.zeros((len(a.rows), len(b.rows)), np.int64)
    product = 1
    for p in PRIMES:
        if product > 2 * bound + 1:
            break
        step = max(1, _EXACT // (p // 2) ** 2)
        left, right = a.by(p), b.by(p)
        part = np.zeros(total.shape, np.int64)
        for k in range(0, width, step):
            part += (left[:, k : k + step] @ right[:, k : k + step].T).astype(np.int64)
        # the next digit: what is left of the residue, over the product of the primes so far
        digit = _centred((part - total) % p * pow(product, -1, p), p) if product > 1 else _centred(part, p)
        with np.errstate(over="ignore"):
            total += digit * np.int64(product if product < 1 << 63 else product - (1 << 64))
        product *= p
    return total


def _best(found: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the k best wanted columns (ids ascend over the columns): (ids, scores, whether there is one)."""
    n = found.shape[1]
    k = min(k, n)
    if int(np.abs(found).max(initial=0)) >= (1 << 61) // max(n, 1):
        ranks = np.unique(found, return_inverse=True)[1].reshape(found.shape)  # as many values as cells at most
    else:
        ranks = found
    key = np.where(wanted, ranks * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
    top = np.argpartition(key, n - k, axis=1)[:, n - k :]
    row = np.arange(len(found))[:, None]
    return ids[top], found[row, top], wanted[row, top]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, found, there = (np.concatenate([p[i] for p in parts], axis=1) for i in range(3))
    order = np.lexsort((ids, -found, ~there), axis=-1)[:, :k]
    row = np.arange(len(ids))[:, None]
    return ids[row, order], found[row, order], there[row, order]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of one cell and kind, with whether a new cell begins."""
    last = None
    for batch in batches:
        cell, kind = (batch.column(c).to_numpy() for c in ("cell", "kind"))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if b > a:
                yield cell[a] != last, batch.slice(a, b - a)
                last = cell[a]


def _searched(slots: Callable[[pa.RecordBatch], list], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs cells; `slots` gives, for a block of anchors, what is sought: (same label?, low, high, whether sought) for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        anchors = sought = None
        kept: list[list] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if anchors is None:
                return
            numbers = np.asarray(anchors.column("id"))
            for s, parts in enumerate(kept):
                if parts:
                    ids, found, there = _merged(parts, k)
                    row, at = np.nonzero(there)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(np.full(len(row), s, np.int32)), pa.array(ids[row, at]), pa.array(found[row, at])], names=["anchor", "slot", "id", "score"])

        for new, rows in _cells(batches):
            if new:
                yield from flush()
                block, anchors, kept = [], None, []
            if rows.column("kind")[0].as_py() == 0:
                block.append(rows)
                continue
            if not block:  # a cell without anchors
                continue
            if anchors is None:
                anchors = pa.Table.from_batches(block).combine_chunks()
                matrix = Residues(integers(anchors.column("vector").combine_chunks() if len(block) > 1 else anchors.column("vector").chunk(0)))
                labels = pc.unique(anchors.column("label"))
                own = pc.index_in(anchors.column("label"), value_set=labels).to_numpy()
                sought = slots(anchors)
                kept = [[] for _ in sought]
            rows = rows.take(pc.sort_indices(rows.column("id")))
            found = scores(matrix, Residues(integers(rows.column("vector"), matrix.rows.shape[1])))
            other = pc.fill_null(pc.index_in(rows.column("label"), value_set=labels), -1).to_numpy(zero_copy_only=False)
            same = own[:, None] == other[None, :]
            ids = rows.column("id").to_numpy()
            for s, (alike, low, high, there) in enumerate(sought):
                wanted = (same if alike else ~same) & there[:, None]
                if low is not None:
                    wanted &= (found >= low[:, None]) & (found <= high[:, None])
                if wanted.any():
                    kept[s].append(_best(found, ids, wanted, k))
                if len(kept[s]) > 15:
                    kept[s] = [_merged(kept[s], k)]
        yield from flush()

    return run


_FOUND = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label as text, vector) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("vector"))


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, shares: int, extra: list[str]) -> DataFrame:
    """Anchors and rows by the cells where they meet, anchors first."""
    kinds = {f.name: f.dataType for f in anchors.schema.fields}
    left = anchors.select(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.col("anchor").alias("id"), "label", "vector", *extra)
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int")
    right = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), share.alias("share"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "label", "vector", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    both = left.unionByName(right).withColumn("cell", F.col("block") * shares + F.col("share")).drop("block", "share")
    return both.repartition(blocks * shares, "cell").sortWithinPartitions("cell", "kind")


def mine(rows: DataFrame, anchor: Column, *, vector: str = "embedding", positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` tells of a row (by vec_id or label) whether it is an anchor.  A negative's score lies between four fifths
    of the positive's score and the whole of it.
    """
    rows = usable(rows, vector)
    square = F.aggregate(F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE)), F.lit(0).cast("long"), lambda a, x: a + x * x)
    copies = rows.filter(anchor).groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    anchors = stored(copies.withColumn("own", square).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    many = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK))
    shares = max(-(-CELLS // blocks), -(-many // SHARE))

    everything = lambda block: [(True, None, None, np.ones(block.num_rows, bool))]
    near = mapped(_grid(anchors, rows, blocks, shares, []), _searched(everything, positives + 1), _FOUND)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives + 1)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("near"))
    near = near.select("anchor", F.transform("near", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("near"))
    # the anchor is one of the rows; a copy that stands in its place has the same id and score
    itself = F.array_position("near", F.struct(F.col("vec_id").alias("id"), F.col("own").alias("score")))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("itself")), 1, positives)
    found = anchors.join(near, "anchor").withColumn("itself", itself).withColumn("near", others).drop("itself")
    found = stored(found.filter(F.size("near") > 0), "positives")

    def windows(block: pa.Table) -> list:
        near = block.column("near").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        out = []
        for s in range(positives):
            there = pc.greater(pc.list_value_length(near), s).to_numpy(zero_copy_only=False)
            high = np.array([int(x[s]["score"]) if len(x) > s else 0 for x in near.to_pylist()], np.int64)
            out.append((False, high - high // 5, high, there))
        return out

    hard = mapped(_grid(found, rows, blocks, shares, ["near"]), _searched(windows, negatives), _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    out = hard.join(found.select("anchor", "vec_id", "copies", "near"), "anchor").withColumn("positive", F.element_at("near", F.col("slot") + 1))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("vec_id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


#: All of it in DuckDB's SQL, for the table of the query.
ORACLE = """
with e as materialized (
  select row_number() over (order by vec_id) as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id, a.label = b.label as same, coalesce(list_sum(list_transform(range(1, 1 + greatest(len(a.v), len(b.v))), lambda i: coalesce(a.v[i], 0) * coalesce(b.v[i], 0))), 0)::bigint as score
  from e a join e b on a.vec_id % 100 = 0),
p as (select * from (select a, anchor_id, b, vec_id, score, row_number() over (partition by a order by score desc, vec_id) as k from s where same and a <> b) where k <= 5)
select * from (
  select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.a, p.k order by s.score desc, s.vec_id))::int as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
where rank <= 5"""
