"""Near duplicates by ProbMinHash over weighted five-word shingles.

Each distinct shingle of a text, weighted by its count, sends a Poisson process
of arrivals to random slots; a slot keeps the earliest.  A text's arrivals stop
once they come later than all its slots' (early termination).  Two texts agree
in a slot with the probability Jaccard similarity of their weighted shingles,
which is at least the weighted Jaccard similarity.  Bands of slots propose
candidates; links are verified exactly: weighted Jaccard of 0.8 or more.

Exact copies are one node from the start.  Within a bucket of a band each node
is first held against the bucket's least node only, then, in buckets that still
hold several classes, against another drawn by a hash; so a group of like
texts costs a few comparisons for each member.  What is left in buckets of
several classes goes through an exact join on rare shingles (prefix filtering),
so that no link between different classes is lost.  Classes are
connected components, found by rounds of joins; nothing is collected.

No key is met in one task: buckets and heads of many texts are dealt over
parts, and the one row that stands for them is repeated for each part.

Nulls are empty texts.  Texts without words are copies of equal texts only.
Rows with equal doc_id are one document, which all its texts link; of its rows
deduplicate() keeps the one with the least digest.  A null doc_id is linked to
nothing, and its rows stay.  Texts are read whole, however long; other columns
are carried as they are, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import Words, blocks, mix, similarity, weighted
from siltstone.llm.storage import mapped, stored

SIMILARITY = 0.8
#: 32 bands of 6 slots: a pair at 0.8 is missed with probability 6e-5, one at 0.3 proposed with 2e-2.
BANDS, ROWS = 32, 6
#: Buckets that hold several classes are tried so often with another head before the exact join.
TURNS = 1
#: A shingle that more texts hold than this ties them into a family, compared in blocks of so many texts.
FEW, BLOCK = 16, 256
#: A key with more rows than this is dealt over several tasks.
HOT = 1_000
#: The rounds of components() use a partition for so many edges, and one for each core at least.
EDGES = 50_000
#: Tables of candidate ids are broadcast up to so many rows (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def signatures(shingles: np.ndarray, counts: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots' earliest shingles for each text, which texts have any): counts has the number of shingles of each text."""
    n = len(counts)
    text = np.repeat(np.arange(n, dtype=np.uint64), counts)
    keys, weights = np.unique((text << np.uint64(48)) | (shingles >> np.uint64(16)), return_counts=True)
    owner = (keys >> np.uint64(48)).astype(np.int64)
    element = keys & np.uint64((1 << 48) - 1)
    first = np.full((n, slots), np.inf)
    chosen = np.zeros((n, slots), np.uint64)
    flat, picked = first.reshape(-1), chosen.reshape(-1)
    arrival, turn = np.zeros(len(keys)), 0
    while len(element):
        turn += 1
        draw = mix(element + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        arrival = arrival - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weights
        slot = ((mix(draw) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        at = owner * slots + slot
        np.minimum.at(flat, at, arrival)
        won = arrival == flat[at]
        picked[at[won]] = element[won]
        on = arrival < first.max(1)[owner]
        element, owner, weights, arrival = element[on], owner[on], weights[on], arrival[on]
    return chosen, counts > 0


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, bands): a key for equal texts and the hashes of the bands, none for texts without words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = (np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        for batch in batches:
            for block in blocks(batch):
                chosen, there = signatures(*Words(block.column("text")).shingles(), bands * rows)
                hashed = mix((chosen * steps).reshape(len(chosen), bands, rows).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                flat = pa.array(hashed[there].reshape(-1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(there * bands)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_key"), pa.ListArray.from_arrays(offsets, flat)], schema.names)

    text = F.coalesce("text", F.lit(""))
    return mapped(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.sha2(text, 256).alias("text_key"), text.alias("text")), run, schema)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose texts are as similar as asked for."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text_b"):
                sets = []
                for side in ("text_a", "text_b"):
                    shingles, counts = Words(block.column(side)).shingles()
                    sets.append([weighted(s) for s in np.split(shingles, np.cumsum(counts)[:-1])])
                like = pa.array([similarity(x, y) >= threshold for x, y in zip(*sets, strict=True)], pa.bool_())
                yield block.select(["a", "b"]).filter(like)

    return mapped(pairs, run, schema)


def _few(ids: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table of ids if it is proven small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _dealt(left: DataFrame, weights: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """left joined with right on key; weights: (key, weight), how many rows of `left` have a key.

    Rows of a heavy key are dealt over parts by a hash of `spread`, and what `right` has for it is repeated for
    each.  A part is so large that there are BROADCAST_ROWS heavy keys at most, so the list of them is small.
    """
    total = weights.agg(F.sum("weight").alias("n")).first().n or 0
    size = max(HOT, total // BROADCAST_ROWS)
    heavy = stored(weights.filter(F.col("weight") > size).select(key, F.ceil(F.col("weight") / size).alias("_parts")), "heavy")
    if heavy.isEmpty():
        return left.join(right, key)
    parts = F.coalesce("_parts", F.lit(1))
    one = left.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts)).drop("_parts")
    two = right.join(F.broadcast(heavy), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return one.join(two, [key, "_part"]).drop("_part")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b): an id with several texts gives a row for each; the ids of many pairs are dealt over tasks."""
    ids = pairs
    for k, other in (("b", "a"), ("a", "b")):
        weights = ids.groupBy(k).agg(F.count("*").alias("weight"))
        side = texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
        pairs = _dealt(pairs, weights, side, k, other)
    return pairs.select("a", "b", "text_a", "text_b")


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of each connected component of the links (a, b), by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    # a star never makes more edges than it was given
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // EDGES)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.coalesce(parts), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        small = stored(small.coalesce(parts), "small-star")
        # done once every node has one parent and no parent has one
        parents = small.select(F.col("v").alias("u")).distinct()
        again = small.groupBy("u").count().filter("count > 1").select("u").unionByName(small.join(parents, "u", "left_semi").select("u"))
        edges = small
        if again.isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("least"))


def _classes(nodes: DataFrame, found: DataFrame, node: str) -> DataFrame:
    return nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("least", F.coalesce("least", node))


def _shingled(texts: DataFrame) -> DataFrame:
    """(doc_id, own, size, shingle, n): each text's weighted shingles and their total count; own tells the texts of one id apart."""
    schema = T.StructType([texts.schema["doc_id"], T.StructField("own", T.LongType()), T.StructField("size", T.LongType()), T.StructField("shingle", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                shingles, counts = Words(block.column("text")).shingles()
                for doc, own, part in zip(block.column("doc_id").to_pylist(), block.column("own").to_pylist(), np.split(shingles, np.cumsum(counts)[:-1]), strict=True):
                    found, n = weighted(part)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), block.schema.field("doc_id").type), pa.array(np.full(len(found), own, np.int64)), pa.array(np.full(len(found), len(part))), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema.names)

    return mapped(texts.withColumn("own", F.xxhash64("text")), run, schema)


def _rest(classed: DataFrame, texts: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of different classes: all pairs that can be similar, by prefix filtering.

    Shingles are ordered by how many of these texts hold them.  Similar texts
    share one among their rarest ones: those that come before `threshold` of the
    text's count.  Passages common to many texts are thus not looked up at all
    unless a text holds hardly anything else.
    """
    shingles = stored(_shingled(texts.join(classed.select("doc_id"), "doc_id", "left_semi")), "shingles")
    spread = stored(shingles.groupBy("shingle").agg(F.count("*").alias("spread")), "spreads")
    ordered = _dealt(shingles, spread.withColumnRenamed("spread", "weight"), spread, "shingle", "doc_id").groupBy("doc_id", "own", "size").agg(F.sort_array(F.collect_list(F.struct("spread", "shingle", "n"))).alias("s"))
    # a shingle belongs to the prefix if less than (1 - threshold) * size + 1 of the count comes before it: one pass counts them
    short = F.expr("slice(s, 1, least(size(s), cast(size - ceil({0} * size) + 1 as int)))".format(threshold))
    walked = F.expr(f"aggregate(short, struct(0L as total, 0 as k), (a, x) -> struct(a.total + x.n as total, if(a.total <= size - ceil({threshold} * size), a.k + 1, a.k) as k)).k")
    prefix = ordered.withColumn("short", short).select("doc_id", "own", "size", F.explode(F.slice("short", F.lit(1), walked)).alias("x")).select("doc_id", "own", "size", F.col("x.shingle").alias("shingle"))
    prefix = prefix.join(classed, "doc_id").select("doc_id", "own", "size", "least", "shingle")
    prefix = stored(prefix, "prefixes")
    held = prefix.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("doc_id").alias("head"), (F.min("least") != F.max("least")).alias("mixed")).filter("mixed")
    held = stored(held, "held")
    # a shingle of few texts: their pairs
    few = prefix.join(held.filter(F.col("texts") <= FEW).select("shingle"), "shingle")
    one, two = (few.select(F.col("doc_id").alias(k), F.col("size").alias(f"size_{k}"), F.col("least").alias(f"least_{k}"), "shingle") for k in "ab")
    size_ok = (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a"))
    pairs = one.join(two, "shingle").filter((F.col("a") < F.col("b")) & (F.col("least_a") != F.col("least_b")) & size_ok)
    pairs = pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links = _verified(_with_texts(stored(pairs, "candidates"), texts), threshold)
    # shingles of many texts tie them into families, whose texts are held against each other block by block
    common = held.filter(F.col("texts") > FEW)
    tied = _dealt(prefix, common.select("shingle", F.col("texts").alias("weight")), common.select("shingle", "head"), "shingle", "doc_id")
    ties = stored(tied.filter("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "ties")
    if ties.isEmpty():
        return links
    family = components(ties)
    family = stored(family.unionByName(family.select(F.col("least").alias("node"), "least").distinct()).select(F.col("node").alias("doc_id"), F.col("least").alias("family")), "families")
    blocks_of = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    elements = shingles.groupBy("doc_id", "own").agg(F.collect_list(F.struct("shingle", "n")).alias("s")).drop("own")
    placed = stored(family.join(blocks_of, "family").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).join(elements, "doc_id").join(classed, "doc_id"), "members")
    ours = placed.select("family", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("doc_id").alias("doc_id"), F.col("least").alias("least"), F.col("s").alias("s"))
    theirs = placed.select("family", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("x"), F.col("own").alias("y"), F.col("doc_id").alias("doc_id"), F.col("least").alias("least"), F.col("s").alias("s"))
    key, schema = ["family", "x", "y"], links.schema
    return links.unionByName(ours.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(lambda left, right: _like(left, right, threshold, schema), schema))


def _like(one: pa.Table, two: pa.Table, threshold: float, schema: T.StructType) -> pa.Table:
    """Links that join the classes of two blocks of texts: all pairs are compared, by products of count matrices over slices of their shingles."""
    sides = []
    for t in (one, two):
        lists = t.column("s").combine_chunks()
        fields = lists.flatten()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n = fields.field("n").to_numpy()
        owner = np.repeat(np.repeat(np.arange(len(t)), lengths), n)
        again = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        # the k-th occurrence of a shingle is an element of its own, so that shared elements add up to the lesser counts
        sides.append((mix(np.repeat(fields.field("shingle").to_numpy().view(np.uint64), n) + mix(again.astype(np.uint64))), owner, np.bincount(owner, minlength=len(t))))
    (e1, o1, s1), (e2, o2, s2) = sides
    common = np.intersect1d(e1, e2)
    shared = np.zeros((len(one), len(two)), np.float32)
    for k in range(0, len(common), 4096):
        matrices = []
        for e, o, s in sides:
            at = np.minimum(np.searchsorted(common[k : k + 4096], e), len(common[k : k + 4096]) - 1)
            hit = common[k : k + 4096][at] == e
            m = np.zeros((len(s), 4096), np.float32)
            m[o[hit], at[hit]] = 1
            matrices.append(m)
        shared += matrices[0] @ matrices[1].T
    i, j = np.nonzero(shared >= threshold * (s1[:, None] + s2[None] - shared))
    a, b = one.column("doc_id").to_numpy()[i], two.column("doc_id").to_numpy()[j]
    # of all links, those that join two classes which nothing before has joined: as many as there are texts at most
    joins = [t.column("least").to_numpy()[k] for t, k in ((one, i), (two, j))]
    _, first = np.unique(np.stack([np.minimum(*joins), np.maximum(*joins)]), axis=1, return_index=True)
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    keep = []
    for k in first.tolist():
        x, y = root(joins[0][k]), root(joins[1][k])
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    a, b = a[keep], b[keep]
    kind = one.schema.field("doc_id").type
    return pa.table([pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind)], [f.name for f in schema])


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(band, doc_id, least) of the buckets that hold several classes."""
    members = _classes(buckets, found, "doc_id")
    mixed = members.groupBy("band").agg((F.min("least") != F.max("least")).alias("mixed"), F.count("*").alias("weight")).filter("mixed").select("band", "weight")
    mixed = stored(mixed, "mixed-bands")
    return stored(_dealt(members.select("band", "doc_id", "least"), mixed, mixed.select("band"), "band", "doc_id"), "mixed")


def classes(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of `docs`: doc_id and class_id, the least doc_id of its class (null for a null doc_id)."""
    ids = docs.select("doc_id", "text")
    signed = stored(_signed(ids, bands, rows), "signatures")
    nodes = stored(signed.groupBy("text_key").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("text_key", "m.*"), "nodes")
    banded = nodes.select("doc_id", F.explode("bands").alias("band"))
    heads = stored(banded.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("weight")).filter("weight > 1"), "heads")
    buckets = stored(_dealt(banded, heads.select("band", "weight"), heads.select("band", "head"), "band", "doc_id"), "buckets")
    tried = stored(buckets.filter("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "candidates")
    buckets = buckets.drop("head")
    texts = ids.join(_few(stored(buckets.select("doc_id").distinct(), "involved")), "doc_id", "left_semi").distinct()
    texts = stored(texts, "texts")
    links = stored(_verified(_with_texts(tried, texts), threshold), "links")
    found = components(links)
    mixed = _mixed(buckets, found)
    for turn in range(1, TURNS + 1):
        # another head for each bucket, drawn by a hash, against the members of other classes
        drawn = mixed.groupBy("band").agg(F.min_by(F.struct(F.col("doc_id").alias("head"), F.col("least").alias("head_least")), F.xxhash64("doc_id", "band", F.lit(turn))).alias("h"), F.count("*").alias("weight")).select("band", "weight", "h.*")
        drawn = stored(drawn, "drawn")
        pairs = _dealt(mixed, drawn.select("band", "weight"), drawn.drop("weight"), "band", "doc_id").filter("least != head_least").select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b"))
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
        more = stored(_verified(_with_texts(pairs, texts), threshold), "links")
        tried = tried.unionByName(pairs)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components(links)
        mixed = _mixed(mixed.drop("least"), found)
    left = mixed.select("doc_id", "least").distinct()
    if not left.isEmpty():
        more = stored(_rest(stored(left, "left"), texts, tried, threshold), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    # every row by its text's node, then by the node's class
    same = nodes.select("text_key", F.col("doc_id").alias("node"))
    by_doc = _classes(signed.select("doc_id", "text_key").join(same, "text_key"), found, "node").select("doc_id", F.col("least").alias("class_id"))
    nulls = ids.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return by_doc.unionByName(nulls)


def kept() -> Column:
    """Of a row of classes(): whether its document is the one that stays."""
    return F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one document of each class stays: that with the least doc_id.

    Rows of one doc_id (repeated rows) are reduced to the one with the least digest; rows with a null doc_id stay.
    """
    found = classes(docs, threshold)
    gone = stored(found.filter(~kept()).select("doc_id").distinct(), "gone")
    staying = docs.join(_few(gone), "doc_id", "left_anti")
    twice = stored(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if twice.isEmpty():
        return staying
    twice = _few(twice)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = staying.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.sha2(F.to_json(every), 256)).alias("r")).select("r.*")
    return staying.join(twice, "doc_id", "left_anti").unionByName(one).select(*docs.columns)
