"""How the sources of a language differ in their terms: duplicate texts collapsed, then sparse pairs.

Texts are grouped by language and digest (SHA-256), with the number of rows that each source
has of them; each text is tokenised once, in blocks of bytes, and its terms count for every source as
often as the source has the text, in documents and in occurrences.  A language keeps the terms that
stand in enough of its documents.

With smoothed shares p (per thousand million) of a group (language, source) and q of another group or of the
whole language, the sum of |p - q| over all kept terms compares two sources, and p - q finds the terms that a source has
more of.  Kept terms are dealt into blocks; a block sees, for each source, only the terms it holds.  With p0, the
share of a term that does not occur, |p - q| summed over all terms is V |p0 - q0| plus, for each term of
either source, |p - q| - |p0 - q0|.

Nulls count as empty strings.  Empty texts have no terms, but their groups are compared all the same.  Repeated
rows count each.  Ties of a rank go to the item that is first in UTF-8.  Empty tables give no rows; a language of
one source has no pairs; a language without kept terms has pairs of value 0.  Only the three named columns are read.  A
text, however long, is tokenised as a whole by one task; a text is carried once for each of its sources.
All arithmetic is of integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import blocks, buffers
from siltstone.llm.storage import mapped, stored

#: Documents of a language that must hold a term; ranks of terms that are returned.
MIN_DOCS, TOP = 30, 50
#: Bytes of text that are tokenised together; terms of a block of pairs, fewer if there are very many sources.
TEXT_BYTES, TERMS, ENTRIES = 8 << 20, 1_024, 1 << 20

#: What each byte becomes: letters lower-cased, bytes of other characters than ASCII as they are, all else 0.
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, term number) of each token, and the terms."""
    data, at = buffers(texts)
    letters = _LETTERS[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = letters != 0
    first = np.zeros(len(data) + 1, bool)
    first[at] = True  # a token ends with its text
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[letters != 0])])
    coded = words.dictionary_encode()
    return np.searchsorted(at, starts, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the values' sums."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d) of rows (lang, text, source, copies), where rows of one text follow each other."""
    for batch in (b for whole in batches for b in blocks(whole, limit=TEXT_BYTES)):
        lang, source, text, copies = (batch.column(c) for c in ("lang", "source", "text", "copies"))
        groups = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
        names = lang.dictionary_encode(), source.dictionary_encode()
        group = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
        group, member, of = np.unique(group, return_index=True, return_inverse=True)
        n = len(batch)
        again = np.zeros(n, bool)
        if n > 1:
            again[1:] = pc.and_(pc.equal(text.slice(1), text.slice(0, n - 1)), pc.equal(lang.slice(1), lang.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        which = np.cumsum(~again) - 1  # of the distinct texts
        at, term, terms = tokens(text.take(pa.array(np.flatnonzero(~again))))
        size = max(1, len(terms))
        pair, often = _summed(at * size + term, np.ones(len(at), np.int64))
        # each row takes the terms of its text
        bounds = np.searchsorted(pair, np.arange(which[-1] + 2) * size)
        length = (bounds[1:] - bounds[:-1])[which]
        row = np.repeat(np.arange(n), length)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(bounds[which], length)
        times = copies.to_numpy().astype(np.int64)[row]
        key, count, docs = _summed(of[row] * size + pair[entry] % size, often[entry] * times, times)
        told = groups.take(pa.array(member[key // size]))
        found = terms.take(pa.array(key % size)).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([told.field("lang"), told.field("source"), found, pa.array(count), pa.array(docs)], names=["lang", "source", "term", "n", "d"])


_COUNTS = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "d")])


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, digest, text, source, copies): the distinct texts of each language with the rows that each source has of them."""
    keyed = _base(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("copies"))
    return texts.join(copies.hint("merge"), ["lang", "digest"])  # a merge keeps a text's rows together


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term."""
    rows = collapsed(docs).select("lang", "source", "text", "copies")
    return mapped(rows, _counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms; `first` marks one row of each term of a language."""
    term = Window.partitionBy("lang", "term")
    found = counts(docs).select("*", F.sum("d").over(term).alias("df"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return found.filter(F.col("df") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def share(n: str | Column, total: str, size: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 size)), in decimals so that no product overflows."""
    n = F.col(n) if isinstance(n, str) else n
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    below = (F.col(total) + 5 * F.col(size)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """(source, other, value) of one block: for each pair of sources, what its terms add to V |p0 - q0|."""
    sources = right.column("source").combine_chunks()
    sources = sources.chunk(0) if isinstance(sources, pa.ChunkedArray) and sources.num_chunks else sources
    lang = right.column("lang")[0] if right.num_rows else None
    n = len(right)
    base = right.column("p0").to_numpy().astype(np.int64)
    found = np.zeros((n, n), np.int64)
    if left.num_rows and n > 1:
        row = pc.index_in(left.column("source"), value_set=right.column("source").combine_chunks()).to_numpy()
        column = left.column("term").combine_chunks().dictionary_encode()
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices.to_numpy()
        p = np.repeat(base[:, None], column.max() + 1, axis=1)
        there = np.zeros(p.shape, bool)
        p[row, column], there[row, column] = left.column("p").to_numpy(), True
        gap = np.abs(base[:, None] - base[None, :])
        for a in range(n):
            own = np.flatnonzero(there[a])
            more = np.abs(p[:, own] - p[a, own]) - gap[a][:, None]
            whole, shared = more.sum(axis=1), (more * there[:, own]).sum(axis=1)
            found[a] += whole - shared  # the terms of a alone; found[a, b] gets all of b's terms when b has its turn
            found[:, a] += whole
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    return pa.table({"lang": pa.array([lang.as_py() if lang is not None else ""] * len(a), pa.string()), "source": pa.array(np.asarray(sources)[a], pa.string()) if len(a) else pa.array([], pa.string()), "item": pa.array(np.asarray(sources)[b], pa.string()) if len(b) else pa.array([], pa.string()), "more": pa.array(found[a, b])})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each pair of sources of a language, and the first terms that a source has more of."""
    kept = stored(kept_terms(docs, min_docs), "terms")
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = _base(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[zero(c) for c in ("total", "v", "lang_total")], F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"))
    terms = F.greatest(F.lit(32), F.least(F.lit(TERMS), F.floor(F.lit(ENTRIES) / F.col("sources"))))
    p0 = F.when(F.col("v") > 0, share(F.lit(0), "total", "v")).otherwise(0)
    groups = stored(groups.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int"), "p0": p0}), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")})

    left = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "p0")
    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_pairs, "lang string, source string, item string, more long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    value = F.col("v") * F.abs(F.col("p0") - F.col("q0")) + F.col("more")
    pairs = summed.join(groups.select("lang", "source", "v", "p0"), ["lang", "source"]).join(other, ["lang", "item"]).select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    more = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(first)


#: All of it in DuckDB's SQL.
ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by all having count(distinct r) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by all),
dense as (
  select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source)::hugeint as total, sum(coalesce(c.n, 0)) over (partition by g.lang, kept.term)::hugeint as lang_n, sum(coalesce(c.n, 0)) over (partition by g.lang)::hugeint as lang_total, v.v::hugeint as v
  from g join kept using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as materialized (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as p, 1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * v) as q from dense),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from every)
select * from ranked where part = 'pair' or rank <= 50"""
