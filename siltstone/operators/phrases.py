"""Which of many phrases a text contains: one automaton for all of them, one pass over each text.

Phrases are broadcast in blocks whose number and bytes are bounded; a set of phrases beyond that takes one
pass over the texts for each block.  A phrase counts wherever its characters stand, within words as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases and their characters that one automaton holds at most.
BLOCK, CHARACTERS = 100_000, 4 << 20


def _blocks(phrases: DataFrame) -> Iterator[list[str]]:
    """The distinct phrases, in blocks that a hash deals out."""
    own = phrases.filter(F.length("phrase") > 0).select("phrase").distinct()
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    # blocks are about half full, so that uneven ones stay within the bound
    many = max(1, -(-2 * size["n"] // BLOCK), -(-2 * size["chars"] // CHARACTERS)) if size["n"] > BLOCK // 2 or size["chars"] > CHARACTERS // 2 else 1
    for b in range(many):
        yield [r["phrase"] for r in own.filter(F.pmod(F.xxhash64("phrase"), F.lit(many)) == b).collect()]


def contained(texts: DataFrame, phrases: DataFrame, head: str | None = None) -> DataFrame:
    """texts without `text` and `head`, a row for each phrase that `text` contains; with `in_head` where a column `head` is given.

    With a head, what is searched is the head, a space and the text, and `in_head` tells whether an occurrence
    ends within the head.  Null texts contain nothing.
    """
    keep = [f for f in texts.schema.fields if f.name not in ("text", head)]
    schema = T.StructType([*keep, T.StructField("phrase", T.StringType()), *([T.StructField("in_head", T.BooleanType())] if head else [])])
    columns = [*[f.name for f in keep], *([F.coalesce(head, F.lit("")).alias("_head")] if head else []), F.coalesce("text", F.lit("")).alias("_text")]
    ready, out = texts.select(*columns), None
    for block in _blocks(phrases):
        found = ready.mapInArrow(_search(texts.sparkSession.sparkContext.broadcast(sorted(block)), [f.name for f in keep], bool(head)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(block, keep: list[str], headed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = block.value
        automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(known):
            automaton.add_word(phrase, i)
        if known:
            automaton.make_automaton()
        for batch in batches:
            row, which, early = [], [], []
            heads = batch.column("_head") if headed else None
            for k, text in enumerate(batch.column("_text")):
                text, size = text.as_py(), 0
                if headed:
                    head = heads[k].as_py()
                    text, size = f"{head} {text}", len(head)
                seen: dict[int, bool] = {}
                for end, i in automaton.iter(text) if known else ():
                    if i not in seen:  # the first occurrence ends first
                        seen[i] = end < size
                row += [k] * len(seen)
                which += seen
                early += seen.values()
            taken = batch.take(pa.array(row, pa.int64()))
            columns = [*[taken.column(c) for c in keep], pa.array([known[i] for i in which], pa.string()), *([pa.array(early, pa.bool_())] if headed else [])]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "phrase", *(["in_head"] if headed else [])])

    return run
