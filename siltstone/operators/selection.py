"""Choosing under a budget, and judging what was chosen."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_under_budget(candidates: DataFrame, budget: int, cap: int | None = None) -> DataFrame:
    """Skip and continue: (task, path, rank, tokens, selected) for candidates (task, path, score, tokens).

    By falling score, then path, each candidate is taken if it still fits, else the next is tried; a
    candidate without a positive score is never taken.  Every candidate has a row, unless `cap` asks
    for the best ones of a task alone.  The rows of a task are read as one sorted stream with a rank
    and a running total, so memory doesn't grow with their number.
    Rows with a null task, path, score or tokens are left out.
    """
    known = candidates.select("task", "path", "score", F.col("tokens").cast("long").alias("tokens")).dropna().filter("score > 0")
    ordered = known.repartition("task").sortWithinPartitions("task", F.desc("score"), "path", "tokens").select("task", "path", "tokens")
    schema = T.StructType([known.schema["task"], known.schema["path"], T.StructField("rank", T.LongType()), known.schema["tokens"], T.StructField("selected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, rank, used = False, None, 0, 0
        for batch in batches:
            ranks, taken = [], []
            for task, tokens in zip(batch.column("task").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if not started or task != now:
                    started, now, rank, used = True, task, 0, 0
                rank += 1
                fits = used + tokens <= budget
                used += tokens if fits else 0
                ranks.append(rank)
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("path"), pa.array(ranks, pa.int64()), batch.column("tokens"), pa.array(taken, pa.bool_())], schema.names)

    chosen = ordered.mapInArrow(run, schema)
    return chosen if cap is None else chosen.filter(F.col("rank") <= cap)


def expected_ranks(ranked: DataFrame, group: str) -> DataFrame:
    """Of (group, rank, expected): where the expected rows stand.

    expected: their number; all_at: the first rank by which all are seen; median and p90: the elements
    round((n - 1) p) of their sorted ranks, halves to even; recall at 20, 50 and 100.
    """
    hits = ranked.filter("expected")
    w = Window.partitionBy(group).orderBy("rank")
    placed = hits.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    pick = lambda p: F.max(F.when(F.col("at") == F.bround((F.col("n") - 1) * p, 0), F.col("rank")))
    recall = [F.round(F.avg((F.col("rank") <= k).cast("double")), 4).alias(f"recall_{k}") for k in (20, 50, 100)]
    return placed.groupBy(group).agg(F.count("*").alias("expected"), F.max("rank").cast("long").alias("all_at"), pick(0.5).cast("long").alias("median_rank"), pick(0.9).cast("long").alias("p90_rank"), *recall)


def token_accuracy(rows: DataFrame, group: str) -> DataFrame:
    """Per group of (group, selected, expected, tokens): precision, recall, F1 and precision by tokens; 0 where nothing is there to divide by."""
    both = F.col("selected") & F.col("expected")
    n = lambda c: F.sum(c.cast("long"))
    tokens = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0))
    part = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    counts = rows.groupBy(group).agg(n(both).alias("hit"), n(F.col("selected")).alias("s"), n(F.col("expected")).alias("e"), tokens(both).alias("ht"), tokens(F.col("selected")).alias("st"))
    return counts.select(group, part(F.col("hit"), F.col("s")).alias("precision"), part(F.col("hit"), F.col("e")).alias("recall"), part(2 * F.col("hit"), F.col("s") + F.col("e")).alias("f1"), part(F.col("ht"), F.col("st")).alias("token_precision"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two selections (path, mode): added, removed or mode; what stayed is left out."""
    both = old.select("path", F.col("mode").alias("before"), F.lit(1).alias("o")).join(new.select("path", F.col("mode").alias("after"), F.lit(1).alias("n")), "path", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "mode")
    return both.select("path", change.alias("change")).filter("change is not null")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is a path's whole leading part; an equality join on all leading parts of a path."""
    parts = F.split("path", "/")
    leading = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    return leading.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def neighbour_boosts(changes: DataFrame, seeds: int = 8, boost: int = 24) -> DataFrame:
    """(file, boost, links): files changed together with one of the most changed files, which are left out.

    changes: (commit, file).  The seeds are few, so only their commits are joined.
    """
    once = changes.select("commit", "file").dropna().distinct()
    top = once.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(seeds).select("file")
    commits = once.join(F.broadcast(top), "file", "left_semi").select("commit").distinct()
    near = once.join(commits, "commit", "left_semi").join(F.broadcast(top), "file", "left_anti")
    return near.groupBy("file").agg(F.lit(boost).cast("long").alias("boost"), F.count("*").alias("links"))


def check_citations(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """citations (doc_id, first, last, hash) with status, the first failure of: missing, stale, lines; else valid."""
    facts = docs.select("doc_id", F.sha2("text", 256).alias("now"), F.size(F.split("text", "\n")).alias("lines"), F.lit(1).alias("there"))
    bad = (F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("lines"))
    status = F.when(F.col("there").isNull(), "missing").when(~F.col("hash").eqNullSafe(F.col("now")), "stale").when(F.coalesce(bad, F.lit(True)), "lines").otherwise("valid")
    return citations.join(facts, "doc_id", "left").select(*citations.columns, status.alias("status"))


def saturated_scores(counts: DataFrame, vocabulary: DataFrame, n: DataFrame) -> DataFrame:
    """(doc_id, domain, score): idf times saturated term frequency, 2.2 tf / (tf + 1.2), over a domain's terms, where 1 or more.

    counts: (doc_id, term, tf) of the vocabulary's terms alone; vocabulary: (domain, term), a small dimension; n: one row.
    """
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = vocabulary.join(idf, "term")
    score = F.sum(F.col("idf") * F.lit(2.2) * F.col("tf") / (F.col("tf") + F.lit(1.2)))
    return counts.join(F.broadcast(weights), "term").groupBy("doc_id", "domain").agg(F.round(score, 4).alias("score")).filter("score >= 1")
