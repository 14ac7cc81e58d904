"""States of a repository: incremental scans, one hash of all, change sets, and a cache of features."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import written
from pyspark.sql import types as T


def below(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """The paths that are in `changed` (path), or below one of its folders: an equality join on leading parts."""
    parts = F.split("path", "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hit = paths.select("path", F.explode(leading).alias("at")).join(changed.select(F.col("path").alias("at")).distinct(), "at", "left_semi")
    return hit.select("path").distinct()


def incremental(old: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, hash, tokens, reused): the old rows, of which changed ones and those below changed folders come from `now`.

    Tokens of a file whose hash has stayed are taken from its old row; changed paths that are no
    longer there are left out.  `now` is read for changed paths alone.
    """
    again = now.join(below(now.select("path"), changed), "path", "left_semi")
    before = old.select("path", F.col("hash").alias("h"), F.col("tokens").alias("t"))
    same = F.col("h").eqNullSafe(F.col("hash"))
    fresh = again.join(before, "path", "left").select("path", "hash", F.when(same, F.col("t")).otherwise(F.col("tokens")).alias("tokens"), same.alias("reused"))
    kept = old.join(changed, "path", "left_anti").join(again.select("path"), "path", "left_anti")
    return kept.select("path", "hash", "tokens", F.lit(True).alias("reused")).unionByName(fresh)


def root_hash(files: DataFrame, key: str) -> DataFrame:
    """(key, root): SHA-256 over all path:hash of a key, by path.  Each key is one sorted stream, hashed as it passes."""
    ordered = files.select(key, "path", "hash").dropna().repartition(key).sortWithinPartitions(key, "path")
    schema = T.StructType([files.schema[key], T.StructField("root", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, started = None, hashlib.sha256(), False
        for batch in batches:
            for k, path, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if started and k != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([digest.hexdigest()])], schema.names)
                    digest = hashlib.sha256()
                now, started = k, True
                digest.update(f"{path}:{h}".encode())
            kind = batch.schema.field(0).type
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], schema.names)

    return ordered.mapInArrow(run, schema)


def change_set(old: DataFrame, now: DataFrame, logged: DataFrame) -> DataFrame:
    """(path, by_snapshot, by_log, deleted): paths whose hash differs between two states, and logged ones that are there now."""
    before = old.select("path", F.col("hash").alias("before"), F.lit(True).alias("was"))
    both = before.join(now.select("path", F.col("hash").alias("after"), F.lit(True).alias("there")), "path", "full")
    both = both.join(logged.select("path", F.lit(True).alias("named")).distinct(), "path", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    differs = ~F.col("before").eqNullSafe(F.col("after")) | (no("was") != no("there"))
    rows = both.select("path", differs.alias("by_snapshot"), (no("named") & no("there")).alias("by_log"), (~no("there")).alias("deleted"))
    return rows.filter("by_snapshot or by_log")


def cache_key(path: Column, content: Column, provider: str = "offline", version: int = 2) -> Column:
    return F.sha2(F.concat_ws("|", path, content, F.lit(provider), F.lit(str(version))), 256)


def probe(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with `cached`: whether their key is in the cache (key); what misses is to be made."""
    known = cache.select(F.col("key").alias("_key")).distinct().withColumn("_hit", F.lit(True))
    found = files.withColumn("_key", cache_key(F.col("path"), F.col("hash"))).join(known, "_key", "left")
    return found.select(*files.columns, F.coalesce("_hit", F.lit(False)).alias("cached"))


def refreshed(files: DataFrame, cache: DataFrame, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(features, misses): features (path, key, ...) of all files, where only those whose key isn't in the cache are made.

    `make` turns files into (path, ...); cache: features of an earlier run.  Both the new features and the whole are written
    anew, beside the earlier version, so readers of that one aren't disturbed and a failed run leaves it as it was.  A cache row of a
    path or content that is gone doesn't come along; a key that the cache holds twice counts once.
    """
    keyed = files.withColumn("key", cache_key(F.col("path"), F.col("hash")))
    known = cache.dropDuplicates(["key"])
    misses = keyed.join(known.select("key"), "key", "left_anti")
    made = written(make(misses).join(misses.select("path", "key").distinct(), "path"), "features")
    kept = known.join(keyed.select("key").distinct(), "key", "left_semi")
    return written(kept.select(*made.columns).unionByName(made), "features"), made
