"""A registry of selections: records of what was selected and left out, contents kept once by their hash, and retrieval by path or block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import source as C
from siltstone.functions.text import estimate_tokens
from siltstone.operators.provenance import redact_secrets

#: Modes whose content is kept; of others the record holds the summary alone (fixed values).
KEPT_MODES = ("full", "diff", "symbols", "skeleton")
RECORD = "pack", "block_id", "path", "kind", "mode", "symbol", "file_hash", "content_hash", "tokens", "score", "reasons", "summary", "stored", "place"


def block_id(path: Column, content_hash: Column) -> Column:
    """The path in one word and twelve digits of its content's hash."""
    return F.concat(F.translate(F.translate(path, "\\", "/"), "/", "\u0001"), F.lit(":"), F.left(content_hash, F.lit(12))).transform(lambda c: F.replace(c, F.lit("\u0001"), F.lit("__")))


def records(selected: DataFrame, omitted: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One record for each selected file, each of its symbols, and each omitted file.

    selected: (pack, step, path, mode, content, summary, score, reasons); omitted: (pack, step, path, mode, score, reasons, reason, tokens); files:
    (path, hash, tokens), of distinct paths; symbols: (pack, path, n, name, body).  `stored` is the content's key among the contents, null where it isn't kept.
    `place` orders a pack's records: selected files by step, each before its symbols, then omitted ones.  There is no limit to their number.
    """
    c, text = F.col, lambda name: F.coalesce(name, F.lit(""))
    known = files.select("path", c("hash").alias("file_hash"), c("tokens").cast("long").alias("file_tokens"))
    content = F.when(text("content") != "", c("content")).otherwise(text("summary"))
    own = selected.join(known, "path", "left").withColumn("_content", content)
    own = own.withColumn("content_hash", F.sha2(F.when(c("_content") != "", c("_content")).otherwise(c("path")), 256))
    place = lambda kind, n: F.struct(F.lit(kind).alias("kind"), c("step").cast("long").alias("step"), n.cast("long").alias("n"))
    files_part = own.withColumns({
        "kind": F.lit("selected"), "symbol": F.lit(None).cast("string"), "block_id": block_id(c("path"), c("content_hash")), "tokens": F.when(c("_content") != "", estimate_tokens(c("_content"))).otherwise(0).cast("long"),
        "stored": F.when(c("mode").isin(*KEPT_MODES) & (c("_content") != ""), F.sha2("_content", 256)), "place": place(0, F.lit(-1)),
    }).select(*RECORD)
    parts = symbols.join(selected.select("pack", "path", "step", "score", "reasons"), ["pack", "path"]).join(known, "path", "left")
    body = F.when(text("body") != "", c("body")).otherwise(c("name"))
    parts = parts.withColumn("_body", body).withColumn("content_hash", F.sha2(F.concat("path", F.lit(":"), "name", F.lit(":"), "_body"), 256))
    symbols_part = parts.withColumns({
        "kind": F.lit("selected"), "mode": F.lit("symbol"), "symbol": c("name"), "block_id": block_id(F.concat("path", F.lit("::"), "name"), c("content_hash")), "tokens": estimate_tokens(c("_body")).cast("long"),
        "summary": F.lit(None).cast("string"), "stored": F.sha2("_body", 256), "place": place(0, c("n")),
    }).select(*RECORD)
    left = omitted.join(known, "path", "left").withColumn("content_hash", F.sha2(F.concat("path", F.lit(":"), F.coalesce("file_hash", c("score").cast("string")), F.lit(":"), "reason"), 256))
    left_part = left.withColumns({
        "kind": F.lit("omitted"), "symbol": F.lit(None).cast("string"), "block_id": block_id(c("path"), c("content_hash")), "tokens": F.coalesce("file_tokens", c("tokens")).cast("long"), "summary": c("reason"),
        "stored": F.lit(None).cast("string"), "place": place(1, F.lit(-1)),
    }).select(*RECORD)
    return files_part.unionByName(symbols_part).unionByName(left_part)


def contents(selected: DataFrame, symbols: DataFrame) -> DataFrame:
    """(hash, content): what records of the same inputs keep, each content once."""
    whole = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("summary", F.lit("")))
    kept = selected.filter(F.col("mode").isin(*KEPT_MODES)).select(whole.alias("content"))
    bodies = symbols.join(selected.select("pack", "path"), ["pack", "path"], "left_semi").select(F.when(F.coalesce("body", F.lit("")) != "", F.col("body")).otherwise(F.col("name")).alias("content"))
    return kept.unionByName(bodies).filter("content != ''").withColumn("hash", F.sha2("content", 256)).dropDuplicates(["hash"]).select("hash", "content")


def save(found: DataFrame, kept: DataFrame, folder: str, version: str) -> None:
    """Writes a version of the registry: the contents that aren't there yet first, its records last.

    Contents lie by the first two digits of their hash.  A run that fails between the two leaves contents that no record names; writing it again adds none.
    A version that is there is not written over.
    """
    spark = found.sparkSession
    fresh = kept.withColumn("prefix", F.left("hash", F.lit(2)))
    there = _there(spark, f"{folder}/contents")
    if there is not None:
        fresh = fresh.join(there.select("hash", F.col("prefix").cast("string").alias("prefix")), ["prefix", "hash"], "left_anti")
    fresh.write.mode("append").partitionBy("prefix").parquet(f"{folder}/contents")
    found.write.parquet(f"{folder}/records/version={version}")


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("hash string, content string, prefix string").parquet(path)


def load(spark: SparkSession, folder: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, contents) of a version, the last by name if none is given."""
    found = spark.read.parquet(f"{folder}/records").withColumn("version", F.col("version").cast("string"))
    chosen = version if version is not None else found.agg(F.max("version")).first()[0]
    kept = _there(spark, f"{folder}/contents")
    return found.filter(F.col("version") == chosen).drop("version"), kept


def retrieve(found: DataFrame, kept: DataFrame, requests: DataFrame, files: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(id, status, block_id, path, mode, tokens, content, truncated, warnings) for each request.

    requests: (id, pack, path, block_id, mode, allow_stale), of distinct ids; files: (path, hash, text), as they are now, of distinct paths.  The first record of the pack
    that the path or the block names is taken.  `as_stored` gives the kept content, else the summary, else the file as it is.  Other modes give the file's
    text by that view, with secrets redacted, and where it was cut to `most_chars`, `truncated`.  status: no record, stored, gone (the file isn't there), stale (its hash differs
    from the record's, and the request doesn't allow it), stale-current, current.  A record without a hash is never stale.
    """
    c = F.col
    # a record each by path and by block, made before anything is joined
    fields = F.struct("place", *[k for k in RECORD if k not in ("pack", "place")])
    first = found.withColumn("_r", fields)
    by = lambda key: first.filter(c(key).isNotNull()).groupBy("pack", key).agg(F.min_by("_r", "place").alias(f"_by_{key}"))
    rows = requests.join(by("path"), ["pack", "path"], "left").join(by("block_id"), ["pack", "block_id"], "left")
    either = F.when(c("_by_path").isNull(), c("_by_block_id")).when(c("_by_block_id").isNull(), c("_by_path")).otherwise(F.when(c("_by_block_id.place") < c("_by_path.place"), c("_by_block_id")).otherwise(c("_by_path")))
    rows = rows.select("id", c("mode").alias("view"), F.coalesce("allow_stale", F.lit(False)).alias("allow_stale"), either.alias("r"))
    # the record alone tells whether there is a kept text, so contents are read by the requests that get one
    own = (c("view") == "as_stored") & (c("r.stored").isNotNull() | (F.coalesce("r.summary", F.lit("")) != ""))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(False)))
    held = kept.select(c("hash").alias("_h"), c("content").alias("_kept")).dropDuplicates(["_h"])
    rows = rows.join(held, F.when(c("_own"), c("r.stored")) == c("_h"), "left")
    rows = rows.withColumn("stored", F.when(c("_own"), F.coalesce("_kept", "r.summary"))).drop("_h", "_kept", "_own")
    # texts go once to the requests that read them, and are looked at for secrets there
    now = files.select("path", c("hash").alias("_now"), F.lit(True).alias("_there"), c("text").alias("_text"))
    rows = rows.withColumn("path", c("r.path")).join(now, "path", "left")
    stale = F.coalesce(c("r.file_hash") != c("_now"), F.lit(False))
    status = (
        F.when(c("r").isNull(), "no record").when(c("stored").isNotNull(), "stored").when(c("_there").isNull(), "gone").when(stale & ~c("allow_stale"), "stale").when(stale, "stale-current").otherwise("current")
    )
    read = status.isin("current", "stale-current")
    rows = redact_secrets(rows.withColumn("status", status).withColumn("_text", F.when(read, c("_text"))), "_text")
    view = F.when(c("view") == "skeleton", C.view(c("_text"), "skeleton")).when(c("view") == "symbols", C.view(c("_text"), "symbols")).when(c("view") == "summary", C.view(c("_text"), "summary")).otherwise(c("_text"))
    rows = rows.withColumn("_whole", F.when(c("status") == "stored", c("stored")).when(c("status").isin("current", "stale-current"), view))
    cut = (c("status") != "stored") & (F.length("_whole") > most_chars) if most_chars is not None else F.lit(False)
    content = F.when(cut, F.rtrim(F.left("_whole", F.lit(most_chars)))).otherwise(c("_whole")) if most_chars is not None else c("_whole")
    warnings = F.when(c("status").isin("current", "stale-current"), c("warnings"))
    return rows.select("id", "status", c("r.block_id").alias("block_id"), "path", c("r.mode").alias("mode"), c("r.tokens").alias("tokens"), content.alias("content"), F.coalesce(cut, F.lit(False)).alias("truncated"), warnings.alias("warnings"))
