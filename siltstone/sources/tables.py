"""Readers: Parquet tables, JSON lines with a schema, and documents as files of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import estimate_tokens

TOO_LARGE = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a log of JSON lines; lines that don't parse are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt")


def files(docs: DataFrame, ignored: tuple[str, ...] = (), too_large: int = TOO_LARGE) -> DataFrame:
    """path, language, size, tokens, hash and bucket (the first that fits of ignored, binary, too_large, packable)."""
    bucket = F.when(F.col("source").isin(*ignored), "ignored") if ignored else F.when(F.lit(False), "ignored")
    bucket = bucket.when(F.instr(F.substring("text", 1, 1024), "\0") > 0, "binary").when(estimate_tokens(F.col("text")) > too_large, "too_large").otherwise("packable")
    return docs.select(
        F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"),
        estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash"), bucket.alias("bucket"), "doc_id", "text",
    )
