"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of an Arrow batch, unless the session says otherwise: whole texts are long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode alone, where all is one machine, a temporary one if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, so a lost executor costs no rework before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow in small batches: Spark's default of 10,000 rows is kept off the heap several times over.

    Spark plans the size of a batch when the plan runs, so the session keeps the smaller one; a size that the
    caller has set stays.
    """
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)
