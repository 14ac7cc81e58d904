"""Threads and changed paths as streams: state by key, with a time-out, that equals the batch operators on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state of a thread and what an update tells of it; a time-out makes an active thread inactive.
STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
UPDATE = T.StructType([T.StructField("thread", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("active", T.BooleanType())])


def _row(thread: str, at: int, number: int, status: str | None, active: bool) -> pd.DataFrame:
    stamp = pd.Timestamp(at, unit="us")
    return pd.DataFrame({"thread": [thread], "ts": [stamp], "id": [number], "status": [status], "active": [active]})


def thread_updates(log: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Updates (thread, ts, id, status, active) of a stream of log rows (thread, ts, id, status), in update mode.

    A thread's state is its last row by time and id that isn't done: three values, whatever the number of its rows.  It is told whenever
    it changes, and told once more as inactive when the watermark passes its time by `hours`; then its state goes.  The last update of each
    thread is what `history.active_threads` finds in the same rows.  Rows without a thread or time, and done ones, are passed over.
    """

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (thread,) = key
        if state.hasTimedOut:
            at, number, status = state.get
            state.remove()
            yield _row(thread, at, number, status, False)
            return
        before = last = state.get if state.exists else None
        for frame in frames:
            newest = frame.sort_values(["at", "id"]).iloc[-1]
            found = (int(newest["at"]), int(newest["id"]), newest["status"])
            last = found if last is None or found[:2] > last[:2] else last
        if last is None:
            return
        state.update(last)
        ends = last[0] // 1000 + hours * 3_600_000 + 1
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
            if last != before:
                yield _row(thread, *last, True)
        else:  # it is over before it was told
            state.remove()
            yield _row(thread, *last, False)

    live = log.filter(~F.col("status").eqNullSafe("done") & F.col("thread").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = live.select("thread", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), "status")
    return rows.groupBy("thread").applyInPandasWithState(run, UPDATE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def path_batches(changes: DataFrame, quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(scope, start, end, paths, changes) of changed paths (scope, path, ts): a run of changes of a scope without a quiet time in it, told once.

    Paths have forward slashes and no space around; empty ones, and rows without a time, are passed over.  It works on a stream and on a table alike.
    """
    path = F.trim(F.replace("path", F.lit("\\"), F.lit("/")))
    rows = changes.withColumn("path", path).filter("path != '' and ts is not null").withWatermark("ts", late)
    runs = rows.groupBy(F.session_window("ts", quiet).alias("w"), "scope").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("changes"))
    return runs.select("scope", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "changes")
