"""Streams of threads and changed paths against the batch operators on the same rows."""

from datetime import datetime

from pyspark.sql import functions as F

from siltstone.operators.history import active_threads
from siltstone.streaming import threads as H


def _at(hour, minute=0, second=0, day=1):
    return datetime(2024, 1, day, hour, minute, second)


def _run(spark, tmp_path, batches, schema, make, mode):
    """All rows that a stream gives for batches that arrive as files, one after the other, each time from where it stopped."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        told = make(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
        told.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_thread_state_equals_the_batch(spark, tmp_path):
    schema = "thread string, ts timestamp, id long, status string"
    batches = [
        [("a", _at(1), 1, "active"), ("b", _at(1), 2, "active"), ("b", _at(1), 3, "blocked"), (None, _at(2), 4, "active"), ("c", _at(2), 5, "done")],
        [("a", _at(5), 6, "done"), ("a", _at(0, 30), 7, "active"), ("d", _at(6), 8, None), ("e", None, 9, "active")],
        [("f", _at(3, day=2), 10, "active")],
        [("b", _at(4, day=2), 11, "active")],
    ]
    told = _run(spark, tmp_path, batches, schema, H.thread_updates, "update")
    last = {}
    for r in sorted(told, key=lambda r: (r.ts, r.id, not r.active)):
        last[r.thread] = r
    # a went a day after its time: hour 3 of the next day, less an hour for what is late, has passed it; done rows don't count
    assert {t: (r.id, r.active) for t, r in last.items()} == {"a": (1, False), "b": (11, True), "d": (8, True), "f": (10, True)}
    assert ("b", 3, False) in {(r.thread, r.id, r.active) for r in told}
    log = spark.createDataFrame([r for rows in batches for r in rows], schema)
    now = F.lit(_at(3, day=2)).cast("timestamp")
    assert {t for t, r in last.items() if r.active} == {r.thread for r in active_threads(log, now).collect()}
    assert {(r.thread, r.id) for r in last.values() if r.active} == {(r.thread, r.id) for r in active_threads(log, now).collect()}


def test_changed_paths_wait_for_quiet(spark, tmp_path):
    schema = "scope string, path string, ts timestamp"
    first = [("x", "a\\b.py", _at(1, 0, 0)), ("x", " a/c.py ", _at(1, 0, 1)), ("x", "a/b.py", _at(1, 0, 2)), ("x", "a/d.py", _at(1, 0, 9)), ("y", "", _at(1)), ("y", "q", _at(1)), ("y", "r", None)]
    rows = _run(spark, tmp_path, [first, [("z", "end", _at(9))], [("z", "end", _at(10))]], schema, H.path_batches, "append")
    want = {("x", ("a/b.py", "a/c.py"), 3), ("x", ("a/d.py",), 1), ("y", ("q",), 1)}
    assert {(r.scope, tuple(r.paths), r.changes) for r in rows if r.scope != "z"} == want
    batch = H.path_batches(spark.createDataFrame(first, schema)).collect()
    assert {(r.scope, tuple(r.paths), r.changes) for r in batch} == want
