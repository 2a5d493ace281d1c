"""Timers and expiry in state, over streams that are stopped and started anew."""

import time

import pytest
from pyspark.sql import functions as F

from docloom.streaming.state import checked_codes, reminded, retried


class Running:
    """A query over a folder that rows are added to, with all that it has emitted so far."""

    def __init__(self, spark, tmp_path, schema, build):
        self.spark, self.schema, self.build = spark, schema, build
        self.source, self.sink, self.checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
        spark.createDataFrame([], schema).write.parquet(self.source)
        self.start()

    def start(self):
        stream = self.build(self.spark.readStream.schema(self.schema).parquet(self.source))
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.sink}/batch={number}")
        self.query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", self.checkpoint).trigger(processingTime="300 milliseconds").start()

    def add(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def rows(self):
        try:
            table = self.spark.read.option("recursiveFileLookup", "true").parquet(self.sink)
            return sorted(tuple(r) for r in table.collect())
        except Exception:  # nothing written yet, or a batch is just being replaced
            return []

    def until(self, wanted, seconds=60):
        end = time.time() + seconds
        while (got := self.rows()) != sorted(wanted) and time.time() < end:
            if self.query.exception():
                raise self.query.exception()
            time.sleep(0.3)
        assert got == sorted(wanted)


@pytest.fixture
def running(spark, tmp_path):
    started = []

    def run(schema, build):
        started.append(Running(spark, tmp_path, schema, build))
        return started[-1]

    yield run
    for r in started:
        r.query.stop()


JOBS = "document_id bigint, event_id bigint, event string, message string"


def test_retry_waits_in_state(running):
    """A failed job is tried again after the wait, though the query was stopped between the two tries."""
    q = running(JOBS, lambda s: retried(s, wait_seconds=8, retries=1))
    q.add((1, 1, "queued", None), (1, 2, "queued", None), (2, 3, "queued", None), (3, 4, "queued", None), (None, 5, "queued", None))
    first = [(1, 0, "try"), (2, 0, "try"), (3, 0, "try")]
    q.until(first)
    q.add((1, 6, "failed", "x"), (2, 7, "succeeded", None), (3, 8, "failed", "empty"))
    failed = time.time()
    ended = [*first, (2, 0, "indexed"), (3, 0, "error")]
    q.until(ended)
    q.query.stop()
    time.sleep(max(0.0, failed + 3 - time.time()))
    assert q.rows() == sorted(ended)
    q.start()
    q.until([*ended, (1, 1, "try")])
    assert time.time() - failed >= 8
    q.add((1, 9, "failed", "x"), (2, 10, "failed", "late"))
    q.until([*ended, (1, 1, "try"), (1, 1, "error")])


def test_codes_expire_in_the_store(running):
    q = running("account string, event_id bigint, event string, code string", lambda s: checked_codes(s, seconds=6))
    q.add(("a", 1, "issued", "111"), ("a", 2, "tried", "999"), ("a", 3, "tried", "111"), ("a", 4, "tried", "111"), ("b", 5, "issued", "222"), ("c", 6, "issued", "333"), ("c", 7, "issued", "334"))
    told = [("a", 2, False), ("a", 3, True), ("a", 4, False)]
    q.until(told)
    q.add(("c", 8, "tried", "333"), ("c", 9, "tried", "334"), ("d", 10, "tried", None))
    told += [("c", 8, False), ("c", 9, True), ("d", 10, False)]
    q.until(told)
    time.sleep(7)
    q.add(("b", 11, "tried", "222"))
    q.until([*told, ("b", 11, False)])


def test_reminders_once(running, spark):
    """Batches with a replayed one, a time that is moved, and a task that is done in time."""
    now = int(time.time() * 1000)
    soon, later = now + 25_000, now + 3_600_000
    q = running("task_id bigint, version bigint, remind_at bigint, done boolean", reminded)
    batch = [(1, 1, now - 5000, False), (2, 1, soon, False), (3, 1, later, False), (4, 1, soon, False), (5, 1, None, False), (6, 1, now - 5000, True)]
    q.add(*batch)
    q.until([(1, now - 5000)])
    q.add(*batch)
    q.add((1, 2, now - 5000, False), (3, 2, now - 100, False), (4, 2, soon, True))
    q.until([(1, now - 5000), (3, now - 100)])
    q.query.stop()
    q.start()
    q.until([(1, now - 5000), (2, soon), (3, now - 100)])
    q.add((1, 3, now - 4000, False), (2, 1, soon, False))
    q.until([(1, now - 5000), (1, now - 4000), (2, soon), (3, now - 100)])
    time.sleep(1)
    assert q.rows() == sorted([(1, now - 5000), (1, now - 4000), (2, soon), (3, now - 100)])
    assert spark.read.option("recursiveFileLookup", "true").parquet(q.sink).where(F.col("task_id").isin(4, 5, 6)).count() == 0
