"""Stateful behaviour as streams: job queue, retries, status, reminders, rate limits and windows over the audit log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from docloom.operators.changes import latest_per_key
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calls allowed in a window, by kind, and the tries of a job with the wait between them.
LIMITS = {"general": 100, "auth": 10, "ai": 20}
WINDOW = "15 minutes"
TRIES = 3
RETRY_SECONDS = 5.0


def rate_limited(calls: DataFrame, key: str, time: str, limit: int) -> DataFrame:
    """Keys and fixed windows with more calls than the limit; calls may be a stream with a watermark."""
    counted = calls.groupBy(key, F.window(time, WINDOW).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")


def read_log(spark: SparkSession, path: str, schema: str, lateness: str = "1 hour", time: str = "ts") -> DataFrame:
    """The audit log as a stream; events later than the lateness may be left out of windows."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, lateness)


def tumbling(log: DataFrame, length: str = "1 day", slide: str | None = None, time: str = "ts") -> DataFrame:
    """Counts by action in fixed or sliding windows (an extension over the reference)."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return log.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Sessions of each user (an extension over the reference)."""
    w = F.session_window(time, gap)
    return log.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def queue_batch(jobs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(finished, to be tried again) of one micro-batch of (document_id, seq, attempt).

    A document queued twice is worked once, at its later place. work returns the jobs with
    ok and message; a failed job goes back with its attempt counted until TRIES, then ends
    in status error; a job without text ends at once.
    """
    done = work(latest_per_key(jobs, "document_id", F.col("seq")))
    ends = (F.col("attempt") >= TRIES) | (F.col("message") == "empty")
    judged = done.withColumn("attempt", F.col("attempt") + 1).withColumn(
        "status", F.when(F.col("ok"), "indexed").when(F.coalesce(ends, F.lit(False)), "error").otherwise("pending")
    )
    return judged.where("status <> 'pending'"), judged.where("status = 'pending'").select("document_id", "seq", "attempt")


def run_queue(stream: DataFrame, work: Callable[[DataFrame], DataFrame], done_path: str, retry_path: str, checkpoint: str):
    """Work a stream of jobs in micro-batches; finished and returned jobs are written under the batch's number,
    so that a batch that is run again after a failure replaces what it wrote before."""

    def one(batch: DataFrame, number: int) -> None:
        finished, again = queue_batch(batch, work)
        finished.write.mode("overwrite").parquet(f"{done_path}/batch={number}")
        again.write.mode("overwrite").parquet(f"{retry_path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The statuses that may follow a status.
NEXT_STATUS = {
    None: ("pending",),
    "pending": ("processing_ocr", "archived"),
    "processing_ocr": ("indexed", "error", "pending"),
    "indexed": ("pending", "archived"),
    "error": ("pending", "archived"),
    "archived": ("indexed", "error", "pending"),
}


def follow_status(events: DataFrame) -> DataFrame:
    """Latest status of each document over a stream of (document_id, ts, status); steps that the
    status machine does not know are counted and not taken."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        status, refused = state.get if state.exists else (None, 0)
        for new in pd.concat(list(frames)).sort_values("ts", kind="stable")["status"]:
            if new in NEXT_STATUS.get(status, ()):
                status = new
            else:
                refused += 1
        state.update((status, refused))
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "refused": [refused]})

    return events.groupBy("document_id").applyInPandasWithState(
        step, "document_id bigint, status string, refused bigint", "status string, refused bigint", "update", GroupStateTimeout.NoTimeout
    )


def send_reminders(due: DataFrame, sent: DataFrame) -> DataFrame:
    """Due reminders that were not sent before; the sent table is keyed by task, so sending is repeatable."""
    return due.join(sent.select("task_id"), "task_id", "left_anti")


def unexpired(codes: DataFrame, now, minutes: int = 15) -> DataFrame:
    """One-time codes within their minutes."""
    return codes.where(F.col("created_at") + F.make_dt_interval(mins=F.lit(minutes)) > now)
