"""Streams give what the same computation gives over the whole table."""

from pyspark.sql import functions as F

from docloom.streaming import jobs

DATA = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def drained(stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_windows(spark, tmp_path):
    source = str(tmp_path / "log")
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(source)
    whole = spark.read.parquet(source)
    log = lambda: jobs.read_log(spark, source, SCHEMA)
    drained(jobs.rate_limited(log(), "user_id", "ts", 1), "limited")
    assert rows(spark.table("limited")) == rows(jobs.rate_limited(whole, "user_id", "ts", 1))
    drained(jobs.tumbling(log()), "daily")
    assert rows(spark.table("daily")) == rows(jobs.tumbling(whole))
    drained(jobs.tumbling(log(), "1 day", "12 hours"), "sliding")
    assert rows(spark.table("sliding")) == rows(jobs.tumbling(whole, "1 day", "12 hours"))
    drained(jobs.sessions(log()), "sessions")
    assert rows(spark.table("sessions")) == rows(jobs.sessions(whole))


def test_queue(spark, tmp_path):
    source, done, retry = (str(tmp_path / n) for n in ("jobs", "done", "retry"))
    table = [(1, 1, 0), (1, 5, 0), (2, 2, 0), (3, 3, 2), (4, 4, 0)]
    spark.createDataFrame(table, "document_id bigint, seq bigint, attempt int").coalesce(1).write.parquet(source)

    def work(batch):
        message = F.when(F.col("document_id") == 4, "empty").when(F.col("document_id") > 1, "failed")
        return batch.withColumn("ok", F.col("document_id") == 1).withColumn("message", message)

    stream = spark.readStream.schema("document_id bigint, seq bigint, attempt int").parquet(source)
    jobs.run_queue(stream, work, done, retry, str(tmp_path / "cp")).awaitTermination(120)
    finished = {r["document_id"]: (r["status"], r["seq"]) for r in spark.read.parquet(done).collect()}
    assert finished == {1: ("indexed", 5), 3: ("error", 3), 4: ("error", 4)}
    assert [(r["document_id"], r["attempt"]) for r in spark.read.parquet(retry).collect()] == [(2, 1)]


def test_status(spark, tmp_path):
    source = str(tmp_path / "status")
    table = [(1, 1, "pending"), (1, 2, "processing_ocr"), (1, 3, "indexed"), (2, 1, "pending"), (2, 2, "indexed")]
    spark.createDataFrame(table, "document_id bigint, ts bigint, status string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("document_id bigint, ts bigint, status string").parquet(source)
    drained(jobs.follow_status(stream), "status", "update")
    assert {r["document_id"]: (r["status"], r["refused"]) for r in spark.table("status").collect()} == {1: ("indexed", 0), 2: ("pending", 1)}


def test_once(spark):
    due = spark.createDataFrame([(1,), (2,)], "task_id bigint")
    assert rows(jobs.send_reminders(due, due.where("task_id = 1"))) == [(2,)]
    codes = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS created_at")
    assert jobs.unexpired(codes, F.lit("2024-01-01 00:14:00").cast("timestamp")).count() == 1
    assert jobs.unexpired(codes, F.lit("2024-01-01 00:16:00").cast("timestamp")).count() == 0
