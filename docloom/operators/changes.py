"""Changes to tables, as DataFrames of the new state; plain files have no update in place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from docloom.operators import versions
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Chunks that a bucket of the chunk index is meant to hold; with twice as many there will be more buckets.
BUCKET_ROWS = 500_000


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The table with new rows; missing columns take their default, or null."""
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, updates: DataFrame, key: str, emptied: Sequence[str] = ()) -> DataFrame:
    """Rows with the filled values of their update, by key; in the columns of `emptied` a null of the update counts too."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, F.lit(True).alias("__met"), *[F.col(c).alias(f"__new_{c}") for c in changed])
    joined = table.join(new, key, "left")
    value = lambda c: F.when(F.col("__met"), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in emptied else F.coalesce(f"__new_{c}", c)
    return joined.select(*[value(c).alias(c) if c in changed else F.col(c) for c in table.columns])


def unset(table: DataFrame, column: str, where: Column) -> DataFrame:
    """The table with a column emptied where the condition holds."""
    return table.withColumn(column, F.when(where, F.lit(None)).otherwise(F.col(column)))


def cascade(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose column names a deleted key."""
    gone = deleted.select(F.col(key).alias("__gone"))
    return {n: t.join(gone, t[c] == gone["__gone"], "left_anti") for n, (t, c) in tables.items()}


def append_to_array(table: DataFrame, column: str, item: Column, where: Column) -> DataFrame:
    """The table with an item added to an array column where the condition holds."""
    return table.withColumn(column, F.when(where, F.concat(F.coalesce(F.col(column), F.array()), F.array(item))).otherwise(F.col(column)))


def _bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All chunks of a version of the chunk index, the newest unless one is named, with their bucket; None if there is none."""
    found = versions.manifest(spark, path, version)
    if found is None:
        return None
    held: dict[str, list[int]] = {}
    for bucket, folder in found["held"].items():
        held.setdefault(folder, []).append(int(bucket))
    read = spark.read.schema(found["schema"])
    parts = [read.parquet(f"{path}/{folder}").where(F.col("bucket").isin(numbers)) for folder, numbers in sorted(held.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], found["schema"])


def _rewrite(spark: SparkSession, path: str, found: dict | None, buckets: int, rows: DataFrame, touched: list[int] | None) -> int:
    """Commit a version in which the touched buckets, or all, hold rows and the others stay where they are."""
    data = versions.fresh_folder(path, "chunks")
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(data)
    folder = "/".join(data.rsplit("/", 2)[1:])
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    counts = {str(r["bucket"]): r["count"] for r in spark.read.schema(schema).parquet(data).groupBy("bucket").count().collect()}  # one for each bucket
    old = {} if found is None or touched is None else {b: (f, found["rows"][b]) for b, f in found["held"].items() if int(b) not in set(touched)}
    held = {b: f for b, (f, _) in old.items()} | dict.fromkeys(counts, folder)
    contents = {"held": held, "rows": {b: n for b, (_, n) in old.items()} | counts, "folders": sorted(set(held.values())), "buckets": buckets, "schema": schema}
    return versions.commit(spark, path, contents, found["version"] if found else 0)


def overwrite_documents(fresh: DataFrame, path: str) -> int:
    """Write fresh chunks in place of all chunks of their documents, as a new version of the index at path; returns its number.

    Only the buckets of these documents are read and written, into a folder of their own; the manifest that
    names the folder of every bucket is renamed into place last, so a write that stops half-way, or meets
    another writer, leaves the version before it as it was. Buckets number with the chunks: when they hold
    twice BUCKET_ROWS on average all are dealt anew. A crowded bucket is split into files by adaptive execution.
    """
    spark = fresh.sparkSession
    found = versions.manifest(spark, path)
    added = fresh.count()
    held = sum(found["rows"].values()) if found else 0
    buckets = found["buckets"] if found else 0
    grown = held + added > 2 * buckets * BUCKET_ROWS
    if grown:
        buckets = max(1, -(-(held + added) // BUCKET_ROWS))
    rows, touched = _bucketed(fresh, max(1, buckets)), None
    if found:
        index = read_index(spark, path)
        if not grown:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
            index = index.where(F.col("bucket").isin(touched))
        kept = index.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
        rows = rows.unionByName(_bucketed(kept.drop("bucket"), buckets))
    return _rewrite(spark, path, found, max(1, buckets), rows, touched)


def remove_documents(gone: DataFrame, path: str) -> int:
    """Take all chunks of documents (document_id) out of the index, as a new version; returns its number."""
    spark = gone.sparkSession
    found = versions.manifest(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    touched = [r["bucket"] for r in _bucketed(gone.select("document_id"), found["buckets"]).select("bucket").distinct().collect()]
    index = read_index(spark, path).where(F.col("bucket").isin(touched))
    return _rewrite(spark, path, found, found["buckets"], index.join(gone.select("document_id").distinct(), "document_id", "left_anti"), touched)


def append(rows: DataFrame, path: str) -> bool:
    """Append to a log; a failure is reported, not raised, so that it never stops what is logged."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def restore(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Archived documents with the status they return to: indexed if they have chunks, error if they have a message, else pending."""
    have = chunks.select(F.col("document_id").alias("doc_id"), F.lit(True).alias("__has")).distinct()
    status = F.when(F.col("__has"), "indexed").when(F.col("error_message").isNotNull(), "error").otherwise("pending")
    joined = docs.join(have, "doc_id", "left")
    return joined.withColumn("status", F.when(F.col("archived"), status).otherwise(F.col("status"))).withColumn("archived", F.lit(False)).drop("__has")


def archive(docs: DataFrame, where: Column) -> DataFrame:
    """Documents with the archived flag and status where the condition holds."""
    return docs.withColumn("status", F.when(where, "archived").otherwise(F.col("status"))).withColumn(
        "archived", F.when(where, True).otherwise(F.col("archived"))
    )


def name_conflicts(candidates: DataFrame, existing: DataFrame, owner: str = "owner_id", name: str = "name") -> DataFrame:
    """Candidates whose trimmed, lower-case name their owner has already."""
    key = F.lower(F.trim(F.col(name)))
    taken = existing.select(F.col(owner).alias("__owner"), key.alias("__key")).distinct()
    return candidates.join(taken, (F.col(owner) == F.col("__owner")) & (key == F.col("__key")), "left_semi")


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the first broken rule's message)."""
    message = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()])
    judged = rows.withColumn("error", message)
    return judged.where("error is null").drop("error"), judged.where("error is not null")


def first_broken(requests: DataFrame, docs: DataFrame, folders: DataFrame, steps: DataFrame) -> DataFrame:
    """Requests to change documents with `error`, the first rule that each breaks, null where all hold.

    requests: request_id, actor_id, doc_id, status, folder_id, with null for what is not to change and a blank
    folder_id for none; docs: doc_id, owner_id, status; folders: owner_id, folder_id; steps: old, new, the
    statuses that may follow each other. The rules in order: the document exists, is the actor's, the status is
    known, may follow the present one, and the folder is one of the owner's. Each table is joined once, by key.
    """
    have = docs.select("doc_id", F.col("owner_id").alias("__owner"), F.col("status").alias("__old")).dropDuplicates(["doc_id"])
    known = steps.select(F.col("new").alias("status"), F.lit(True).alias("__known")).distinct()
    allowed = steps.select(F.col("old").alias("__old"), F.col("new").alias("status"), F.lit(True).alias("__step")).distinct()
    own = folders.select(F.col("owner_id").alias("__owner"), F.col("folder_id"), F.lit(True).alias("__folder")).distinct()
    told = requests.join(have, "doc_id", "left").join(known, "status", "left").join(allowed, ["__old", "status"], "left").join(own, ["__owner", "folder_id"], "left")
    rules = {
        "not_found: Document": F.col("__owner").isNotNull(),
        "forbidden": F.col("__owner") == F.col("actor_id"),
        "invalid: status": F.col("status").isNull() | F.col("__known"),
        "invalid: step": F.col("status").isNull() | F.col("__step"),
        "not_found: Folder": F.col("folder_id").isNull() | (F.trim("folder_id") == "") | F.col("__folder"),
    }
    message = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()])
    return told.select(*requests.columns, message.alias("error"))


def latest_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__rank = 1").drop("__rank")
