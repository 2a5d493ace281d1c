"""Catalog reads: isolation by owner, optional filters, pages, counts and scope."""

from __future__ import annotations

from functools import reduce

from docloom.functions.text import normalize_lexical
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owned(df: DataFrame, owner: object, column: str = "owner_id") -> DataFrame:
    """Rows of one owner; every catalog read goes through this."""
    return df.where(F.col(column) == F.lit(owner))


def name_matches(column: str, search: str, regex: bool = False) -> Column:
    """Case-insensitive search in a name; as a literal, or as a regular expression where asked for."""
    return F.col(column).rlike(f"(?i){search}") if regex else F.contains(F.lower(column), F.lit(search.lower()))


def name_contains_unaccented(columns: list[str], search: str) -> Column:
    """Accent- and case-insensitive search in the joined names."""
    return F.contains(normalize_lexical(F.concat_ws(" ", *columns)), normalize_lexical(F.lit(search)))


def filter_documents(
    docs: DataFrame, status: str | None = None, archived: bool | None = None, search: str | None = None, folder: str | None = None, regex: bool = False
) -> DataFrame:
    """The conjunction of the given filters; the folder name 'unfiled' selects documents without one."""
    wanted = [F.lit(True)]
    if status is not None:
        wanted.append(F.col("status") == status)
    if archived is not None:
        wanted.append(F.col("archived") == archived)
    if search:
        wanted.append(name_matches("original_name", search, regex))
    if folder is not None:
        wanted.append(F.col("folder_id").isNull() if folder == "unfiled" else F.col("folder_id") == folder)
    return docs.where(reduce(lambda a, b: a & b, wanted))


def by_name(column: str, collation: str = "UTF8_BINARY") -> list[Column]:
    """Sort keys for names under an explicit collation, whatever the session's or the column's; ties in the order of bytes."""
    binary = F.collate(F.col(column), "UTF8_BINARY")
    return [binary] if collation == "UTF8_BINARY" else [F.collate(F.col(column), collation), binary]


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 20) -> DataFrame:
    """One page in the given total order; a page has at most 100 rows."""
    limit = max(1, min(limit, 100))
    return df.orderBy(*order).offset((max(1, number) - 1) * limit).limit(limit)


def page_meta(df: DataFrame, number: int = 1, limit: int = 20) -> DataFrame:
    """total, page, limit, pages, has_next and has_prev of a paged read."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.lit(number).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("page_limit"),
        F.ceil(total / limit).cast("bigint").alias("pages"),
        (F.lit(number * limit) < total).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )


def folder_counts(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """Each folder with the number of its documents that are not archived, 0 included."""
    counts = docs.where(~F.col("archived") & F.col("folder_id").isNotNull()).groupBy("owner_id", "folder_id").count()
    return folders.join(counts, ["owner_id", "folder_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def folders_matching(folders: DataFrame, docs: DataFrame, search: str) -> DataFrame:
    """Folders whose name matches, or that hold a document whose name does."""
    by_name = folders.where(name_matches("folder_id", search)).select("owner_id", "folder_id")
    by_document = docs.where(name_matches("original_name", search) & F.col("folder_id").isNotNull()).select("owner_id", "folder_id")
    return folders.join(by_name.union(by_document).distinct(), ["owner_id", "folder_id"], "left_semi")


def dashboard(docs: DataFrame) -> DataFrame:
    """Counts per owner in one pass: archived follows the flag, the others the status."""
    has = lambda *s: F.count_if(F.col("status").isin(*s))
    return docs.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total"),
        has("indexed").alias("indexed"),
        has("pending", "processing_ocr").alias("pending"),
        has("error").alias("errors"),
        F.count_if("archived").alias("archived"),
    )


def recent(docs: DataFrame, n: int = 5) -> DataFrame:
    """The n latest documents of each owner."""
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("doc_id")))
    return docs.withColumn("place", rank).where(F.col("place") <= n)


def scope(document: object = None, folder: object = None, dossier: object = None) -> tuple[str, object] | None:
    """The scope of a retrieval: a dossier overrides a folder, which overrides a document."""
    for name, value in (("dossier_id", dossier), ("folder_id", folder), ("document_id", document)):
        if value is not None:
            return name, value
    return None


def in_scope(chunks: DataFrame, docs: DataFrame, chosen: tuple[str, object] | None) -> DataFrame:
    """Chunks of the documents in a scope."""
    if chosen is None:
        return chunks
    name, value = chosen
    if name == "document_id":
        return chunks.where(F.col("document_id") == F.lit(value))
    return chunks.join(docs.where(F.col(name) == F.lit(value)).select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")


def with_names(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows with their document's name, null where the document is gone."""
    return rows.join(docs.select(F.col("doc_id").alias("document_id"), F.col("original_name").alias("document_name")), "document_id", "left")


def without_secrets(users: DataFrame) -> DataFrame:
    """Users without the columns that are never shown."""
    return users.drop("password_hash", "password_history", "otp_code", "otp_expires_at", "reset_code", "reset_expires_at", "__v")


def user_metrics(users: DataFrame) -> DataFrame:
    """total and verified users, with the share of the latter; deleted accounts are not kept and count 0."""
    total, verified = F.count(F.lit(1)), F.count_if("is_verified")
    rate = F.when(total > 0, F.floor(100 * verified / total + 0.5)).otherwise(0).cast("bigint")
    return users.agg(total.alias("total"), verified.alias("verified"), F.lit(0).cast("bigint").alias("deleted"), rate.alias("verified_rate"))
