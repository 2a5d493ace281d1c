"""Registration of queries with their oracle SQL, and the views that tie operators to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from docloom.session import read_table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: The catalog's documents over the test tables: owner is source, folder is lang, a labelled document is indexed.
CATALOG_SQL = """
    SELECT d.doc_id, d.source AS owner_id, CASE WHEN d.lang = 'es' THEN NULL ELSE d.lang END AS folder_id,
           'doc_' || CAST(d.doc_id AS VARCHAR) AS original_name, d.n_chars AS size, d.n_chars > 8000 AS archived,
           CASE WHEN d.n_chars > 8000 THEN 'archived' WHEN l.doc_id IS NOT NULL THEN 'indexed'
                WHEN d.n_chars < 400 THEN 'error' ELSE 'pending' END AS status
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the catalog: doc_id, owner_id, folder_id, original_name, size, archived, status."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    indexed = read_table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("indexed")).distinct()
    status = (
        F.when(F.col("n_chars") > 8000, "archived").when(F.col("indexed"), "indexed").when(F.col("n_chars") < 400, "error").otherwise("pending")
    )
    return docs.join(indexed, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("owner_id"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("folder_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("original_name"),
        F.col("n_chars").alias("size"),
        (F.col("n_chars") > 8000).alias("archived"),
        status.alias("status"),
    )


#: Planner tasks over orders.
TASKS_SQL = """
    SELECT o_orderkey AS task_id, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
           strftime(o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)), '%Y-%m-%d') AS end_date, o_orderstatus = 'F' AS completed,
           CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 'high'
                WHEN o_orderpriority LIKE '3-%' THEN 'medium' ELSE 'low' END AS priority,
           CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS category
    FROM orders"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner tasks: task_id, user_id, start_date, end_date (text), completed, priority, category."""
    o = read_table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    level = F.substring("o_orderpriority", 1, 2)
    return o.select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("user_id"),
        F.date_format(day, "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.date_add(day, (F.col("o_orderkey") % 30).cast("int")), "yyyy-MM-dd").alias("end_date"),
        (F.col("o_orderstatus") == "F").alias("completed"),
        F.when(level.isin("1-", "2-"), "high").when(level == "3-", "medium").otherwise("low").alias("priority"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("category"),
    )
