"""The corpus pipeline: five stages from raw documents to packed training sequences.

Defined results, of `run` and of each stage: a null text counts as empty, is kept by every filter and
packed as its end alone; a null id is an id like any other. Rows that repeat id and text are one
document for the SimHash stage, which keeps one of them; rows that share an id and differ in text are
documents of their own. Very long texts go whole through every stage, each in the task that holds it.
Columns besides DOCUMENT_COLUMNS are left out by the first stage, whatever their names. An empty table
gives no rows; without labels, or without benchmark items, nothing is filtered for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, release
from docloom.llm.decontaminate import drop_contaminated
from docloom.llm.packing import pack_documents
from docloom.llm.pii import redacted_text
from docloom.llm.simhash import drop_near_duplicates
from docloom.llm.toxicity import fit_toxicity, toxicity_score
from docloom.session import read_table

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    docs = docs.select(DOCUMENT_COLUMNS)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(model, F.col("text")) < 0.5)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return drop_near_duplicates(docs.select(DOCUMENT_COLUMNS))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no test item."""
    return drop_contaminated(docs.select(DOCUMENT_COLUMNS), read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced and n_chars counted anew."""
    clean = docs.select("doc_id", redacted_text(F.col("text")).alias("text"), "lang", "source")
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: No stage but the counts of rows can be put in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each kept as a table in the shared folder until the next has been."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
