"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import oracles
from docloom.llm.alignment import align_tokens
from docloom.llm.byte_dups import remove_repeated_bytes
from docloom.llm.decontaminate import decontamination
from docloom.llm.edit_counts import edit_token_counts, redaction_edits
from docloom.llm.html_text import extract_pages
from docloom.llm.lm_scores import score_texts
from docloom.llm.negatives import hard_negatives
from docloom.llm.packing import pack_documents
from docloom.llm.pii import find_pii
from docloom.llm.simhash import simhash_groups
from docloom.llm.substrings import remove_repeated_windows
from docloom.llm.toxicity import fit_toxicity, score_toxicity
from docloom.llm.vector_dups import vector_groups
from docloom.session import read_table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by two passes of block rules."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all vectors linked at a cosine of 0.9 or more."""
    return vector_groups(read_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose SimHash fingerprints differ in two bits at most."""
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that each document covers to 0.8 or more."""
    return decontamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without repeated windows of 35 words."""
    return remove_repeated_windows(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base patterns and what boosted trees add."""
    return find_pii(read_table(spark, sf_dir, "documents")).drop("redacted")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits as a corpus gets them: a language mark in front and personal data masked."""
    mark = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.concat(F.lit("["), F.coalesce("lang", F.lit("?")), F.lit("] ")).alias("text"))
    edits = F.concat(F.array(mark), redaction_edits(F.col("text")))
    return edit_token_counts(read_table(spark, sf_dir, "documents"), edits)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without later copies of 100-byte strings."""
    return remove_repeated_bytes(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2,048 tokens as best-fit decreasing finds."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the byte-level and the piece tokens of every document stand to each other."""
    return align_tokens(read_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id 100 divides; every seventh id has its label moved on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("is_anchor")))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document; a fifth of them, by the remainder of their id's checksum, is held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("held_out")))


QUERIES = {
    "op1_html": op1_html,
    "op2_embeddings": op2_embeddings,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_substrings": op5_substrings,
    "op6_pii": op6_pii,
    "op7_edit_counts": op7_edit_counts,
    "op8_suffixes": op8_suffixes,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_negatives": op12_negatives,
    "op13_lm_scores": op13_lm_scores,
}
#: The others cannot be put in SQL; tests hold them against brute force, exact round trips or held-out labels.
ORACLES: dict[str, str] = {
    "op2_embeddings": oracles.VECTOR_GROUPS,
    "op5_substrings": oracles.REPEATED_WINDOWS,
    "op8_suffixes": oracles.REPEATED_BYTES,
    "op12_negatives": oracles.HARD_NEGATIVES,
}
