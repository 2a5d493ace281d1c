"""Search by the lexical index against the scan of all texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical_index
from docloom.operators.lexical_index import build_lexical_index, candidates
from docloom.plans.retrieval import indexed_scores, lexical_scores
from tests.test_vectors import read_rows

TEXTS = [(1, "Report", "The student's name is Élodie"), (2, None, "nom: X"), (3, "c", None), (4, None, None), (5, "zebra", "ends in ce"), (6, "c", "e"), (7, "", "student " * 4000), (8, "naïve", "Étudiante"),
         (8, "twice", "the name again"), (None, "name", "no id"), (9, "über", "漢字 name\0 x"), (10, "x", "na me")]
ASKED = [(1, "What is the name of the student?"), (2, "nom ce"), (3, "zebra quagga"), (4, "the of and"), (5, ""), (6, None)]


@pytest.fixture
def tables(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id bigint, name string, text string")
    return chunks, spark.createDataFrame(ASKED, "query_id bigint, query string")


def rows(df):
    return sorted(str((r["query_id"], r["chunk_id"], round(r["score"], 9))) for r in df.collect())


@pytest.mark.parametrize("shelf_rows", [100_000, 2])
def test_scores_of_the_scan(spark, tables, tmp_path, monkeypatch, shelf_rows):
    monkeypatch.setattr(lexical_index, "SHELF_ROWS", shelf_rows)
    chunks, asked = tables
    build_lexical_index(chunks, str(tmp_path))
    want = rows(lexical_scores(chunks.where("chunk_id is not null"), asked))
    assert rows(indexed_scores(spark, str(tmp_path), asked)) == want and len(want) > 8


def test_nothing_to_find(spark, tables, tmp_path):
    chunks, asked = tables
    with pytest.raises(FileNotFoundError):
        indexed_scores(spark, str(tmp_path), asked)
    assert build_lexical_index(chunks.where("false"), str(tmp_path)) == 1
    assert indexed_scores(spark, str(tmp_path), asked).collect() == []
    assert build_lexical_index(chunks, str(tmp_path)) == 2
    assert indexed_scores(spark, str(tmp_path), asked.where("query_id > 3")).collect() == []


def test_only_candidate_texts_are_read(spark, tmp_path, monkeypatch):
    """Of 64 shelves a rare word opens one, and of the postings only those of its pieces."""
    monkeypatch.setattr(lexical_index, "SHELF_ROWS", 50)
    chunks = spark.range(3200).select(F.col("id").alias("chunk_id"), F.lit("n").alias("name"), F.when(F.col("id") == 77, "a quagga here").otherwise(F.concat(F.lit("common words "), F.col("id").cast("string"))).alias("text"))
    build_lexical_index(chunks, str(tmp_path))
    pairs, texts = candidates(spark, str(tmp_path), spark.createDataFrame([(1, "quagga")], "query_id bigint, word string"))
    assert [tuple(r)[:2] for r in pairs.collect()] == [(1, 77)]
    found = indexed_scores(spark, str(tmp_path), spark.createDataFrame([(1, "quagga")], "query_id bigint, query string"))
    assert [r["chunk_id"] for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan or "EqualTo(gram" in plan or "PushedFilters: [In(gram" in plan
    postings = spark.read.parquet(f"{tmp_path}/postings/*").count()
    assert 0 < read_rows(found) <= postings + 3200 / 10


def test_packed_postings(monkeypatch):
    """Rows of packed postings hold each (gram, text) once, in whatever blocks and gaps of ids; letters of all planes, too."""
    table = [(1, 0, "aab"), (-(1 << 62), 0, "ab"), ((1 << 62) + 5, 0, "ab"), (300, 0, "xab"), (300, 0, "ab"), (7, 1, "ab\0"), (9, 1, ""), (70_000, 1, "é😀ab"), (1 << 40, 1, "漢ab")]
    for letters, as_one in ((1 << 21, 1 << 62), (5, 1 << 62), (1 << 21, 100)):
        monkeypatch.setattr(lexical_index, "BLOCK_LETTERS", letters)
        monkeypatch.setattr(lexical_index, "_AS_ONE", as_one)
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in table]), pa.array([r[1] for r in table], pa.int32()), pa.array([r[2] for r in table])], ["chunk_id", "shelf", "t"])
        packed = [b for b in lexical_index._posting_rows([batch.slice(0, 4), batch.slice(4)])]
        got = [tuple(r.values()) for b in lexical_index._unpacked(packed) for r in b.to_pylist()]
        want = {(c, s, k, (t + "\0\0")[at : at + 3]) for k, (c, s, t) in enumerate(table) for at in range(len(t))}
        assert sorted(got) == sorted((g, s, c) for c, s, _, g in want)


def test_few_rows_are_shuffled(spark, tmp_path):
    """A gram's texts are one row for each block and not a row each; texts are not dealt by the few queries that ask for them."""
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.lit("n").alias("name"), F.concat(F.lit("the name of a student "), F.col("id").cast("string")).alias("text"))
    build_lexical_index(chunks.coalesce(2), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings/*").count() < 2000 * 24 / 5
    found = indexed_scores(spark, str(tmp_path), spark.createDataFrame(ASKED, "query_id bigint, query string"))
    assert found.count() == 4000
    texts = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "query_id" in texts[0] and "rightHint=(strategy=broadcast)" in texts[0]
