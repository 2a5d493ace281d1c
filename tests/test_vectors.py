"""Exact and indexed search for nearest vectors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.vectors import cosine
from docloom.operators import nearest as exact
from docloom.operators import versions
from docloom.operators.nearest import nearest
from docloom.operators.vector_index import NO_CELL, build_index, indexed_rows, search_index

DATA = "/root/testdata/sf0.01"
CHUNKS = "chunk_id bigint, document_id bigint, embedding array<float>"


def chunks_of(spark, matrix):
    return spark.createDataFrame([(i, i % 7, [float(x) for x in v]) for i, v in enumerate(matrix)], CHUNKS).repartition(4).cache()


def queries_of(chunks, every):
    return chunks.where(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))


def slowly(chunks, queries, k):
    """Every pair by the column expression."""
    pairs = chunks.crossJoin(queries).withColumn("score", F.round(cosine("embedding", "q"), exact.PLACES))
    return exact.ranked(pairs, k).select("query_id", "rank", "chunk_id", "document_id", "score")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def recall(found, true):
    found, true = ({(r["query_id"], r["chunk_id"]) for r in df.collect()} for df in (found, true))
    return len(found & true) / len(true)


def read_rows(df):
    """Rows that the parquet scans of an executed plan have read."""
    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(plan.plan())
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan] if not children else [x for c in children for x in leaves(c)]

    scans = [p for p in leaves(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "FileSourceScanExec"]
    return sum(p.metrics().apply("numOutputRows").value() for p in scans)


@pytest.mark.parametrize("row_block, query_block", [(4096, 256), (16, 3)])
def test_blocks_give_the_rows_of_all_pairs(spark, monkeypatch, row_block, query_block):
    monkeypatch.setattr(exact, "ROW_BLOCK", row_block)
    monkeypatch.setattr(exact, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(1)
    plain = chunks_of(spark, rng.normal(size=(120, 6)))
    odd = spark.createDataFrame([(200, None, None), (201, 1, []), (202, 1, [0.0] * 6), (203, 1, [1.0, 2.0]), (204, 1, [1.0] * 6), (204, 2, [1.0] * 6), (205, 1, [1.0] * 6)], CHUNKS)
    chunks = plain.union(odd)
    asked = queries_of(plain, 10).union(spark.createDataFrame([(900, [1.0] * 6), (901, [0.0] * 6), (902, None), (903, [1.0, 2.0])], "query_id bigint, q array<float>"))
    got, want = rows(nearest(chunks, asked, 7)), rows(slowly(chunks, asked, 7))
    cut = lambda rs: sorted((r[0], r[1], r[2], r[4]) for r in rs)  # noqa: E731  the two rows with id 204 may change places
    assert cut(got) == cut(want)


def test_odd_vectors(spark):
    odd = spark.createDataFrame([(1, 1, [float("nan"), 1.0]), (2, 1, [float("inf"), 1.0]), (3, 1, [None, 1.0]), (4, 1, [1e38, 1e38]), (None, 1, [1.0, 1.0])], CHUNKS)
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (None, [1.0, 1.0])], "query_id bigint, q array<float>")
    assert [(r["chunk_id"], r["score"]) for r in nearest(odd, asked, 9).orderBy("rank").collect()] == [(4, 1.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    assert nearest(odd.where("false"), asked, 3).collect() == [] and nearest(odd, asked.where("false"), 3).collect() == []


def test_no_row_for_each_pair(spark):
    emb = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = nearest(emb, queries_of(emb, 50), 5)
    found.collect()
    assert "aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().lower().split("window")[-1]


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clustered", "spread"])
def test_index_recall_and_rows_read(spark, tmp_path, kind):
    matrix = clustered(2500, 24, 40, 4) if kind == "clustered" else np.random.default_rng(4).normal(size=(2500, 24))
    chunks, path = chunks_of(spark, matrix), str(tmp_path / "index")
    assert build_index(chunks, path) == 1
    asked = queries_of(chunks, 50)
    assert indexed_rows(spark, path).count() == 2500
    assert recall(search_index(spark, path, asked, 10), nearest(chunks, asked, 10)) >= 0.9
    for one in (0, 1200):
        found = search_index(spark, path, asked.where(F.col("query_id") == one), 10)
        assert found.collect()[0]["chunk_id"] == one
        assert 0 < read_rows(found) < 2500 / 5


def test_scope_is_applied_before(spark, tmp_path):
    chunks, path = chunks_of(spark, clustered(700, 8, 10, 2)), str(tmp_path / "index")
    build_index(chunks, path)
    asked, scope = queries_of(chunks, 100), spark.createDataFrame([(3,), (5,)], "document_id bigint")
    found = search_index(spark, path, asked, 10, scope=scope)
    true = nearest(chunks.join(scope, "document_id", "left_semi"), asked, 10)
    assert {r["document_id"] for r in found.collect()} <= {3, 5} and found.count() == true.count() and recall(found, true) >= 0.9


def test_exact_search_on_failure(spark, tmp_path):
    chunks = chunks_of(spark, clustered(200, 8, 4, 3))
    asked = queries_of(chunks, 20)
    assert rows(search_index(spark, str(tmp_path / "none"), asked, 5, chunks)) == rows(nearest(chunks, asked, 5))
    with pytest.raises(FileNotFoundError):
        search_index(spark, str(tmp_path / "none"), asked, 5)
    path = str(tmp_path / "broken")
    build_index(chunks, path)
    os.rename(f"{path}/centres", f"{path}/lost")
    assert rows(search_index(spark, path, asked, 5, chunks)) == rows(nearest(chunks, asked, 5))


def test_index_of_odd_rows_and_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    odd = spark.createDataFrame([(1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0]), (4, 1, [1.0, 2.0, 3.0]), (5, 1, [1.0, float("nan")]), (6, 2, [1.0, 0.0]), (7, 2, [0.0, 1.0]), (7, 2, [0.0, 1.0])], CHUNKS)
    build_index(odd, path)
    assert indexed_rows(spark, path).count() == 8 and indexed_rows(spark, path).where(F.col("cell") == NO_CELL).count() == 5
    asked = spark.createDataFrame([(1, [0.0, 2.0]), (2, None)], "query_id bigint, q array<float>")
    assert [r["chunk_id"] for r in search_index(spark, path, asked, 2).where("query_id = 1").orderBy("rank").collect()] == [7, 7]
    monkeypatch.setattr(versions, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        build_index(odd.where("chunk_id = 6"), path)
    monkeypatch.undo()
    assert versions.versions(spark, path) == [1] and indexed_rows(spark, path).count() == 8
    assert build_index(odd.where("false"), path) == 2 and search_index(spark, path, asked, 2).count() == 0
    assert len(versions.vacuum(spark, path, keep=1)) == 4 and indexed_rows(spark, path).count() == 0


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.manifest(spark, path) is None and versions.commit(spark, path, {"folders": []}, 0) == 1
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, {"folders": ["x"]}, 0)
    assert versions.manifest(spark, path) == {"folders": [], "version": 1}


def test_batches_of_blocks(spark):
    """A worker is given a few pairs of blocks at a time, whatever their number, and not as many as a batch has rows."""
    import pyarrow as pa
    from docloom.operators import nearest as exact

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    largest = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), *[pa.array([0], pa.int64())] * 2, pa.array([0.0])], ["query_id", "chunk_id", "document_id", "score"]) for b in batches)
    seen = []
    try:
        rows = spark.range(30_000).selectExpr("id AS chunk_id", "id AS document_id", "transform(sequence(1, 64), x -> cast(hash(id, x) AS float)) AS embedding").coalesce(1)
        queries = rows.where("chunk_id < 3000").selectExpr("chunk_id AS query_id", "embedding AS q")
        original, exact.ranked = exact.ranked, lambda found, k: seen.append(found) or original(found, k)
        try:
            exact.nearest(rows, queries, 5, search=lambda k: largest)
        finally:
            exact.ranked = original
        assert max(r["query_id"] for r in seen[0].collect()) < 4 * exact.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
