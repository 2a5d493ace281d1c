"""The pipeline's stages on small documents, and its registration."""

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import pii
from docloom.llm.registry import QUERIES
from tests.llm.test_text_operators import print_of

DATA = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000)
    odd = spark.createDataFrame([(20_000, None, "en", "s", None), (20_001, "", "en", "s", 0), (20_002, "mail me at x@y.com", "en", "s", 18)], docs.schema)
    docs = docs.unionByName(extra).unionByName(odd).withColumn("score", F.lit(1))
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == corpus_pipeline.DOCUMENT_COLUMNS
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        new = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "simhash":
            prints = {}
            for d in sorted(old):
                prints.setdefault(print_of(old[d]), d)
            assert set(new) <= set(prints.values()) and 10_000 not in new
        elif name == "decontamination":
            leaked = {d for d, t in old.items() if any(b in (t or "") for b in bench.values())}
            assert leaked and not leaked & set(new) and len(new) > 0.9 * len(old)
        elif name == "pii":
            assert set(new) == set(old) and "<email>" in new[20_002]
            assert not any(any(pii.base_spans(t).values()) for t in new.values() if t)
            assert after.where("n_chars <> length(text)").count() == 0
        else:
            assert len(new) > 0.8 * len(old)
        before = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_oracles(spark):
    """The queries that have SQL give its rows."""
    import duckdb

    from docloom.llm.registry import ORACLES

    duck = duckdb.connect()
    for name in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, DATA)
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(map(str, got.select(columns).collect())) == sorted(str(spark_row(columns, r)) for r in want.fetchall()), name


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))


def test_empty_documents(spark):
    """Empty tables go through operators and stages that fit or join."""
    from docloom.llm import decontaminate, edit_counts, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.where("false"))).count() == 0
    assert decontaminate.decontamination(docs, bench).count() == 0
    assert edit_counts.edit_token_counts(docs, edit_counts.redaction_edits(F.col("text"))).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_columns_that_clash(spark):
    """Columns of the names that the decontamination joins by stay as they are."""
    from docloom.llm.decontaminate import drop_contaminated

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaked = bench.orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, leaked, "a"), (2, "clean words and nothing else in it", "b"), (3, None, "c")], "doc_id bigint, text string, k1 string")
    for name in ("k2", "__k1", "__k2", "item", "item_id", "share", "plain", "seed"):
        docs = docs.withColumn(name, F.lit("x"))
    got = drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["k1"], r["__k1"]) for r in got.collect()) == [(2, "b", "x"), (3, "c", "x")]


def test_run_keeps_one_table_of_the_stages(spark, tmp_path, monkeypatch):
    """Of the tables between the stages only the last is left when the result is returned."""
    import os
    import uuid

    monkeypatch.setattr("docloom.llm.common.shared_folder", lambda spark: f"{tmp_path}/docloom-{uuid.uuid4().hex}")
    assert corpus_pipeline.run(spark, DATA).count() > 0
    left = [n for d in os.listdir(tmp_path) for n in os.listdir(tmp_path / d)]
    assert {n for n, _ in corpus_pipeline.STAGES} & set(left) == {"pii"}
