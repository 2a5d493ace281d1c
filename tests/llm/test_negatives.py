"""Hard negatives against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import negatives
from docloom.llm.negatives import Block, hard_negatives, integer_vectors, interval_search, sliced

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def slowly(rows):
    """All products of all anchors, sorted whole."""
    kept = []
    for r, (vec_id, label, vector) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        q = [int(np.floor(256 * x)) for x in vector]
        if sum(x * x for x in q) < 1 << 52:
            kept.append((r, vec_id, label, q))
    out = []
    for r, vec_id, label, q in kept:
        if vec_id is None or vec_id % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i is None, i or 0, s, i, lab) for s, i, lab, p in kept if s != r and len(p) == len(q))
        for positive in [x for x in scored if x[5] == label][:5]:
            fits = [x for x in scored if x[5] != label and -80 * positive[0] <= -100 * x[0] <= -100 * positive[0]][:5]
            out += [(vec_id, positive[4], n + 1, x[4], -positive[0], -x[0]) for n, x in enumerate(fits)]
    return sorted(map(str, out))


def mined(df):
    got = hard_negatives(df.withColumn("is_anchor", F.col("vec_id") % 100 == 0))
    return sorted(str((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])) for r in got.collect())


def vectors(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    return [(int(i), int(lab), (0.6 * centres[(lab + (i % 3 == 0)) % labels] + rng.normal(size=dim)).tolist()) for i, lab in enumerate(rng.integers(0, labels, n))]


@pytest.mark.parametrize("rows_at_once, anchors_at_once", [(4096, 256), (64, 3)])
def test_clustered_rows(spark, monkeypatch, rows_at_once, anchors_at_once):
    rows = vectors(900, 12, 3)
    blocks = integer_vectors(np.array([r[2] for r in rows]))[0]
    assert sliced(blocks)[0] >= 9
    monkeypatch.setattr(negatives, "ROW_BLOCK", rows_at_once)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", anchors_at_once)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == slowly(rows) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, 1, None), (200, None, [1.0, 0.0]), (300, 1, [nan, 1.0]), (400, 1, [inf, 1.0]), (500, 1, [None, 1.0]), (600, 1, [1e300, 1.0]), (None, 1, [1.0, 0.0]),
           (None, 2, [0.9, 0.1]), (0, 1, [1.0, 0.1]), (0, 1, [1.0, 0.1]), (1, 1, [1.0, 0.1]), (2, 2, [1.0, 0.1]), (2, 2, [1.0, 0.1]), (3, 2, [0.9, 0.1]), (4, 2, [0.85, 0.1]),
           (5, 3, [0.84, 0.1]), (6, 3, [-1.0, 0.0]), (700, 9, [-1.0, 0.0]), (800, 1, [1.0, 0.1, 0.0]), (801, 1, [1.0, 0.1, 0.0]), (802, 2, [1.0, 0.1, 0.0]), (900, 5, []), (901, 5, []),
           (902, 6, []), (1000, 7, [0.0, 0.0]), (1001, 7, [0.0, 0.0]), (1002, 8, [0.0, 0.0])]
    df = spark.createDataFrame(odd, SCHEMA)
    for name in ("block", "place", "rank", "score", "window", "dim"):
        df = df.withColumn(name, F.lit("x"))
    got = mined(df.coalesce(1))
    assert got == slowly(odd) and any("(900, 901, 1, 902, 0, 0)" == x for x in got)


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(size=6) * 60000).tolist()) for i in range(300)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == slowly(rows) and got


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_intervals_drop_what_cannot_qualify():
    rows = vectors(2000, 32, 8, labels=2)
    integers, _ = integer_vectors(np.array([r[2] for r in rows]))
    bits, planes = sliced(integers)
    block = Block({"block": 0, "dim": 32, "size": 2000, "bits": bits, "ids": np.arange(2000).tobytes(), "known": np.ones(2000, bool).tobytes(),
                   "labels": np.zeros(2000, np.int64).tobytes(), "marks": np.zeros(2000, bool).tobytes(), "planes": planes.tobytes()})
    assert np.array_equal(block.vectors(np.arange(2000)), integers)
    anchors = integers[:20]
    scores = integers @ anchors.T
    low, high = np.quantile(scores, 0.97, axis=0).astype(np.int64)[:, None], np.quantile(scores, 0.99, axis=0).astype(np.int64)[:, None]
    anchor, row, score = interval_search(block, anchors, np.ones((2000, 20), bool), low, high, 5)
    assert np.array_equal(score, scores[row, anchor]) and len(row) < 20 * 20
    for a in range(20):
        want = sorted(scores[(scores[:, a] >= low[a]) & (scores[:, a] <= high[a]), a], reverse=True)[:5]
        assert sorted(score[anchor == a], reverse=True)[:5] == want
