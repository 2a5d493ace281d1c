"""Language-model scores against plain counters."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from docloom.llm import lm_scores
from docloom.llm.lm_scores import FilterShard, level_counts, level_of, score_texts
from docloom.llm.registry import op13_lm_scores
from tests.llm.helpers import empty_docs, odd_docs

DATA = "/root/testdata/sf0.001"


def slowly(rows):
    """Exact word counts; pair counts from a counter, read as their levels."""
    lists = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    words = Counter(w for ws, h in zip(lists, held) if not h for w in ws)
    pairs = Counter(p for ws, h in zip(lists, held) if not h for p in zip(["", *ws], ws))
    followers, once, twice = Counter(a for a, _ in pairs), sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values())
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    total, distinct, read = sum(words.values()), len(words), level_counts()
    out = []
    for (doc, _), ws, h in zip(rows, lists, held):
        base = [(words[w] + 0.5) / (total + 0.5 * (distinct + 1)) for w in ws]
        score = 0.0
        for a, b, p in zip(["", *ws], ws, base):
            n = min(read[level_of(np.array([pairs[a, b]]))[0]] if (a, b) in pairs else 0, words[a], words[b])
            score += math.log10(min(1.0, (max(n - discount, 0) + discount * followers[a] * p) / words[a]) if words[a] else p)
        out.append((doc, h, len(ws), sum(w in words for w in ws), total, round(sum(map(math.log10, base)), 6), round(score, 6)))
    return sorted(out, key=str)


def scored(docs):
    got = score_texts(docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)).collect()
    return sorted(((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=str)




def test_base_is_exact_and_score_near(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r[0]: r for r in slowly([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = op13_lm_scores(spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[:5] == w[:5] and abs(r["base_score"] - w[5]) < 1e-5
        assert abs(r["score"] - w[6]) <= 0.02 * abs(w[6])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(spark):
    docs = odd_docs(spark, [(950, "İ STANBUL ſ \x1c\x85 Ünd"), (951, "a\x0bb\x0cc\rd"), (952, "A a")])
    want = slowly([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    got = scored(docs)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(abs(a[6] - b[6]) <= 1e-6 + 0.02 * abs(b[6]) for a, b in zip(got, want))


def test_no_rows_and_no_training(spark):
    assert scored(empty_docs(spark)) == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    assert all(r[4:] == (0, 0.0, 0.0) and r[3] == 0 for r in scored(spark.createDataFrame([(i, "some words") for i in held], "doc_id bigint, text string")))


def test_sent_probes_give_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = scored(docs)
    monkeypatch.setattr(lm_scores, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(lm_scores, "FILTER_BYTES", 0)
    got = scored(docs)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(abs(a[6] - b[6]) <= 0.02 * abs(b[6]) for a, b in zip(got, want))
    monkeypatch.setattr(lm_scores, "FILTER_BYTES", 1 << 30)
    assert scored(docs) == got


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    counts = np.minimum(rng.zipf(1.6, 40_000), 10**6)
    shard = FilterShard.of(prints, counts)
    assert (shard.levels(prints) >= level_of(counts)).all() and (shard.levels(prints) == level_of(counts)).mean() > 0.96
    assert (shard.levels(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)) > 0).mean() < 0.03
    assert not FilterShard.of(prints[:0], counts[:0]).levels(prints[:5]).any()


def test_levels_read_near_their_counts():
    counts = np.arange(1, 5000)
    read = level_counts()[level_of(counts)]
    assert (np.abs(read - counts) <= 0.34 * counts).all() and read[:3].tolist() == [1, 2, 3]


def test_probabilities_add_up(spark):
    """Of one word after another, over all known words and one unknown."""
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(1)
    train = [(i, " ".join(rng.choice(words, 20))) for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    ids = (i for i in range(1000, 9999) if zlib.crc32(str(i).encode()) % 5 == 1)
    asked = [(next(ids), w) for w in [*words, "", "zzz"]]
    got = {r[0]: r for r in scored(spark.createDataFrame(train + asked, "doc_id bigint, text string"))}
    texts = dict(asked)
    want = {r[0]: r for r in slowly(train + asked)}
    first = sum(10 ** want[i][6] for i in texts if texts[i] == "")
    assert 0 < first < 1 and all(abs(got[i][6] - want[i][6]) < 0.02 * abs(want[i][6]) + 1e-6 for i in texts)
