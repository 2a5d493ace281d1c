"""Repeated word windows through a log-structured index of window seeds."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import at_path, listed_tables, materialize, modest_batches, release
from docloom.llm.rolling import WordBuffer, by_bytes, sliding_argmin, small

WINDOW = 35
SEED = 8
#: Runs that the index holds before it merges them into one, and loads that a whole table is split into.
FANOUT = 4
LOADS = 5
_BLOCK_BYTES = 1 << 20
_BLOCK_WORDS = 250_000

#: Words are parted by space, tab, line feed, vertical tab, form feed and carriage return.
_SPLIT = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def seeds_of(buffer: WordBuffer, window: int, seed: int, digested: bool = False):
    """The seed that stands for each window: the smallest hash among its runs of `seed` words.

    Equal windows have equal seeds at equal places. Neighbouring windows with the same
    seed are one occurrence: (text, first window, windows, seed hash, digest of its context),
    the context being all words of those windows. The digests are left out if not asked for.
    """
    word, text = buffer.runs(window)
    if not len(word):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), [])
    last = len(buffer.starts) - seed + 1
    hashes = buffer.hashes(np.arange(last), seed)
    anchor = sliding_argmin(hashes, window - seed + 1)[word]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (word[1:] != word[:-1] + 1) | (text[1:] != text[:-1])]))
    first, owner = word[new], text[new]
    count = np.diff(np.append(new, len(word)))
    context = buffer.digests(first, first + count - 1 + window) if digested else []
    return owner, first - buffer.bounds[owner], count, hashes[anchor[new]], context


def blocks_of(texts: list[str | None], window: int):
    """(index of each text, words to add to its places, buffer) for blocks of bounded size.

    A text larger than a block is taken by parts that overlap by all but one word of a window.
    """
    raw = [(t or "").encode() for t in texts]
    for block in by_bytes([len(t) for t in raw], _BLOCK_BYTES):
        if block.stop - block.start == 1 and len(raw[block.start]) > _BLOCK_BYTES:
            words = raw[block.start].split()
            for at in range(0, max(1, len(words) - window + 1), _BLOCK_WORDS):
                yield [block.start], at, WordBuffer([b" ".join(words[at : at + _BLOCK_WORDS + window - 1])], _SPLIT)
        else:
            yield list(range(block.start, block.stop)), 0, WordBuffer(raw[block], _SPLIT)


def _seed_rows(window: int, seed: int):
    """(load, seed) of the texts of each load."""

    def run(batches):
        for batch in small(batches):
            load = batch.column(0).to_numpy(zero_copy_only=False)
            for index, _, buffer in blocks_of([t.as_py() for t in batch.column(1)], window):
                owner, _, _, h, _ = seeds_of(buffer, window, seed)
                yield pa.RecordBatch.from_arrays([pa.array(load[np.array(index)[owner]]), pa.array(h.view(np.int64))], ["load", "seed"])

    return run


def numbered_seeds(texts: DataFrame, window: int, seed: int, loads: int) -> DataFrame:
    """How often each seed stands in the texts (key, text) of each load, from one pass over them, kept apart by load."""
    rows = texts.select(F.pmod("key", F.lit(loads)).cast("int").alias("load"), "text").mapInArrow(_seed_rows(window, seed), "load int, seed bigint")
    return materialize(rows.groupBy("load", "seed").count(), "loads", by="load")


_OCCURRENCE = "key bigint, check int, first bigint, windows int, seed bigint, context binary"


def _occurrence_rows(window: int, seed: int):
    def run(batches):
        for batch in small(batches):
            key, check = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for index, shift, buffer in blocks_of([t.as_py() for t in batch.column(2)], window):
                owner, first, count, h, context = seeds_of(buffer, window, seed, digested=True)
                row = np.array(index)[owner]
                columns = [key[row], check[row], first + shift, count.astype(np.int32), h.view(np.int64)]
                names = ["key", "check", "first", "windows", "seed", "context"]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(context, pa.binary())], names)

    return run


def _posting_rows(window: int, seed: int):
    def run(batches):
        for batch in small(batches):
            key, check = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for index, _, buffer in blocks_of([t.as_py() for t in batch.column(2)], window):
                owner, _, _, h, _ = seeds_of(buffer, window, seed)
                row = np.array(index)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[row]), pa.array(check[row])], ["seed", "key", "check"])

    return run


class SubstringIndex:
    """Window seeds of everything loaded so far, as immutable runs sorted by seed.

    A load writes one run and merge-joins it with the runs before it; the seeds that the load
    meets twice are kept as a further small table. When FANOUT runs have gathered they are
    compacted into one. With a path the index outlives the session: its runs also tell
    which texts hold a seed, and the texts are kept beside them, so that later batches
    are judged against all that was ever loaded (`open_index`).
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, seed: int = SEED, path: str | None = None):
        self.spark, self.window, self.seed = spark, window, seed
        self.path = path and f"{path.rstrip('/')}/windows-{window}-{seed}"
        self.runs: list[DataFrame] = []
        self.met_twice: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        for name in listed_tables(spark, self.path) if self.path else []:
            table = at_path(spark, f"{self.path}/{name}")
            (self.runs if name.startswith("run-") else self.texts).append(table)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self.path and f"{self.path}/{name}-{uuid.uuid4().hex}")

    def load(self, texts: DataFrame) -> None:
        """Enter the rows of a table (key, check, text)."""
        if self.path:
            self.texts.append(self._write(texts.select("key", "check", "text"), "texts"))
            seeds = texts.select("key", "check", "text").mapInArrow(_posting_rows(self.window, self.seed), "seed bigint, key bigint, check int")
            self.enter(seeds.groupBy("seed", "key", "check").count())
        else:
            seeds = numbered_seeds(texts, self.window, self.seed, 1)
            self.enter(seeds.drop("load"))
            release(seeds)

    def enter(self, counted: DataFrame) -> None:
        """Enter the counted seeds of one load as a run: merge-join it with the others, and compact when FANOUT are there."""
        run = self._write(counted.repartition("seed").sortWithinPartitions("seed"), "run")
        hits = run.groupBy("seed").agg(F.sum("count").alias("n")).where("n > 1").select("seed")
        for older in self.runs:
            hits = hits.union(run.join(older, "seed", "left_semi").select("seed"))
        self.met_twice.append(materialize(hits.distinct(), "met_twice"))
        self.runs.append(run)
        if len(self.runs) >= FANOUT:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        by = [c for c in self.runs[0].columns if c != "count"]
        merged = reduce(DataFrame.unionByName, self.runs).groupBy(*by).agg(F.sum("count").alias("count"))
        whole = self._write(merged.repartition("seed").sortWithinPartitions("seed"), "run")
        release(*self.runs)
        self.runs = [whole]

    def repeated_seeds(self) -> DataFrame:
        """Seeds that stand for windows at two places at least."""
        return reduce(DataFrame.union, self.met_twice).distinct()

    def texts_with(self, seeds: DataFrame, but_last: bool = True) -> DataFrame:
        """(key, check, text) of the loaded texts that hold any of the seeds, but for those of the last load."""
        held = reduce(DataFrame.unionByName, self.runs).join(seeds, "seed", "left_semi").select("key", "check").distinct()
        tables = self.texts[:-1] if but_last else self.texts
        if not tables:
            return self.texts[-1].where("false")
        return reduce(DataFrame.unionByName, tables).join(held, ["key", "check"], "left_semi")


def open_index(spark: SparkSession, path: str, window: int = WINDOW, seed: int = SEED) -> SubstringIndex:
    """The index kept in a folder, or a new one there."""
    return SubstringIndex(spark, window, seed, path)


def _window_rows(window: int):
    """(class columns, place, digest) of every window of the listed occurrences of each text."""

    def run(batches):
        for batch in small(batches):
            listed = batch.column(1).to_pylist()
            for index, shift, buffer in blocks_of([t.as_py() for t in batch.column(0)], window):
                seeds, contexts, places, words = [], [], [], []
                for t, row in enumerate(index):
                    size = buffer.bounds[t + 1] - buffer.bounds[t]
                    for o in listed[row]:
                        first = o["first"] - shift
                        span = [k for k in range(o["windows"]) if 0 <= first + k and first + k + window <= size]
                        places += span
                        words += [buffer.bounds[t] + first + k for k in span]
                        seeds += [o["seed"]] * len(span)
                        contexts += [o["context"]] * len(span)
                at = np.array(words, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds, pa.int64()), pa.array(contexts, pa.binary()), pa.array(places, pa.int32()), pa.array(buffer.digests(at, at + window), pa.binary())],
                    ["seed", "context", "place", "words"],
                )

    return run


def _without(text: str | None, spans: list[dict], window: int) -> tuple[int, int, str]:
    """Words, removed words and the digest of the kept words of one text."""
    words = (text or "").encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    for o in spans or []:
        mask, first = o["mask"], o["first"]
        while mask:
            place = (mask & -mask).bit_length() - 1
            gone[first + place] += 1
            gone[first + place + window] -= 1
            mask &= mask - 1
    keep = np.cumsum(gone)[: len(words)] == 0
    kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _result_rows(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches):
        for batch in small(batches):
            rows = [_without(t.as_py(), s, window) for t, s in zip(batch.column(1), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) or [[], [], []]
            types = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, loads: int = LOADS,
    index: SubstringIndex | None = None,
) -> DataFrame:
    """Words that stay when every word of a window that starts at two places is removed.

    Returns (doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    The index first tells the window seeds met twice. Only their occurrences go on: equal
    contexts (all windows of an occurrence) are one class, and a class of two members
    repeats as a whole. Where a seed has several classes, the windows of one member of
    each are compared. Words are compared by digests that only equal words share (rolling.digests),
    never by the seeds' hashes, which only find candidates. Each class then has a bit mask of repeated windows,
    which goes back to its members and so to the documents. Groups are only counted,
    after a combine, or joined from their large side, so copies by the thousand do not meet in one task.

    With a kept index (`open_index`) docs are a new batch: they are loaded into it and judged against
    all that it holds, of which only the texts that share a seed with the batch are read.

    Defined results: a null or empty text has no words; rows that repeat id and text
    count as places of their own; a null id keeps its row; an empty table gives no rows;
    a very long text is taken whole, by parts that overlap; other columns are not read. A seed of more words than the window is refused.
    """
    if not 0 < seed <= window <= seed + 62:
        raise ValueError("a seed lies in its window and an occurrence has at most 63 windows")
    identity, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    keyed = modest_batches(docs).select(
        identity.alias("doc_id"), text.alias("text"), F.xxhash64(identity, text).alias("key"), F.hash(identity, text).alias("check")
    )
    if index is None:
        index = SubstringIndex(docs.sparkSession, window, seed)
        counted = numbered_seeds(keyed, window, seed, loads)
        for k in range(loads):
            index.enter(counted.where(F.col("load") == k).drop("load"))
        release(counted)
        seeds = materialize(index.repeated_seeds(), "seeds")
        release(*index.runs, *index.met_twice)
        corpus = keyed.select("key", "check", "text")
    else:
        index.load(keyed)
        window, seeds = index.window, index.met_twice[-1]
        corpus = keyed.select("key", "check", "text").unionByName(index.texts_with(seeds))
    found = corpus.mapInArrow(_occurrence_rows(window, index.seed), _OCCURRENCE)
    found = materialize(found.join(seeds, "seed", "left_semi"), "occurrences")
    classes = materialize(
        found.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "check", "first", "windows")).alias("at")),
        "classes",
    )
    contested = materialize(classes.groupBy("seed").count().where("count > 1").select("seed"), "contested")
    listed = (
        classes.join(contested, "seed", "left_semi")
        .select(F.col("at.key").alias("key"), F.col("at.check").alias("check"), F.struct("at.first", "at.windows", "seed", "context").alias("o"))
        .groupBy("key", "check")
        .agg(F.collect_list("o").alias("listed"))
    )
    listed = materialize(listed, "listed")
    one = corpus.join(listed, ["key", "check"]).dropDuplicates(["key", "check"])
    windows = materialize(
        one.select("text", "listed").mapInArrow(_window_rows(window), "seed bigint, context binary, place int, words binary"), "windows"
    )
    twice = materialize(windows.groupBy("words").count().where("count > 1").select("words"), "twice")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))
    partly = windows.join(twice, "words", "left_semi").groupBy("seed", "context").agg(F.bit_or(bit).alias("mask"))
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at.windows")) - 1
    masks = classes.join(partly, ["seed", "context"], "left").select(
        "seed", "context", F.when(F.col("n") > 1, full).otherwise(F.coalesce("mask", F.lit(0))).alias("mask")
    )
    masks = materialize(masks.where("mask <> 0"), "masks")
    spans = found.join(masks, ["seed", "context"]).groupBy("key", "check").agg(F.collect_list(F.struct("first", "mask")).alias("spans"))
    spans = materialize(spans, "spans")
    release(found, classes, contested, listed, windows, twice, masks)
    return (
        keyed.join(spans, ["key", "check"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_result_rows(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    )
