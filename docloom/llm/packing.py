"""Best-fit decreasing packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, modest_batches
from docloom.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 0
_TEXTS_AT_ONCE = 256


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the rest first, then full ones."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def _encode_pieces(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]

    def run(batches):
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        encode = encoder(path).encode
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids, start = ids + end, 0
                    for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                        seen[length] += 1
                        start += length
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which ones some open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, remaining: int, is_open: bool) -> None:
        node = remaining + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least need that an open bin has."""
        node = need + self.size
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Items of one length are alike, so bins that stand alike are filled together.
    Returns rows (length, first rank, first bin, items per bin, offset in the bin);
    a row covers the ranks up to the next row of its length. Every length adds at
    most three groups of alike bins and a group is refilled at most log2(capacity)
    times, so the plan is bounded by the capacity, whatever the number of items.
    """
    tree, groups, plan, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def put(remaining, first, n):
        if n and remaining:
            groups[remaining].append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = groups[remaining].pop()
                if not groups[remaining]:
                    tree.set(remaining, False)
            per = remaining // length
            full = min(n, left // per)
            use, each = (full, per) if full else (1, left)
            plan.append((length, rank, first, each, capacity - remaining))
            put(remaining - each * length, first, use)
            put(remaining, first + use, n - use)
            rank, left = rank + use * each, left - use * each
    return plan


def _place(plan: list[tuple[int, int, int, int, int]]):
    """plan is bounded by the capacity (see best_fit_plan), so it travels with the task."""
    by_length: dict[int, np.ndarray] = {}
    for row in plan:
        by_length.setdefault(row[0], []).append(row[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}

    def run(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                table = by_length[int(length[rows[0]])]
                mine = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                nth, slot = np.divmod(rank[rows] - mine[:, 0], mine[:, 2])
                sequence[rows] = mine[:, 1] + nth
                offset[rows] = mine[:, 3] + slot * length[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Place every document's tokens, with an end id, into sequences of at most capacity tokens.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.
    Tasks number their pieces of each length; the counts by task and length give every
    piece its rank in its length; the best-fit plan over the histogram of lengths maps
    (length, rank) to a place. Only that histogram, of at most capacity rows, reaches the
    driver.

    Defined results: a null or empty text is the single end id; a null id keeps its pieces;
    repeated rows are packed as often as they occur; an empty table gives no rows; texts of
    any length are cut and never dropped; other columns of docs are not read.
    """
    path = tokenizer_path or default_tokenizer()
    narrow = modest_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, place bigint"
    pieces = materialize(narrow.mapInArrow(_encode_pieces(path, capacity), schema), "pieces")
    counts = pieces.groupBy("task", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(counts.withColumn("before", F.coalesce(before, F.lit(0))), "offsets")
    histogram = offsets.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most capacity rows
    plan = best_fit_plan({r["length"]: r["n"] for r in histogram}, capacity)
    # offsets grow with the tasks, so they are merged by shuffle and never broadcast
    ranked = pieces.join(offsets.drop("count").hint("merge"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        _place(plan),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
