"""Hard negatives by bit-sliced integer products: bit planes from the highest down, score intervals, early drops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, release

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative has from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Rows of a block, and anchors that are compared with it at once.
ROW_BLOCK = 4096
ANCHOR_BLOCK = 256
#: Squared length of an integer vector from which products could leave 64 bits.
LONGEST = 1 << 52
#: Share of the pairs of a block that go on, below which they are listed one by one.
LISTED = 0.125
_FAR = 1 << 61

_BLOCK = "block bigint, dim int, size int, bits int, ids binary, known binary, labels binary, marks binary, planes binary"
_ANCHOR = "block bigint, place int, dim int, id bigint, label bigint, vector binary"


def integer_vectors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor(SCALE * x) as 64-bit integers, which rows are usable) of a matrix of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
        good = np.isfinite(values).all(axis=1) & ((scaled * scaled).sum(axis=1) < LONGEST)
    return np.where(good[:, None], scaled, 0).astype(np.int64), good


def sliced(vectors: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, packed planes): the sign plane, of weight -2^bits, and the planes of weight 2^(bits-1) down to 1."""
    bits = int(np.abs(vectors).max(initial=0)).bit_length()
    planes = [vectors < 0] + [(vectors >> k) & 1 == 1 for k in range(bits - 1, -1, -1)]
    return bits, np.packbits(np.stack(planes), axis=2)


class Block:
    """A block of rows as bit planes, unpacked one plane at a time."""

    def __init__(self, row: dict):
        self.number, self.dim, self.size, self.bits = row["block"], row["dim"], row["size"], row["bits"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.marks = np.frombuffer(row["marks"], bool)
        self.planes = np.frombuffer(row["planes"], np.uint8).reshape(self.bits + 1, self.size, -1)

    def plane(self, k: int, kind: type) -> np.ndarray:
        return np.unpackbits(self.planes[k], axis=1, count=self.dim).astype(kind)

    def weights(self) -> list[int]:
        return [-(1 << self.bits)] + [1 << k for k in range(self.bits - 1, -1, -1)]

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.dim), np.int64)
        for k, weight in enumerate(self.weights()):
            out += weight * np.unpackbits(self.planes[k][rows], axis=1, count=self.dim).astype(np.int64)
        return out


def ranked_within(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): a sort by group and then by the keys, and the rank from 0 of each sorted item in its group."""
    order = np.lexsort((*reversed(keys), group))
    sorted_ = group[order]
    first = np.append(True, sorted_[1:] != sorted_[:-1])
    place = np.arange(len(order))
    return order, place - np.maximum.accumulate(np.where(first, place, 0))


def kth_best(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group, -_FAR for a group with fewer."""
    out = np.full(groups, -_FAR)
    order, rank = ranked_within(group, -value)
    hit = order[rank == k - 1]
    out[group[hit]] = value[hit]
    return out


def interval_search(block: Block, anchors: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor, row, score) of all rows of a block that can be among the k best of some window of an anchor.

    allowed (rows x anchors) says which pairs count at all, low and high (anchors x windows) bound
    the scores that a window takes. Planes are added from the highest down. What the lower planes
    can still add to a product lies between (2^left - 1) times the sum of the anchor's negative
    components and as much of its positive ones, so each plane halves every score's interval. A pair
    goes once its interval meets no window, or lies under the k-th best lower end of each window
    that it meets. With the last plane intervals are points: the scores.
    """
    up, down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    kind = np.float32 if np.abs(anchors).sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    wide = anchors.T.astype(kind)
    part, alive, listed = np.zeros(allowed.shape, np.int64), allowed, None
    least, most = low.min(axis=1, initial=_FAR), high.max(axis=1, initial=-_FAR)
    for k_plane, weight in enumerate(block.weights()):
        rest = (1 << (block.bits - k_plane)) - 1
        plane = block.plane(k_plane, kind)
        if listed is None:
            part += weight * (plane @ wide).astype(np.int64)
            alive = alive & (part + rest * up >= least) & (part + rest * down <= most)
            if np.count_nonzero(alive) <= LISTED * alive.size or rest == 0:
                row, anchor = np.nonzero(alive)
                listed = (anchor, row, part[row, anchor])
        else:
            anchor, row, score = listed
            product = np.einsum("ij,ij->i", plane[row].astype(np.float64), anchors[anchor].astype(np.float64))
            listed = anchor, row, score + weight * product.astype(np.int64)
        if listed is not None:
            listed = _narrowed(*listed, rest * up, rest * down, low, high, k)
    return listed


def _narrowed(anchor, row, score, add_up, add_down, low, high, k):
    """The pairs whose interval can still be among the k best of a window."""
    lower, upper = score + add_down[anchor], score + add_up[anchor]
    keep = np.zeros(len(anchor), bool)
    for w in range(low.shape[1]):
        lo, hi = low[anchor, w], high[anchor, w]
        sure = (lower >= lo) & (upper <= hi)
        bar = kth_best(anchor[sure], lower[sure], k, len(low))
        keep |= (upper >= np.maximum(lo, bar[anchor])) & (lower <= hi)
    return anchor[keep], row[keep], score[keep]


def _pack(batches):
    """Usable rows as blocks of bit planes, one block for each number of components in a stretch of ROW_BLOCK rows."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            ids, labels, vectors, marks = part.columns
            lengths = pa.compute.list_value_length(vectors)
            whole = pa.compute.and_(labels.is_valid(), vectors.is_valid())
            for dim in pa.compute.unique(lengths).drop_null().to_pylist():
                mine = part.filter(pa.compute.fill_null(pa.compute.and_(whole, pa.compute.equal(lengths, dim)), False))
                flat = mine.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(mine.num_rows, dim)
                integers, good = integer_vectors(flat)
                if not good.any():
                    continue
                mine, integers = mine.filter(pa.array(good)), integers[good]
                bits, planes = sliced(integers)
                yield pa.RecordBatch.from_pylist([{
                    "block": number, "dim": dim, "size": len(integers), "bits": bits,
                    "ids": mine.column(0).fill_null(0).to_numpy().astype(np.int64).tobytes(),
                    "known": mine.column(0).is_valid().to_numpy(zero_copy_only=False).tobytes(),
                    "labels": mine.column(1).to_numpy().astype(np.int64).tobytes(),
                    "marks": mine.column(3).fill_null(False).to_numpy(zero_copy_only=False).tobytes(),
                    "planes": planes.tobytes(),
                }], _BLOCK_ARROW)
                number += 1


_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("dim", pa.int32()), ("size", pa.int32()), ("bits", pa.int32()), ("ids", pa.binary()),
    ("known", pa.binary()), ("labels", pa.binary()), ("marks", pa.binary()), ("planes", pa.binary()),
])


def _anchors(batches):
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            places = np.flatnonzero(block.marks)
            vectors = block.vectors(places)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(places), block.number)), pa.array(places, pa.int32()), pa.array(np.full(len(places), block.dim), pa.int32()),
                pa.array(block.ids[places], mask=~block.known[places]), pa.array(block.labels[places]), pa.array([v.tobytes() for v in vectors], pa.binary()),
            ], ["block", "place", "dim", "id", "label", "vector"])


def _grouped_anchors(windows: int):
    """Pack anchors of one number of components, with the scores of their positives, into rows of ANCHOR_BLOCK."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHOR_BLOCK):
                part = batch.slice(at, ANCHOR_BLOCK)
                for dim in pa.compute.unique(part["dim"]).to_pylist():
                    mine = part.filter(pa.compute.equal(part["dim"], dim))
                    scores = np.full((mine.num_rows, windows), -1, np.int64)  # no row is in the window of a negative score
                    if "scores" in mine.schema.names:
                        for i, given in enumerate(mine["scores"].to_pylist()):
                            scores[i, : len(given)] = given
                    yield pa.RecordBatch.from_pylist([{
                        "a_group": number, "a_dim": dim, "a_size": mine.num_rows, "a_blocks": mine["block"].to_numpy().tobytes(),
                        "a_places": mine["place"].to_numpy().astype(np.int64).tobytes(), "a_labels": mine["label"].to_numpy().tobytes(),
                        "a_vectors": b"".join(mine["vector"].to_pylist()), "a_scores": scores.tobytes(),
                    }], _GROUP_ARROW)
                    number += 1

    return run


_GROUP = "a_group bigint, a_dim int, a_size int, a_blocks binary, a_places binary, a_labels binary, a_vectors binary, a_scores binary"
_GROUP_ARROW = pa.schema([
    ("a_group", pa.int64()), ("a_dim", pa.int32()), ("a_size", pa.int32()), ("a_blocks", pa.binary()), ("a_places", pa.binary()),
    ("a_labels", pa.binary()), ("a_vectors", pa.binary()), ("a_scores", pa.binary()),
])
_FOUND = "block bigint, place int, window int, r_block bigint, r_place int, r_id bigint, score bigint"


class Best:
    """The k best rows so far of each window of the anchors of one group; their last scores are bars for the blocks to come."""

    def __init__(self, row: dict, k: int, same_label: bool):
        size = row["a_size"]
        self.k, self.same = k, same_label
        self.dim = row["a_dim"]
        self.blocks, self.places, self.labels = (np.frombuffer(row[f"a_{n}"], np.int64) for n in ("blocks", "places", "labels"))
        self.vectors = np.frombuffer(row["a_vectors"], np.int64).reshape(size, self.dim)
        scores = np.frombuffer(row["a_scores"], np.int64).reshape(size, -1)
        if same_label:
            self.low, self.high = np.full((size, 1), -_FAR), np.full((size, 1), _FAR)
        else:
            self.low = np.where(scores < 0, _FAR, -(-LOW * scores // 100))
            self.high = np.where(scores < 0, -_FAR, HIGH * scores // 100)
        self.rows = np.zeros((0, 7), np.int64)  # window of an anchor, score, id is missing, id, block, place

    def meet(self, block: Block) -> None:
        if block.dim != self.dim:
            return
        allowed = (block.labels[:, None] == self.labels[None, :]) == self.same
        own = np.flatnonzero(self.blocks == block.number)
        allowed[self.places[own], own] = False
        anchor, row, score = interval_search(block, self.vectors, allowed, self.low, self.high, self.k)
        windows, found = self.low.shape[1], [self.rows]
        for w in range(windows):
            fits = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
            r = row[fits]
            found.append(np.stack([anchor[fits] * windows + w, score[fits], ~block.known[r], block.ids[r], np.full(len(r), block.number), r, r], axis=1))
        rows = np.concatenate(found)
        order, rank = ranked_within(rows[:, 0], -rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5])
        self.rows = rows[order[rank < self.k]]
        bar = kth_best(self.rows[:, 0], self.rows[:, 1], self.k, self.low.size).reshape(self.low.shape)
        self.low = np.maximum(self.low, bar)

    def found(self) -> pa.RecordBatch:
        anchor, window = np.divmod(self.rows[:, 0], self.low.shape[1])
        return pa.RecordBatch.from_arrays([
            pa.array(self.blocks[anchor]), pa.array(self.places[anchor].astype(np.int32)), pa.array(window.astype(np.int32)), pa.array(self.rows[:, 4]),
            pa.array(self.rows[:, 5].astype(np.int32)), pa.array(self.rows[:, 3], mask=self.rows[:, 2] == 1), pa.array(self.rows[:, 1]),
        ], ["block", "place", "window", "r_block", "r_place", "r_id", "score"])


def _search(k: int, same_label: bool):
    """Meet all pairs of blocks of a task, keeping no more than the k best of each window of its anchors."""

    def run(batches):
        best: dict[int, Best] = {}
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if block is None or block.number != row["block"]:
                    block = Block(row)
                group = row["a_group"]
                if group not in best:
                    best[group] = Best(row, k, same_label)
                best[group].meet(block)
        for kept in best.values():
            yield kept.found()

    return run


def _best_rows(blocks: DataFrame, anchors: DataFrame, k: int, same_label: bool, windows: int, name: str) -> DataFrame:
    """The k best rows of each window of each anchor: the stated query set against all rows, block by block."""
    parts = max(1, -(-anchors.count() // (4 * ANCHOR_BLOCK)))
    groups = materialize(anchors.repartition(parts).mapInArrow(_grouped_anchors(windows), _GROUP), f"{name}_anchors")
    found = blocks.crossJoin(groups).mapInArrow(_search(k, same_label), _FOUND)
    order = Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), F.asc_nulls_last("r_id"), "r_block", "r_place")
    kept = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)
    release(groups)
    return kept


def hard_negatives(rows: DataFrame) -> DataFrame:
    """Hard negatives of marked rows (vec_id, label, embedding, is_anchor).

    Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each
    anchor its POSITIVES best other rows of the same label, and for each of these the NEGATIVES best
    rows of other labels whose score is LOW to HIGH hundredths of the positive's. A score is the
    product of the vectors floor(SCALE * x); ties go to the smaller vec_id, a missing one last, then
    to the earlier row.

    Rows are packed once into blocks of bit planes. Anchors are a stated share of the rows; groups
    of ANCHOR_BLOCK meet every block, first for positives, then for negatives inside the windows of
    the positives, and a task gives on only the best rows of each window. No label, id or vector is
    a key, so a label with a third of all rows is spread like any other.

    Rows with a null label, a null vector, a null or non-finite component take no part, nor do those
    whose vector is 2^18 long or more, whose products could leave 64 bits. Only vectors of as many
    components are compared; empty ones score 0. Rows that share a vec_id stay rows of their own
    (each can be an anchor, and a positive of the other); a null vec_id or mark is no anchor. An
    anchor without positives, or a positive without negatives, gives no row; other columns are not
    read; no rows give no rows.
    """
    kept = rows.select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"), F.coalesce("is_anchor", F.lit(False))
    )
    blocks = materialize(kept.mapInArrow(_pack, _BLOCK), "blocks")
    anchors = materialize(blocks.mapInArrow(_anchors, _ANCHOR), "anchors")
    positives = _best_rows(blocks, anchors, POSITIVES, True, 1, "positives")
    pairs = positives.select("block", "place", (F.col("rank") - 1).alias("window"), F.col("r_id").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = positives.groupBy("block", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    negatives = _best_rows(blocks, anchors.join(scores, ["block", "place"]), NEGATIVES, False, POSITIVES, "negatives")
    release(blocks)
    return (
        negatives.select("block", "place", "window", "rank", F.col("r_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["block", "place", "window"])
        .join(anchors.select("block", "place", F.col("id").alias("anchor_id")), ["block", "place"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
