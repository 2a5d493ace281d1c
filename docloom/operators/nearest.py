"""Exact nearest vectors by blocks: matrix products of row blocks and query blocks, the best k kept on the way."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a row block and of a query block that are multiplied at once.
ROW_BLOCK, QUERY_BLOCK = 4096, 256
#: Bytes of an Arrow batch: a pair of blocks has megabytes, and as many pairs as a batch has rows by default would fill a worker.
BATCH_BYTES = 4 << 20
#: Decimal places that scores are compared and returned with.
PLACES = 6

_BLOCK = [("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("vectors", pa.binary())]
BLOCK = "dim int, ids array<bigint>, tags array<bigint>, vectors binary"


def few_blocks(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of BATCH_BYTES for the session unless it sets another bound itself."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "-1"):
        conf.set(name, str(BATCH_BYTES))
    return df


def unit_vectors(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without a length, or with a part that is no finite number, are zero."""
    largest = np.abs(values).max(axis=1, initial=0.0, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = values / np.where(largest > 0, largest, 1.0)
        out = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return np.where(np.isfinite(out).all(axis=1, keepdims=True) & (largest > 0) & np.isfinite(largest), out, 0.0)


def by_dimension(vectors: pa.Array):
    """(number of components, places, matrix of doubles) of the vectors of each number of components; null ones have none."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy()
    for dim in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dim)
        flat = vectors.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        yield dim, places, flat.reshape(len(places), dim)


def _pack(size: int):
    """Rows (id, tag, vector) as blocks of unit vectors."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                for dim, places, values in by_dimension(part.column(2)):
                    mine = part.take(pa.array(places))
                    row = {"dim": dim, "ids": mine.column(0).to_pylist(), "tags": mine.column(1).to_pylist(), "vectors": unit_vectors(values).tobytes()}
                    yield pa.RecordBatch.from_pylist([row], pa.schema(_BLOCK))

    return run


def blocks_of(rows: DataFrame, id_: Column, tag: Column, vector: Column, size: int) -> DataFrame:
    """Blocks of at most `size` vectors, with an id and a number to carry for each."""
    return rows.select(id_.cast("bigint"), tag.cast("bigint"), vector).mapInArrow(_pack(size), BLOCK)


class TopK:
    """The k best (score, smaller id first) of each query of one block so far."""

    def __init__(self, ids: list[int], vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = np.array(ids, np.int64), vectors, k
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.row_id, self.tag, self.tagged = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.bar = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, tags: np.ndarray, tagged: np.ndarray, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Compare with a block of rows; only with the queries at `asked`, if given."""
        asked = np.arange(len(self.ids)) if asked is None else asked
        if not len(ids) or not len(asked):
            return
        same = self.vectors.shape[1] == vectors.shape[1]
        scores = np.round(vectors @ self.vectors[asked].T, PLACES) if same else np.zeros((len(ids), len(asked)))
        k = min(self.k, len(ids))
        least = np.maximum(np.partition(scores, len(ids) - k, axis=0)[len(ids) - k], self.bar[asked])
        row, which = np.nonzero(scores >= least)
        self.query = np.append(self.query, asked[which])
        self.score = np.append(self.score, scores[row, which])
        self.row_id, self.tag, self.tagged = np.append(self.row_id, ids[row]), np.append(self.tag, tags[row]), np.append(self.tagged, tagged[row])
        order = np.lexsort((self.row_id, -self.score, self.query))
        query = self.query[order]
        start = np.maximum.accumulate(np.where(np.append(True, query[1:] != query[:-1]), np.arange(len(order)), 0))
        rank = np.arange(len(order)) - start
        last = order[rank == self.k - 1]
        self.bar[self.query[last]] = self.score[last]
        order = order[rank < self.k]
        self.query, self.score, self.row_id, self.tag, self.tagged = (x[order] for x in (self.query, self.score, self.row_id, self.tag, self.tagged))

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.query]), pa.array(self.row_id), pa.array(self.tag, mask=~self.tagged), pa.array(self.score)], ["query_id", "chunk_id", "document_id", "score"]
        )


FOUND = "query_id bigint, chunk_id bigint, document_id bigint, score double"


def opened(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tags, whether there is a tag, vectors) of a block."""
    tags = row[f"{prefix}tags"]
    vectors = np.frombuffer(row[f"{prefix}vectors"]).reshape(len(tags), row[f"{prefix}dim"])
    return np.array(row[f"{prefix}ids"], np.int64), np.array([t or 0 for t in tags], np.int64), np.array([t is not None for t in tags], bool), vectors


def _compare(k: int):
    def run(batches):
        best: dict[bytes, TopK] = {}
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                key = hashlib.blake2b(np.array(row["q_ids"], np.int64).tobytes() + row["q_vectors"], digest_size=16).digest()
                if key not in best:
                    best[key] = TopK(row["q_ids"], opened(row, "q_")[3], k)
                best[key].meet(*opened(row))
        for kept in best.values():
            yield kept.found()

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, numbered from 1; ties go to the smaller chunk id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, search: Callable = _compare) -> DataFrame:
    """The k nearest chunks (chunk_id, document_id, embedding) of each query (query_id, q) by cosine.

    Returns query_id, rank, chunk_id, document_id and score, rounded to PLACES. Rows and queries are
    packed into blocks of unit vectors; every query block meets every row block in a matrix product,
    and a task gives on the k best of each query only. So nothing is made for each pair, and the
    query set may grow like the table: its blocks are shuffled, not broadcast, when they are large.

    Vectors that are null, have no length or a part that is no finite number, and vectors of unlike
    numbers of components score 0. Rows and queries without an id take no part. Repeated query ids
    share one list. No rows or no queries give no rows.
    """
    rows = few_blocks(chunks).where("chunk_id is not null")
    tag = F.col("document_id") if "document_id" in chunks.columns else F.lit(None)
    asked = blocks_of(queries.where("query_id is not null"), F.col("query_id"), F.lit(None), F.col("q"), QUERY_BLOCK)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "vectors")], F.col("tags").alias("q_tags")).hint("rebalance")
    blocks = blocks_of(rows, F.col("chunk_id"), tag, F.col("embedding"), ROW_BLOCK)
    found = blocks.crossJoin(asked).mapInArrow(search(k), FOUND)
    return ranked(found, k).select("query_id", "rank", "chunk_id", "document_id", "score")
