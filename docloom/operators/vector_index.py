"""A stored inverted-file index: vectors lie by cell, a search reads the cells nearest to its queries."""

from __future__ import annotations

import hashlib
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from docloom.operators import nearest as exact
from docloom.operators import versions
from docloom.operators.nearest import TopK, by_dimension, opened, unit_vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells are CELLS times the root of the rows, of LEAST_ROWS rows at least, and no more than CENTRE_BYTES of centres.
CELLS, LEAST_ROWS, CENTRE_BYTES = 12, 3, 64 << 20
#: Rows for each cell that the centres are fitted on, and rounds of the fit.
SAMPLE_ROWS, ROUNDS = 8, 2
#: Share of the rows (of the scope) that a query looks at; fixed values: 20 candidates for each answer, 100 at least.
SHARE, CANDIDATES, LEAST_CANDIDATES = 0.19, 20, 100
#: Rows of the index that one task reads, as small files as they may lie in.
TASK_ROWS = 1 << 16
#: The cell of vectors that have no direction.
NO_CELL = -1


def cells_for(rows: int, dim: int) -> int:
    """How many cells an index of so many vectors has."""
    return max(1, min(ceil(CELLS * sqrt(rows)), rows // LEAST_ROWS, CENTRE_BYTES // (4 * max(dim, 1))))


def _nearest_cell(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((unit[at : at + 1024] @ centres.T).argmax(axis=1) for at in range(0, len(unit), 1024))])


def _cell_sums(centres: np.ndarray):
    """Of each task, the sum of the unit vectors that are nearest to each centre."""

    def run(batches):
        sums = np.zeros_like(centres)
        for batch in batches:
            for _, _, values in by_dimension(batch.column(0)):
                unit = unit_vectors(values)
                np.add.at(sums, _nearest_cell(unit, centres), unit)
        seen = np.flatnonzero(sums.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([x.tobytes() for x in sums[seen]], pa.binary())], ["cell", "total"])

    return run


def _add_up(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, total in zip(*(c.to_pylist() for c in batch.columns)):
            totals[cell] = totals.get(cell, 0) + np.frombuffer(total)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["cell", "total"])


def _fit(vectors: DataFrame, rows: int, cells: int) -> np.ndarray:
    """Unit centres by ROUNDS of spherical k-means from rows of smallest hash, over SAMPLE_ROWS rows for each cell."""
    wanted = SAMPLE_ROWS * cells
    hashed = vectors.select("embedding", F.xxhash64("chunk_id", F.lit(1)).alias("h"))
    sample = hashed.select("embedding") if rows <= wanted else hashed.where(F.pmod("h", F.lit(rows)) < wanted).select("embedding")
    first = hashed.orderBy(F.xxhash64("h"), "h").limit(cells).select("embedding").collect()  # CENTRE_BYTES at most
    centres = unit_vectors(np.array([r["embedding"] for r in first], float))
    for _ in range(ROUNDS):
        sums = sample.mapInArrow(_cell_sums(centres), "cell int, total binary").repartition("cell").mapInArrow(_add_up, "cell int, total binary")
        for r in sums.collect():
            centres[r["cell"]] = unit_vectors(np.frombuffer(r["total"])[None, :])[0]
    return centres


def _assign(centres: np.ndarray, dim: int):
    """Each row with the cell of its nearest centre."""

    def run(batches):
        for batch in batches:
            cell = np.full(batch.num_rows, NO_CELL, np.int32)
            for size, places, values in by_dimension(batch.column(2)):
                if size == dim:
                    unit = unit_vectors(values)
                    cell[places] = np.where(unit.any(axis=1), _nearest_cell(unit, centres), NO_CELL)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def build_index(chunks: DataFrame, path: str) -> int:
    """Write a new version of the index of all chunks (chunk_id, document_id, embedding) and make it current; returns its number.

    Cells number with the root of the rows. Every row is written, under the folder of its cell: those
    whose vector is null, has no direction or another number of components than most under NO_CELL,
    which every search reads. A crowded cell is split into several files by adaptive execution, so
    no task gets more of it than of others. Centres, at most CENTRE_BYTES, go through the driver.
    """
    spark = chunks.sparkSession
    rows = exact.few_blocks(chunks).select(F.col("chunk_id").cast("bigint"), F.col("document_id").cast("bigint"), "embedding")
    has_length = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.coalesce(has_length, F.lit(False)))
    sizes = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, count = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
    centres = _fit(usable.where(F.size("embedding") == dim), count, cells_for(count, dim)) if count else np.zeros((1, 0))
    data, listed = versions.fresh_folder(path, "vectors"), versions.fresh_folder(path, "centres")
    schema = f"chunk_id bigint, document_id bigint, embedding {dict(rows.dtypes)['embedding']}, cell int"
    assigned = rows.mapInArrow(_assign(centres, dim), schema)
    assigned.hint("rebalance", "cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(data)
    table = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(centres)], "cell int, centre binary")
    counts = spark.read.schema(schema).parquet(data).groupBy("cell").count()
    table.join(counts, "cell", "left").select("cell", "centre", F.coalesce("count", F.lit(0)).alias("rows")).coalesce(1).write.parquet(listed)
    folders = ["/".join(f.rsplit("/", 2)[1:]) for f in (data, listed)]
    known = versions.versions(spark, path)
    return versions.commit(spark, path, {"folders": folders, "dim": dim, "schema": schema}, known[-1] if known else 0)


def indexed_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All rows of the index (chunk_id, document_id, embedding, cell); None if there is none."""
    found = versions.manifest(spark, path, version)
    return found and spark.read.schema(found["schema"]).parquet(f"{path}/{found['folders'][0]}")


def _choose(centres: np.ndarray, cells: np.ndarray, counts: np.ndarray, wanted: int):
    """Blocks of queries with the cells of each: the nearest ones that together have the wanted rows, as a map of bits."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vectors = opened(row)[3]
                chosen = np.zeros((len(vectors), len(cells)), bool)
                if vectors.shape[1] == centres.shape[1]:
                    order = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")
                    before = np.cumsum(counts[order], axis=1) - counts[order]
                    np.put_along_axis(chosen, order, before < wanted, axis=1)
                yield pa.RecordBatch.from_pylist([row | {"chosen": np.packbits(chosen, axis=1).tobytes()}], _CHOSEN_ARROW)

    return run


_CHOSEN = exact.BLOCK + ", chosen binary"
_CHOSEN_ARROW = pa.schema([*exact._BLOCK, ("chosen", pa.binary())])


def _pack_cells(batches):
    """Rows of the index as blocks, with the cell of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, exact.ROW_BLOCK):
            part = batch.slice(at, exact.ROW_BLOCK)
            for dim, places, values in by_dimension(part.column(2)):
                mine = part.take(pa.array(places))
                order = np.argsort(mine.column(3).to_numpy(), kind="stable")
                mine = mine.take(pa.array(order))
                row = {"dim": dim, "ids": mine.column(0).to_pylist(), "tags": mine.column(1).to_pylist(), "vectors": unit_vectors(values[order]).tobytes(), "cells": mine.column(3).to_pylist()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([*exact._BLOCK, ("cells", pa.list_(pa.int32()))]))


def _compare(k: int, cells: np.ndarray):
    """Compare each row with the queries that have chosen its cell; rows of NO_CELL with all."""

    def run(batches):
        best: dict[bytes, tuple[TopK, np.ndarray]] = {}
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                key = hashlib.blake2b(np.array(row["q_ids"], np.int64).tobytes() + row["q_vectors"], digest_size=16).digest()
                if key not in best:
                    queries = TopK(row["q_ids"], opened(row, "q_")[3], k)
                    chosen = np.frombuffer(row["q_chosen"], np.uint8).reshape(len(queries.ids), -1)  # bits, as cells number with the rows
                    best[key] = queries, chosen
                queries, chosen = best[key]
                block, of = opened(row), np.array(row["cells"])
                names, first = np.unique(of, return_index=True)
                for name, start, stop in zip(names, first, [*first[1:], len(of)]):
                    column = np.searchsorted(cells, name)
                    asked = np.arange(len(queries.ids)) if name == NO_CELL else np.flatnonzero(chosen[:, column >> 3] & (128 >> (column & 7)))
                    queries.meet(*(x[start:stop] for x in block), asked=asked)
        for kept, _ in best.values():
            yield kept.found()

    return run


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, chunks: DataFrame | None = None, scope: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """Nearest chunks of each query (query_id, q) by the index at path: query_id, rank, chunk_id, document_id, score.

    A query looks into its nearest cells until they hold `share` of the rows, CANDIDATES * k and
    LEAST_CANDIDATES rows; exact cosine ranks what is there. scope (document_id) is applied before:
    only its rows count and are compared. Cells that no query has chosen are not read. The driver gets
    the centres, one count for each cell and the chosen cells, CENTRE_BYTES at most; neither rows nor
    scores. With an index that is missing or cannot be read, chunks are searched exactly, if given.
    """
    try:
        found = versions.manifest(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        rows = indexed_rows(spark, path, found["version"])
        listed = sorted(spark.read.schema("cell int, centre binary, rows bigint").parquet(f"{path}/{found['folders'][1]}").collect())
        counts = {r["cell"]: r["rows"] for r in listed}
        if scope is not None:
            rows = rows.join(scope.select("document_id").distinct(), "document_id", "left_semi").select("chunk_id", "document_id", "embedding", "cell")
            counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row for each cell
    except Exception:
        if chunks is None:
            raise
        rows = chunks if scope is None else chunks.join(scope.select("document_id").distinct(), "document_id", "left_semi")
        return exact.nearest(rows, queries, k)
    cells = np.array([r["cell"] for r in listed], np.int32)
    centres = np.array([np.frombuffer(r["centre"]) for r in listed]).reshape(len(cells), -1)
    sizes = np.array([counts.get(c, 0) for c in cells.tolist()], np.int64)
    wanted = max(CANDIDATES * k, LEAST_CANDIDATES, ceil(share * sizes.sum()))
    asked = exact.blocks_of(exact.few_blocks(queries).where("query_id is not null"), F.col("query_id"), F.lit(None), F.col("q"), exact.QUERY_BLOCK)
    asked = asked.mapInArrow(_choose(centres, cells, sizes, wanted), _CHOSEN)
    union = np.zeros(len(cells), bool)
    for bits in _any_of(asked, len(cells)):
        union |= bits
    looked = [NO_CELL, *cells[union].tolist()]
    if len(looked) <= len(cells):
        rows = rows.where(F.col("cell").isin(looked))
    tasks = max(spark.sparkContext.defaultParallelism, int(sum(counts.get(c, 0) for c in looked)) // TASK_ROWS)  # many cells are small files
    rows = rows.where("chunk_id is not null").select("chunk_id", "document_id", "embedding", "cell").coalesce(tasks)
    blocks = rows.mapInArrow(_pack_cells, exact.BLOCK + ", cells array<int>")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]).hint("rebalance")
    met = blocks.crossJoin(asked).mapInArrow(_compare(k, cells), exact.FOUND)
    return exact.ranked(met, k).select("query_id", "rank", "chunk_id", "document_id", "score")


def _any_of(asked: DataFrame, cells: int):
    """The cells that any query of a task has chosen, one map of bits for each task."""

    def run(batches):
        union = np.zeros(-(-cells // 8), np.uint8)
        for batch in batches:
            for chosen in batch.column(0).to_pylist():
                union |= np.bitwise_or.reduce(np.frombuffer(chosen, np.uint8).reshape(-1, len(union)), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([union.tobytes()], pa.binary())], ["chosen"])

    for row in asked.select("chosen").mapInArrow(run, "chosen binary").collect():
        yield np.unpackbits(np.frombuffer(row["chosen"], np.uint8), count=cells).astype(bool)
