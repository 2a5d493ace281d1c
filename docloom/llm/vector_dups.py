"""Embedding near-duplicates by passes of random projection trees."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, materialize, release

COSINE = 0.9
#: Rows of a cell, all of which meet one another.
CELL = 4096
#: Share of the pairs just at the threshold that some pass must bring together.
RECALL = 0.97
SEED = 20
#: Rows that medians are found on at once, by the driver for the first levels and by a task for those below a node, and of these per cell.
SAMPLE_ROWS = 32_768
SAMPLE_OF_CELL = 32
#: Parts that the rows of one node are dealt to while they are coded by the medians below it.
SALTS = 16
TILE = 1024
#: Passes of one round at most; rounds follow until no row is left.
ROUND_PASSES = 24


def passes_for(rows: int, cosine: float = COSINE, block: int = CELL, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with the wanted probability, if all vectors are evenly spread.

    Two vectors agree in a random sign with probability 1 - angle / pi, and cells of a block
    lie log2(rows / block) signs deep. For vectors that stand closer see `vector_links`.
    """
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    together = agree ** max(0.0, math.ceil(math.log2(max(1, rows) / block)))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(together, 1 - 1e-9))))


def _direction(which: int, dim: int, level: int) -> np.ndarray:
    return np.random.default_rng([SEED, which, dim, level]).standard_normal(dim)


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of great numbers overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def _medians(x: np.ndarray, which: int, levels: range) -> list[np.ndarray]:
    """For each level the medians at which its nodes are split, by rows of a sample."""
    node, out = np.zeros(len(x), np.int64), []
    for n, level in enumerate(levels):
        p = x @ _direction(which, x.shape[1], level)
        order = np.lexsort([p, node])
        ends = np.searchsorted(node[order], np.arange((1 << n) + 1))
        middle = np.minimum((ends[:-1] + ends[1:]) // 2, len(x) - 1)
        out.append(p[order][middle])
        node = 2 * node + (p > out[-1][node])
    return out


def _fall(x: np.ndarray, which: int, first: int, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cell below a node that each vector falls into by the medians of the levels from `first`, and its distance from each."""
    cell, margins = np.zeros(len(x), np.int64), np.zeros((len(x), len(cuts)), np.float32)
    for n, at in enumerate(cuts):
        apart = x @ _direction(which, x.shape[1], first + n) - at[cell]
        margins[:, n] = np.abs(apart)
        cell = 2 * cell + (apart > 0)
    return cell, margins


_ROW = ["pass", "dim", "cell", "rep", "vector", "margins"]


def _lists(margins: np.ndarray) -> pa.Array:
    return pa.array(list(margins), pa.list_(pa.float32()))


def _by_dim(lists: pa.Array):
    dims = pa.compute.list_value_length(lists).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, pa.array(np.flatnonzero(dims == dim))


def _coded(cuts: dict[tuple[int, int], list[np.ndarray]], passes: range):
    """Each vector once per pass with the cell it falls into by the first levels."""

    def run(batches):
        for batch in batches:
            reps, lists = batch.column(0), batch.column(1)
            for dim, rows in _by_dim(lists):
                x = _unit(lists.take(rows), dim)
                for k in passes:
                    cell, margins = _fall(x, k, 0, cuts.get((dim, k), []))
                    head = [pa.array(np.full(len(rows), v, np.int32)) for v in (k, dim)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(cell), reps.take(rows), lists.take(rows), _lists(margins)], _ROW)

    return run


def _node_cuts(first: dict[int, int], depth: dict[int, int]):
    """The medians below one node, from a sample of its rows: all levels' in one binary."""

    def run(rows: pa.Table) -> pa.Table:
        k, dim, cell = (rows[c][0].as_py() for c in ("pass", "dim", "cell"))
        x = _unit(rows["vector"].combine_chunks(), dim)
        cuts = np.concatenate([np.zeros(0), *_medians(x, k, range(first[dim], first[dim] + depth[dim]))])
        return pa.table({"pass": pa.array([k], pa.int32()), "dim": pa.array([dim], pa.int32()), "cell": [cell], "cuts": pa.array([cuts.tobytes()], pa.binary())})

    return run


def _coded_below(first: dict[int, int], depth: dict[int, int]):
    """Rows that come sorted by node, its medians first, with the cell below the node that each falls into."""

    def run(batches):
        node, cuts = None, []
        for batch in batches:
            k, dim, cell = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1])))
            for at, stop in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
                now = (int(k[at]), int(dim[at]), int(cell[at]))
                if now != node:
                    node, cuts = now, []
                part = batch.slice(at, stop - at)
                for held in part.column("cuts").drop_null():
                    flat = np.frombuffer(held.as_buffer())
                    cuts = np.split(flat, np.cumsum(1 << np.arange(depth[now[1]]))[:-1]) if len(flat) else []
                part = part.filter(part.column("rep").is_valid())
                if not part.num_rows:
                    continue
                below, margins = _fall(_unit(part.column("vector"), now[1]), now[0], first[now[1]], cuts)
                if not len(cuts):  # no row of the sample lies here: few rows do
                    margins = np.zeros((part.num_rows, 0), np.float32)
                deeper = pa.array(part.column("cell").to_numpy() << depth[now[1]]) if not len(cuts) else pa.array((part.column("cell").to_numpy() << depth[now[1]]) + below)
                old = part.column("margins").to_pylist()
                joined = pa.array([a + b for a, b in zip(old, margins.tolist())], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), deeper, part.column("rep"), part.column("vector"), joined], _ROW)

    return run


def _split_further(coded: DataFrame, counts: dict[int, int], done: dict[int, int], wanted: dict[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """Rows coded down to the wanted depth, as many levels at a time as a sample of SAMPLE_ROWS of a node bears, and the tables on the way.

    The medians below a node are found by a task on a sample of the node's rows and travel with its
    rows, which are dealt by node and salt and are coded as they stream past; no node is gathered.
    """
    schema, tables = ", ".join(f"{n} {t}" for n, t in coded.dtypes), []
    most = int(math.log2(SAMPLE_ROWS / SAMPLE_OF_CELL))
    done = {d: done.get(d, 0) for d in counts}
    while any(done[d] < wanted[d] for d in wanted):
        depth = {d: min(max(wanted.get(d, 0) - done[d], 0), most) for d in counts}
        coded = materialize(coded, "nodes")
        tables.append(coded)
        share = F.lit(1)
        for d, n in counts.items():
            share = F.when(F.col("dim") == d, max(1, (n >> done[d]) // (SAMPLE_OF_CELL << depth[d]))).otherwise(share)
        sample = coded.where(F.pmod(F.xxhash64("rep", "pass"), share) == 0)
        cuts = sample.groupBy("pass", "dim", "cell").applyInArrow(_node_cuts(dict(done), depth), "pass int, dim int, cell bigint, cuts binary")
        everywhere = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = coded.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).unionByName(everywhere, allowMissingColumns=True)
        by = ["pass", "dim", "cell", "salt"]
        coded = rows.repartition(*by).sortWithinPartitions(*by, F.desc_nulls_last("cuts")).select(*_ROW, "cuts").mapInArrow(_coded_below(dict(done), depth), schema)
        done = {d: done[d] + depth[d] for d in counts}
    return coded, tables


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to three places."""
    return 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))


def _chance_missed(x: np.ndarray, margins: np.ndarray, cosine: float) -> np.ndarray:
    """Logarithm of the chance that a pair at the threshold does not share each row's cell.

    Rows close by stand around a common centre at the squared distance 1 - (their cosine).
    About it, a pair at the threshold has a cosine of `k`, so the partner of a row that lies
    `margin` from a split is on the same side by a normal distribution. Where all that is
    close links, `k` is 0: the partner may lie on either side.
    """
    if not margins.shape[1]:
        return np.full(len(x), math.log(1e-9))
    some = np.arange(0, len(x), max(1, len(x) // 256))
    near = x @ x[some].T
    near[some, np.arange(len(some))] = -1
    top = min(8, max(1, len(some) - 1))
    spread = np.maximum(1 - np.partition(near, -top, axis=1)[:, -top:].mean(axis=1), 1e-6)
    k = np.clip(1 - (1 - cosine) / spread, 0, 0.999)
    same = _below(np.minimum((k / np.sqrt(spread * (1 - k * k)))[:, None] * margins, 6)).prod(axis=1)
    return np.log1p(-np.minimum(same, 1 - 1e-9))


def _cell_links(cosine: float, size: int):
    """(a, b, null) for each pair that links and (rep, null, chance) for each row of a cell."""

    def rows_of(a, b, chance):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, chance], ["a", "b", "chance"])

    def leaf(ids, x, margins):
        single = x.astype(np.float32)
        for i in range(0, len(x), TILE):
            for j in range(i, len(x), TILE):
                value = single[i : i + TILE] @ single[j : j + TILE].T
                p, q = np.nonzero(value >= cosine - 1e-5)
                value, p, q = value[p, q], p + i, q + j
                sure = value > cosine + 1e-5
                edge = np.flatnonzero(~sure)
                sure[edge] = np.einsum("ij,ij->i", x[p[edge]], x[q[edge]]) >= cosine
                keep = sure & (p < q)
                if keep.any():
                    a, b = ids[p[keep]], ids[q[keep]]
                    yield rows_of(np.minimum(a, b), pa.array(np.maximum(a, b), pa.int64()), pa.nulls(len(a), pa.float64()))
        yield rows_of(ids, pa.nulls(len(ids), pa.int64()), pa.array(_chance_missed(x, margins, cosine)))

    def cell_links(key, ids, x, margins):
        k, dim, _ = key
        todo = [(np.arange(len(x)), margins)]
        while todo:
            rows, margins = todo.pop()
            if len(rows) > 2 * size:
                p = x[rows] @ _direction(k, dim, margins.shape[1])
                middle = np.median(p)
                above = p > middle
                if above.any():  # else no direction tells them apart, and all meet
                    margins = np.concatenate([margins, np.abs(p - middle)[:, None]], axis=1)
                    todo += [(rows[above], margins[above]), (rows[~above], margins[~above])]
                    continue
            yield from leaf(ids[rows], x[rows], margins)

    def run(batches):
        key, held = None, []
        for batch in batches:
            head = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1).tolist(), len(head)]
            for start, stop in zip(starts, starts[1:]):
                if start == stop:
                    continue
                now = tuple(head[start].tolist())
                if now != key and held:
                    yield from cell_links(key, *(np.concatenate(part) for part in zip(*held)))
                    held = []
                key = now
                part = batch.slice(start, stop - start)
                margins = np.array(part.column(5).to_pylist(), np.float64).reshape(part.num_rows, -1)
                held.append((part.column(3).to_numpy(), _unit(part.column(4), now[1]), margins))
        if held:
            yield from cell_links(key, *(np.concatenate(part) for part in zip(*held)))

    return run


def vector_links(vectors: DataFrame, cosine: float = COSINE, passes: int | None = None, cell: int = CELL) -> DataFrame:
    """A table of the pairs (a < b) of rep numbers of (rep, vector) rows, all vectors valid and different, with at least that cosine.

    Every pass sorts all vectors into cells by their products with its own random directions,
    each node of the tree split at its median, so that a crowd is split inside itself and no
    cell grows with it or with the table: below the levels that the driver has medians for,
    nodes are split by medians found in tasks. All rows of a cell meet. A row is done when, by its own distances from
    the splits and by how close its neighbours stand, a pair at the threshold has met with
    probability RECALL or little less; the others go through a further round, and as soon as no
    more than a cell of them are left, all of these meet. With a number of passes there is
    one round. A pair is returned once, whatever the number of passes that met it.
    """
    left, first, found, chances, tables = vectors, 0, [], [], []
    vector_type = dict(vectors.dtypes)["vector"]
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    while True:
        counts = {r["dim"]: r["count"] for r in left.groupBy(F.size("vector").alias("dim")).count().collect()}
        rows = max(counts.values(), default=0)
        wanted_depth = {d: math.ceil(math.log2(n / cell)) for d, n in counts.items() if n > cell}
        together = agree ** max(wanted_depth.values(), default=0)
        need = math.ceil(math.log(1 - RECALL) / math.log1p(-min(together, 1 - 1e-9)))
        now = range(first, first + (passes or max(1, min(need, ROUND_PASSES))))
        depth = {d: min(n, int(math.log2(SAMPLE_ROWS / SAMPLE_OF_CELL))) for d, n in wanted_depth.items()}
        cuts: dict[tuple[int, int], list[np.ndarray]] = {}
        for dim, levels in depth.items():
            share = max(1, counts[dim] // (SAMPLE_OF_CELL << levels))
            sample = left.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(share)) == 0)).orderBy("rep").limit(2 * SAMPLE_ROWS)
            x = _unit(sample.select("vector").toArrow().column(0).combine_chunks(), dim)
            cuts.update({(dim, k): _medians(x, k, range(levels)) for k in now if len(x)})
        schema = f"pass int, dim int, cell bigint, rep bigint, vector {vector_type}, margins array<float>"
        coded = left.select("rep", "vector").mapInArrow(_coded(cuts, now), schema)
        coded, on_the_way = _split_further(coded, counts, depth, wanted_depth)
        dealt = coded.repartition("pass", "dim", "cell").sortWithinPartitions("pass", "dim", "cell", "rep")
        met = materialize(dealt.mapInArrow(_cell_links(cosine, cell), "a bigint, b bigint, chance double"), "met")
        release(*on_the_way)
        tables.append(met)
        found.append(met.where("b is not null").select("a", "b"))
        first += len(now)
        if passes or rows <= cell:
            break
        chances.append(met.where("b is null").select(F.col("a").alias("rep"), "chance"))
        total = reduce(DataFrame.unionByName, chances).groupBy("rep").agg(F.sum("chance").alias("chance"))
        total = total.where(F.col("chance") > math.log(2 * (1 - RECALL)))
        left = materialize(left.select("rep", "vector").join(total, "rep"), "left")
        tables.append(left)
        mean = left.agg(F.avg("chance")).first()[0]
        if mean is None:
            break
        # agreement in one split of the rows that are left, as they had it so far
        agree = max(0.5, (1 - math.exp(mean / first)) ** (1 / max(1, max(wanted_depth.values()))))
    out = materialize(reduce(DataFrame.union, found).distinct(), "links")
    release(*tables)
    return out


def vector_groups(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, passes: int | None = None
) -> DataFrame:
    """Near-duplicate groups of vectors: (vec_id, n_links, component_id, kept), one row per row of embeddings.

    Equal vectors are one class and compared once; n_links counts the other rows linked
    directly, equal ones included. Vectors of unlike length never link.

    Defined results: a vector that is null, empty, all zero or holds a null or non-finite
    component, and a row without an id, links with nothing and is its own group (kept, if
    it has an id); repeated rows are equal vectors; rows that share an id and differ in their
    vector are rows of their own, each with its links and the smallest id that it reaches;
    an empty table gives no rows; other columns are not read. Cosines are of double precision.
    """
    kind = "array<float>" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "array<double>"
    vector = F.col(vector_col).cast(kind)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        vector.alias("vector"),
        F.coalesce(finite & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False)).alias("valid"),
        F.xxhash64(vector).alias("k1"),
        F.xxhash64(F.lit(1), vector).alias("k2"),
    )
    valid = rows.where("valid")
    counted = valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    classes = materialize(counted.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = vector_links(classes.select("rep", "vector"), cosine, passes)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("rep").alias("b"), "n")
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    linked = components(links)
    merged = linked.select(F.col("node").alias("rep"), "component")
    grouped = materialize(
        classes.select("k1", "k2", "rep", "least", "n").join(degree, "rep", "left").join(merged, "rep", "left").select(
            "k1", "k2", "least", F.coalesce("component", "rep").alias("component"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
        ),
        "grouped",
    )
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(smallest, "component").select("k1", "k2", "n_links", "component_id"), "named")
    release(classes, links, linked, grouped)
    found = valid.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
