"""Shared-folder tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_folder

#: Rows and bytes of an Arrow batch: texts are long, and both ends of the transfer hold a batch whole.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def modest_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of BATCH_ROWS rows and BATCH_BYTES for the session unless it sets a number of rows itself."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, or under a given path, and return a reader of it: lineage ends here.

    With `by` the rows of each value of that column are kept apart, and readers of one value skip the others.
    """
    path = path or f"{shared_folder(df.sparkSession)}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return at_path(df.sparkSession, path, df.schema)


def at_path(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A reader of a table written before, which `release` can delete."""
    out = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    out._docloom_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listed_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables in a folder, in order; none if it does not exist."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(target))
    return [n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def release(*frames: DataFrame) -> None:
    """Delete tables made by materialize that nothing will read any more, and the folder made for one of them."""
    for df in frames:
        fs, target = _file_system(df.sparkSession, df._docloom_path)
        own = target.getParent().getName().startswith("docloom-")
        fs.delete(target.getParent() if own else target, True)


def unite(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n items over the pairs (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def stars(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, smallest id) that join what the given edges join; ids are any numbers."""
    ids, where = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    label = unite(where[: len(ids_a)], where[len(ids_a) :], len(ids))
    root = ids[label]
    child = ids != root
    return ids[child], root[child]


def _contract(batches):
    """Replace a partition's edges by a star for each of its components, block by block."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = stars(
            np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)]),
            np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)]),
        )
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node is either a root or the child of one root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def _to_minimum(edges: DataFrame, least_of: DataFrame) -> DataFrame:
    """Join each edge with the smallest neighbour of its first end. least_of has one row per node."""
    low = materialize(least_of, "minimum")
    return edges.join(low, "a"), low


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges has the bigint columns a and b; direction, loops, null ends and repeated
    edges do not matter. Returns (node, component): one row for each node that is
    not the smallest of its component, component being that smallest node.

    Each task first shrinks its own edges to stars, so what is shuffled later is
    at most one row per node and task; every step is a grouped minimum (combined
    before its shuffle) and a join that adaptive execution can split, never a
    gathered neighbour list.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    now = materialize(clean.mapInArrow(_contract, "a bigint, b bigint"), "edges")
    while not _is_forest(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        joined, low = _to_minimum(
            both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        )
        large = materialize(joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        release(now, low)
        joined, low = _to_minimum(large, large.groupBy("a").agg(F.min("b").alias("m")))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(large, low)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._docloom_path = now._docloom_path
    return out
