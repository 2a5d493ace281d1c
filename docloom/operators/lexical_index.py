"""A stored index of three-letter pieces that tells which texts can contain a word, so that only those are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from docloom.functions.text import normalize_lexical
from docloom.operators import versions
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a piece, and what stands for letters behind a text's end.
GRAM, END = 3, "\0"
#: Rows of texts in one folder of the index.
SHELF_ROWS = 100_000
#: Letters that a task cuts into pieces at a time (a longer text is taken whole).
BLOCK_LETTERS = 1 << 21
#: How postings are kept; an index of other ones is not read.
PACKED = "gaps"
#: Numbers of (gram, text) up to which both are sorted as one.
_AS_ONE = 1 << 62
_POSTINGS = "gram string, shelf int, first bigint, n int, gaps binary"


def searched_text(name: Column, text: Column) -> Column:
    """What words are looked for in: name and text, in lower case and without accents."""
    return normalize_lexical(F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit(""))))


def _pairs(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, index into them, text) of the different pieces of each text, by gram and text; one begins at every letter."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(t + END * (GRAM - 1) for t in texts).encode("utf-32-le"), np.uint32)
    letters = np.flatnonzero(np.bincount(codes))
    number = np.zeros(letters[-1] + 1, np.int64)
    number[letters] = np.arange(len(letters))
    dense, base = number[codes], len(letters)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(owner)) + owner * (GRAM - 1)
    gram = (dense[start] * base + dense[start + 1]) * base + dense[start + 2]  # below 2^61, as there are 1,114,112 letters
    kinds = None
    if base**GRAM >= _AS_ONE // len(texts):
        kinds, gram = np.unique(gram, return_inverse=True)
    key = gram * len(texts) + owner
    key.sort()
    gram, owner = np.divmod(key[np.concatenate([[True], key[1:] != key[:-1]])], len(texts))
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    found = gram[new] if kinds is None else kinds[gram[new]]
    joined = letters[np.stack([found // base**2, found // base % base, found % base], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return [joined[at : at + GRAM] for at in range(0, len(joined), GRAM)], np.cumsum(new) - 1, owner


def _packed_postings(chunk: np.ndarray, shelf: np.ndarray, texts: list[str]):
    """Rows (gram, shelf, first, n, gaps): the ids of a block's texts that hold a gram, as the smallest one, their number
    and the gaps between them, each in the fewest of 1, 2, 4 or 8 bytes that all of a row need."""
    order = np.lexsort((chunk, shelf))
    chunk, shelf = chunk[order], shelf[order]
    grams, which, owner = _pairs([texts[k] for k in order.tolist()])
    ids, at = chunk[owner], shelf[owner]
    first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] != at[:-1])]))
    n = np.diff(np.append(first, len(ids)))
    gaps = np.zeros(len(ids), np.uint64)
    gaps[1:] = ids[1:].astype(np.uint64) - ids[:-1].astype(np.uint64)
    gaps[first] = 0
    most = np.maximum.reduceat(gaps, first)
    width = 1 << np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 32], np.uint64), most, side="right")
    inner = np.ones(len(ids), bool)
    inner[first] = False
    names = pa.array(grams, pa.string())
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        held = gaps[inner & np.repeat(width == w, n)].astype(f"<u{w}")
        ends = np.concatenate([[0], np.cumsum((n[rows] - 1) * w)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(held.tobytes())])
        columns = [names.take(pa.array(which[first[rows]])), pa.array(at[first[rows]], pa.int32()), pa.array(ids[first[rows]]), pa.array(n[rows], pa.int32()), packed]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "shelf", "first", "n", "gaps"])


def by_size(sizes: np.ndarray, limit: int):
    """Slices of consecutive items of together at most `limit`, or of one larger item."""
    at = total = 0
    for k, size in enumerate(sizes.tolist()):
        if total + size > limit and k > at:
            yield slice(at, k)
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def _posting_rows(batches):
    """Packed postings of texts (chunk_id, shelf, t), by blocks of BLOCK_LETTERS; a text without letters has none."""
    chunks, shelves, texts, letters = [], [], [], 0
    for batch in batches:
        for chunk, shelf, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            if texts and letters + len(text) > BLOCK_LETTERS:
                yield from _packed_postings(np.array(chunks, np.int64), np.array(shelves, np.int64), texts)
                chunks, shelves, texts, letters = [], [], [], 0
            if text:
                chunks.append(chunk)
                shelves.append(shelf)
                texts.append(text)
                letters += len(text)
    if texts:
        yield from _packed_postings(np.array(chunks, np.int64), np.array(shelves, np.int64), texts)


def _unpacked(batches):
    """(piece, shelf, chunk_id) of packed postings (piece, shelf, first, n, gaps)."""
    for batch in batches:
        n = batch.column(3).to_numpy()
        for block in by_size(n, BLOCK_LETTERS):
            part = batch.slice(block.start, block.stop - block.start)
            ids = []
            for first, count, gaps in zip(*(part.column(i).to_pylist() for i in (2, 3, 4))):
                steps = np.frombuffer(gaps, f"<u{len(gaps) // (count - 1)}") if count > 1 else np.zeros(0, np.uint64)
                ids.append(np.cumsum(np.concatenate([[first], steps.astype(np.int64)])))
            own = pa.array(np.repeat(np.arange(part.num_rows), n[block]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate(ids))], ["piece", "shelf", "chunk_id"])


def build_lexical_index(chunks: DataFrame, path: str) -> int:
    """Write a new version of the index of all chunks (chunk_id, name, text) and make it current; returns its number.

    The searched texts lie in shelves that number with the rows, by a hash of the id. Postings have a row for
    each gram of a block of texts and shelf, not one for each text; they are dealt by gram and shelf, so that no
    file takes more than a shelf's part of a frequent gram, and sorted by gram, so that a reader of a few grams
    skips the others by the statistics of row groups and pages.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col("chunk_id").cast("bigint"), searched_text(F.col("name"), F.col("text")).alias("t")).where("chunk_id is not null")
    texts, postings = versions.fresh_folder(path, "texts"), versions.fresh_folder(path, "postings")
    shelves = max(1, -(-chunks.count() // SHELF_ROWS))
    shelved = rows.withColumn("shelf", F.pmod(F.xxhash64("chunk_id"), F.lit(shelves)).cast("int"))
    shelved.hint("rebalance", "shelf").write.partitionBy("shelf").parquet(texts)
    kept = spark.read.schema("chunk_id bigint, t string, shelf int").parquet(texts)
    grams = kept.select("chunk_id", "shelf", "t").mapInArrow(_posting_rows, _POSTINGS)
    grams.repartition("gram", "shelf").sortWithinPartitions("gram", "shelf").write.parquet(postings)
    folders = ["/".join(f.rsplit("/", 2)[1:]) for f in (texts, postings)]
    known = versions.versions(spark, path)
    return versions.commit(spark, path, {"folders": folders, "postings": PACKED}, known[-1] if known else 0)


def candidates(spark: SparkSession, path: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, shelf) of the texts that can contain a word of (query_id, word), all texts of the index).

    A text that contains a word has all its pieces; a word of fewer letters than a piece begins one.
    The words of the queries are a stated set, whose pieces are pushed to the scan of the postings.
    """
    found = versions.manifest(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    if found.get("postings") != PACKED:
        raise ValueError(f"{path} has postings of another form; build it again")
    texts = spark.read.schema("chunk_id bigint, t string, shelf int").parquet(f"{path}/{found['folders'][0]}")
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/{found['folders'][1]}")
    asked = [r["word"] for r in words.select("word").where(F.length("word") > 0).distinct().collect()]
    pieces = [(w, g) for w in asked for g in ({w[at : at + GRAM] for at in range(len(w) - GRAM + 1)} or {w})]
    wanted = spark.createDataFrame(pieces, "word string, piece string")
    needed = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("needed"))
    whole = sorted({g for _, g in pieces if len(g) == GRAM})
    packed = ["shelf", "first", "n", "gaps"]
    met = postings.where(F.col("gram").isin(whole)).select(F.col("gram").alias("piece"), *packed)
    for short in sorted({g for _, g in pieces if len(g) < GRAM}):
        met = met.union(postings.where(F.col("gram").startswith(short)).select(F.lit(short).alias("piece"), *packed))
    met = met.mapInArrow(_unpacked, "piece string, shelf int, chunk_id bigint").distinct()
    counted = met.join(wanted, "piece").groupBy("word", "shelf", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    able = counted.join(needed, "word").where("n = needed").select("word", "chunk_id", "shelf")
    return words.join(able, "word").select("query_id", "chunk_id", "shelf").distinct(), texts
