"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, modest_batches, release
from docloom.llm.rolling import Prefix, WordBuffer, by_bytes, small

SEED_WORDS = 5
COVERAGE = 0.8
#: Bits of the map of benchmark seeds that travels with the tasks: its size is fixed, whatever the benchmark's.
MAP_BITS = 26
#: Candidate items that one row brings to a document's text.
ITEMS_AT_ONCE = 256
_CHUNK_WORDS = 100_000
_BLOCK_BYTES = 1 << 21

#: ASCII letters in lower case, ASCII signs and white space as spaces, other bytes unchanged.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, ASCII letters in lower case."""
    return (text or "").encode().translate(_PLAIN).split()


class _Words:
    """Hashes of all runs of words of one text."""

    def __init__(self, words: list[bytes]):
        self.words = words
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.prefix = Prefix(b" ".join(words))

    def runs(self, size: int) -> np.ndarray:
        """Hash of the run of `size` words from each word on."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return self.prefix.of(self.start[:n], self.start[size : size + n] - 1)


def seed_hashes(words: list[bytes], size: int = SEED_WORDS) -> np.ndarray:
    """Hash of each run of `size` consecutive words."""
    return _Words(words).runs(size)


def _free_runs(used: np.ndarray, size: int) -> np.ndarray:
    """Places from which `size` places are all unused."""
    if len(used) < size:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(sums[size:] == sums[:-size])


def tiles(item: list[bytes], doc: list[bytes], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item place, document place, words).

    The longest run of words that is free in both texts is marked in both, the one of the
    smallest places if there are several, and so on down to `least` words. Runs of one
    length are compared by Karp-Rabin hashes; the longest length is found by halving, as
    texts that share a run share all shorter ones; equal hashes are not taken on trust.
    No list of all matching places is made, so repetitive texts cost no more than others.
    """
    seeds, own = seed_hashes(item, least), seed_hashes(doc, least)
    near = np.zeros(len(doc) + 1, np.int64)
    for k in np.flatnonzero(np.isin(own, seeds)).tolist():
        near[k] += 1
        near[k + least] -= 1
    near = np.cumsum(near)[:-1] > 0
    kept = np.flatnonzero(near | np.concatenate([[False], near[:-1]]))  # and one word after each stretch, to part them
    a, b = _Words(item), _Words([doc[k] for k in kept.tolist()])
    used_a, used_b = np.zeros(len(item), bool), ~near[kept]
    out: list[tuple[int, int, int]] = []

    def shared(size: int) -> bool:
        return bool(np.isin(a.runs(size)[_free_runs(used_a, size)], b.runs(size)[_free_runs(used_b, size)]).any())

    size = min(len(item), len(b.words))
    while size >= least and shared(least):
        low, high = least, size
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        size = low
        free_a, free_b = _free_runs(used_a, size), _free_runs(used_b, size)
        hash_a, hash_b = a.runs(size)[free_a], b.runs(size)[free_b]
        places: dict[int, list[int]] = {}
        common = np.isin(hash_b, hash_a)
        for h, j in zip(hash_b[common][::-1].tolist(), free_b[common][::-1].tolist()):
            places.setdefault(h, []).append(j)
        common = np.isin(hash_a, hash_b)
        for h, i in zip(hash_a[common].tolist(), free_a[common].tolist()):
            if used_a[i : i + size].any():
                continue
            found = places[h]
            while found:
                j = found[-1]
                if used_b[j : j + size].any() or item[i : i + size] != b.words[j : j + size]:
                    found.pop()
                    continue
                used_a[i : i + size] = used_b[j : j + size] = True
                out.append((i, int(kept[j]), size))
                break
        size -= 1
    return out


def covered_share(item: list[bytes], doc: list[bytes], least: int = SEED_WORDS) -> float:
    """Share of an item's words that tiles cover."""
    return sum(n for *_, n in tiles(item, doc, least)) / len(item)


def _item_rows(batches):
    for batch in batches:
        plain = [b" ".join(words) if len(words := plain_words(t.as_py())) >= SEED_WORDS else None for t in batch.column(1)]
        keep = pa.array([p is not None for p in plain], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary())], ["item_id", "plain"]).filter(keep)


def _item_seeds(batches):
    for batch in batches:
        for item, plain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seeds = np.unique(seed_hashes(plain.split())).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(seeds), pa.int64()), pa.array(seeds)], ["item", "seed"])


def _seeds_of(texts: list[str | None], keep):
    """(index of text, seed) once for each text and each of its seeds that keep() lets pass; long texts go by overlapping parts."""
    raw = [(t or "").encode() for t in texts]
    for block in by_bytes([len(t) for t in raw], _BLOCK_BYTES):
        if block.stop - block.start == 1 and len(raw[block.start]) > _BLOCK_BYTES:
            words = plain_words(texts[block.start])
            found = [np.zeros(0, np.uint64)]
            for at in range(0, max(1, len(words) - SEED_WORDS + 1), _CHUNK_WORDS):
                h = seed_hashes(words[at : at + _CHUNK_WORDS + SEED_WORDS - 1])
                found.append(np.unique(h[keep(h)]))
            seeds = np.unique(np.concatenate(found))
            yield np.full(len(seeds), block.start), seeds
            continue
        buffer = WordBuffer(raw[block], _PLAIN)
        word, text = buffer.runs(SEED_WORDS)
        hashes = buffer.hashes(word, SEED_WORDS)
        hit = np.flatnonzero(keep(hashes))
        hit = hit[np.lexsort([hashes[hit], text[hit]])]
        if len(hit):
            first = np.concatenate([[True], (hashes[hit][1:] != hashes[hit][:-1]) | (text[hit][1:] != text[hit][:-1])])
            yield text[hit][first] + block.start, hashes[hit][first]


def _hit_rows(bits):
    """(k1, k2, seed) for the seeds of each text that may be seeds of the benchmark."""

    def run(batches):
        known = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        keep = lambda h: known[h >> np.uint64(64 - MAP_BITS)]
        for batch in small(batches):
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for text, seeds in _seeds_of([t.as_py() for t in batch.column(2)], keep):
                yield pa.RecordBatch.from_arrays([pa.array(k1[text]), pa.array(k2[text]), pa.array(seeds.view(np.int64))], ["k1", "k2", "seed"])

    return run


def key_seeds(words: list[bytes], weight: dict[int, int], coverage: float = COVERAGE) -> list[int]:
    """The rarest seeds of an item such that all others together lie in less than `coverage` of its words.

    A text that covers the item must hold one of them.
    """
    seeds = seed_hashes(words).view(np.int64).tolist()
    at: dict[int, list[int]] = {}
    for place, seed in enumerate(seeds):
        at.setdefault(seed, []).append(place)
    covered, most = np.zeros(len(words), bool), coverage * len(words)
    order = sorted(at, key=lambda s: (weight.get(s, 0), s))
    for k in range(len(order) - 1, -1, -1):
        for place in at[order[k]]:
            covered[place : place + SEED_WORDS] = True
        if covered.sum() >= most - 1e-9:
            return order[: k + 1]
    return []


def _key_rows(coverage: float):
    def run(batches):
        for batch in batches:
            for item, plain, listed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys = key_seeds(plain.split(), {s["seed"]: s["weight"] for s in listed}, coverage)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), pa.int64()), pa.array(keys, pa.int64())], ["item", "seed"])

    return run


def _share_rows(batches):
    """(k1, k2, item, share) for the items that a row brings to a text."""
    for batch in small(batches, 64):
        for k1, k2, text, items in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = plain_words(text)
            shares = [covered_share(i["plain"].split(), words) for i in items]
            n = len(items)
            columns = [pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array([i["item"] for i in items], pa.int64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "item", "share"])


def _text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits of hash that stand for a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs, without columns of these names, with __k1 and __k2, the keys of the text."""
    k1, k2 = _text_keys(F.col(text_col))
    return docs.withColumn("__k1", k1).withColumn("__k2", k2)


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(k1, k2, item_id, share): the test items of which a text covers at least that share; k1 and k2 as of `_keyed`.

    Items of equal words are one. A map of bits, of a fixed size, lets pass the document
    seeds that may be in the benchmark; those are joined with the key seeds of the items, the
    rarest ones without which an item cannot be covered, so that a phrase of many items or
    documents brings no candidates; the candidates are tiled. Nothing else than the map
    reaches the driver.
    """
    spark = docs.sparkSession
    named = modest_batches(benchmark).select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    rows = materialize(named.mapInArrow(_item_rows, "item_id bigint, plain binary"), "rows")
    items = materialize(rows.select("plain").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = materialize(items.select("item", "plain").mapInArrow(_item_seeds, "item bigint, seed bigint"), "seeds")
    place = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    words = seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int").bitwiseAND(63))).alias("bits"))
    table = words.toArrow()  # at most 2^MAP_BITS / 64 rows
    bits = np.zeros((1 << MAP_BITS) // 64, np.int64)
    bits[table.column(0).to_numpy()] = table.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(bits.tobytes())
    texts = _keyed(modest_batches(docs).select(F.col(text_col).cast("string").alias("text")), "text").select("__k1", "__k2", "text")
    hits = materialize(texts.mapInArrow(_hit_rows(shared), "k1 bigint, k2 bigint, seed bigint"), "hits")
    in_docs = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n_docs"))
    in_items = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n_items"))
    weights = in_items.join(in_docs, "seed", "left").select("seed", (F.col("n_items") * F.coalesce("n_docs", F.lit(0))).alias("weight"))
    listed = seeds.join(weights, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "weight")).alias("listed"))  # seeds of one item
    keys = materialize(
        items.join(listed, "item").select("item", "plain", "listed").mapInArrow(_key_rows(coverage), "item bigint, seed bigint"), "keys"
    )
    pairs = materialize(hits.join(keys, "seed").select("k1", "k2", "item").distinct(), "pairs")
    release(hits, keys, seeds)
    many = pairs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    brought = (
        pairs.join(many, ["k1", "k2"])
        .join(items, "item")
        .groupBy("k1", "k2", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / ITEMS_AT_ONCE)).alias("part"))
        .agg(F.collect_list(F.struct("item", "plain")).alias("items"))
    )
    brought = materialize(brought, "brought")
    candidates = texts.join(brought, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))).select("k1", "k2", "text", "items")
    shares = candidates.mapInArrow(_share_rows, "k1 bigint, k2 bigint, item bigint, share double").where(F.col("share") >= coverage - 1e-9).distinct()
    named = rows.join(items, "plain").select("item", "item_id").distinct()
    found = materialize(shares.join(named, "item").groupBy("k1", "k2", "item_id").agg(F.max("share").alias("share")), "leaks")
    release(rows, items, pairs, brought)
    return found


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_items, items, coverage, contaminated) for every row of docs.

    items lists the leaked item ids, comma-joined in numeric order; coverage is the
    largest share that a listed item has, 0 without one. Passages in another order count,
    since tiles are free to cross.

    Defined results: a null or empty text covers nothing; items under five words are
    not matched; items that share an id count once, with the larger share; items without
    an id count as one, named None and listed last; repeated rows give repeated
    results; empty tables give no rows, or no leaks; other columns are not read.
    """
    found = leaks(docs, benchmark, text_col, coverage=coverage).groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("none"), "item_id"))), lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("None"))), ","
        ).alias("items"),
        F.max("share").alias("coverage"),
    )
    rows = _keyed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text")
    joined = rows.select("doc_id", "__k1", "__k2").join(found, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"),
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns whatever their names, that cover no test item; defined results as of `decontamination`."""
    found = leaks(docs, benchmark, text_col, coverage=coverage).select("k1", "k2").distinct()
    k1, k2 = _text_keys(docs[text_col])
    return docs.join(found, (k1 == found["k1"]) & (k2 == found["k2"]), "left_anti")
