"""SimHash near-duplicates through a Gray-ordered hierarchical index of fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, materialize, modest_batches, release, stars

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Ranges of the index, whatever the number of words: what the driver and every task hold of it is one
#: (mask, pattern) for each range, and a word goes to the same share of them at every size.
RANGES = 256
LEAF = 32
FAN = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles as an unsigned number; 0 when it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(sizes)])
    begin, end = start[:n].tolist(), (start[shingle:] - 1).tolist()
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin, end)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(2)
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "key", "fp"])


def _key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): each document's id, a hash of its text, and its fingerprint as a signed bigint."""
    narrow = modest_batches(docs).select(
        F.col(id_col).cast("bigint").alias("doc_id"), _key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")
    )
    return narrow.mapInArrow(_fingerprints, "doc_id bigint, key bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_rank_column(fp: Column) -> Column:
    """The same for a bigint column, with the sign bit turned so that signed order is the order of ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """Tree over (mask, pattern) nodes in Gray order, each upper node holding the bits that all below it share."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray, leaf: int = LEAF):
        self.levels, self.fans = [(mask, pattern & mask)], []
        fan = leaf
        while len(mask) > 1:
            cuts = np.arange(0, len(mask), fan)
            high, low = np.bitwise_or.reduceat(pattern, cuts), np.bitwise_and.reduceat(pattern, cuts)
            mask = np.bitwise_and.reduceat(mask, cuts) & ~(high ^ low)
            pattern = low & mask
            self.levels.append((mask, pattern))
            self.fans.append(fan)
            fan = FAN
        #: Nodes looked at and nodes left with all that is below them, over all searches.
        self.seen = self.pruned = 0

    def search(self, words: np.ndarray, max_bits: int, block: int = 2048):
        """Yield (index of word, leaf) for all leaves whose shared bits differ from a word's in at most max_bits places.

        A word goes down with the differences met so far; each node adds those in the bits that
        it fixes and its parent does not, and a sum over max_bits ends the way for all below.
        """
        top_mask, top_pattern = self.levels[-1]
        for at in range(0, len(words) if len(top_mask) else 0, block):
            query = np.arange(at, min(len(words), at + block))
            node, gone = np.zeros(len(query), np.int64), np.bitwise_count((words[query] ^ top_pattern[0]) & top_mask[0])
            for depth in range(len(self.levels) - 1, -1, -1):
                near = gone <= max_bits
                self.seen, self.pruned = self.seen + len(near), self.pruned + int((~near).sum())
                query, node, gone = query[near], node[near], gone[near]
                if not depth:
                    break
                (mask, _), (below, pattern), fan = self.levels[depth], self.levels[depth - 1], self.fans[depth - 1]
                first = node * fan
                count = np.minimum(first + fan, len(below)) - first
                parent = np.repeat(np.arange(len(node)), count)
                child = first[parent] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                more = np.bitwise_count((words[query[parent]] ^ pattern[child]) & below[child] & ~mask[node[parent]])
                query, gone, node = query[parent], gone[parent] + more, child
            yield query, node


def gray_pairs(fps: np.ndarray, max_bits: int = MAX_BITS):
    """Yield index pairs (i < j) of Gray-sorted distinct fingerprints within max_bits."""
    tree = GrayTree(np.full(len(fps), ~np.uint64(0)), fps)
    for i, j in tree.search(fps, max_bits):
        yield i[i < j], j[i < j]


def _range_rows(bounds: list[int]):
    """(fp, rank, range) by the places of the bounds, of which there are fewer than RANGES."""

    def run(batches):
        for batch in batches:
            rank = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.searchsorted(bounds, rank).astype(np.int64))], ["fp", "rank", "range"])

    return run


def _visit_rows(ranges: list[tuple[int, int, int]], max_bits: int):
    """(range, own, fp) for each word: its own range, and those after it that may hold words within max_bits.

    ranges has (number, mask, pattern) of at most RANGES ranges in Gray order.
    """
    numbers, mask, pattern = (np.array(c, np.int64) for c in zip(*ranges))

    def run(batches):
        tree = GrayTree(mask.view(np.uint64), pattern.view(np.uint64), FAN)
        for batch in batches:
            fps, own = (batch.column(i).to_numpy() for i in (0, 1))
            for word, leaf in tree.search(fps.view(np.uint64), max_bits):
                to, mine = numbers[leaf], own[word]
                go = to >= mine
                columns = [to[go], (to[go] != mine[go]).astype(np.int32), fps[word[go]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["range", "guest", "fp"])

    return run


def _match_rows(max_bits: int):
    """Star edges of each range: its words among themselves and with the guests sent to it.

    Rows come sorted by (range, guest, rank), so that a range's words are there before its guests.
    """

    def links(tree, members, words, own):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in tree.search(words, max_bits):
            keep = words[i] < members[j] if own else slice(None)  # a pair of one range is met twice
            a, b = stars(np.concatenate([a, words[i][keep].view(np.int64)]), np.concatenate([b, members[j][keep].view(np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        number, held, tree, members = None, [], None, None
        for batch in batches:
            where, guest, fps = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]) | (guest[1:] != guest[:-1])) + 1).tolist(), len(fps)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = fps[start:stop].view(np.uint64)
                if where[start] != number:
                    if held:
                        members = np.concatenate(held)
                        tree = GrayTree(np.full(len(members), ~np.uint64(0)), members)
                        yield links(tree, members, members, True)
                    number, held, tree = where[start], [], None
                if not guest[start]:
                    held.append(part)
                    continue
                if tree is None:
                    members = np.concatenate(held)
                    tree = GrayTree(np.full(len(members), ~np.uint64(0)), members)
                    yield links(tree, members, members, True)
                    held = []
                yield links(tree, members, part, False)
        if held:
            members = np.concatenate(held)
            yield links(GrayTree(np.full(len(members), ~np.uint64(0)), members), members, members, True)

    return run


def simhash_links(fps: DataFrame, max_bits: int = MAX_BITS, ranges: int = RANGES) -> DataFrame:
    """Edges (a, b) between fingerprints that join all those within max_bits; fps has one row (fp) for each distinct one.

    The words are parted by Gray rank into ranges of about equal size. The bits that a range's words
    share are its summary; the summaries are the leaves of the index's upper tree, down
    which every word is sent. It goes to the ranges that are left, and in each of them down
    the lower tree over the range's words. Both trees leave whole groups by the differences met.
    """
    rows = fps.select("fp", gray_rank_column(F.col("fp")).alias("rank"))
    fractions = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    bounds = rows.agg(F.percentile_approx("rank", fractions, F.lit(40 * ranges))).first()[0] or []  # fewer than `ranges`
    parted = materialize(rows.mapInArrow(_range_rows(sorted(set(bounds))), "fp bigint, rank bigint, range bigint"), "ranges")
    shared = parted.groupBy("range").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
    summaries = shared.select("range", F.bitwise_not(F.col("low").bitwiseXOR(F.col("high"))).alias("mask"), "low").orderBy("range").collect()  # one for each range
    if not summaries:
        return materialize(parted.select(F.col("fp").alias("a"), F.col("fp").alias("b")), "links")
    listed = [(r["range"], r["mask"], r["low"]) for r in summaries]
    visits = parted.select("fp", "range").mapInArrow(_visit_rows(listed, max_bits), "range bigint, guest int, fp bigint")
    dealt = visits.repartition("range").sortWithinPartitions("range", "guest", gray_rank_column(F.col("fp")))
    links = materialize(dealt.mapInArrow(_match_rows(max_bits), "a bigint, b bigint"), "links")
    release(parted)
    return links


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, key, fp), key being a hash of the text, and (fp, group), group being the smallest word of it."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    words = materialize(prints.select("fp").distinct(), "distinct")
    links = simhash_links(words, max_bits)
    merged = components(links)
    named = materialize(
        words.join(merged, words["fp"] == merged["node"], "left").select("fp", F.coalesce("component", "fp").alias("group")), "groups"
    )
    release(words, links, merged)
    return prints, named


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Near-duplicate groups of documents: (doc_id, fingerprint, component_id), one row per row of docs.

    Defined results: a null or empty text, or one without words, has fingerprint 0 and
    is linked like any other; repeated rows give repeated result rows; rows that share an id
    and differ in text are grouped each by its own; a null id keeps its row, with
    component_id taken from the group's smallest id (null if the group has
    none); an empty table gives no rows; other columns of docs are not read.
    """
    prints, named = _grouped(docs, id_col, text_col, max_bits)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("group").agg(F.min("least").alias("component_id"))
    by_word = materialize(named.join(least, "group").select("fp", "component_id"), "named")
    release(named)
    return prints.join(by_word, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, without all but one document of each SimHash group.

    The document of smallest id stays, of several rows with that id the one whose text has the
    smallest hash, once if it is repeated; rows without an id, which no group can name, stay.
    Only the ids and text hashes of the kept documents meet the table again; rows that are
    repeated, if any, are the only ones that are shuffled whole to be told apart.
    """
    prints, named = _grouped(docs, id_col, text_col, max_bits)
    own = F.struct("doc_id", "key")
    by_word = prints.where("doc_id is not null").groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    kept = by_word.join(named, "fp").groupBy("group").agg(F.min_by(F.struct("doc_id", "key", "n"), own).alias("kept"))
    kept = materialize(kept.select(F.col("kept.doc_id").alias("__id"), F.col("kept.key").alias("__key"), F.col("kept.n").alias("__n")), "kept")
    release(prints, named)
    here = (docs[id_col].cast("bigint") == F.col("__id")) & (_key(docs[text_col]) == F.col("__key"))
    named_rows = docs.join(kept.where("__n = 1"), here, "left_semi")
    if kept.where("__n > 1").limit(1).count():
        named_rows = named_rows.unionByName(docs.join(kept.where("__n > 1"), here, "left_semi").dropDuplicates([id_col]))
    return named_rows.unionByName(docs.where(F.col(id_col).cast("bigint").isNull()))
