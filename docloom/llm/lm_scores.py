"""Language-model scores: exact word counts, and two-word counts in a log-frequency Bloom filter."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, modest_batches, release

#: Bytes of text in one block, whose words are numbered together.
BLOCK_BYTES = 8 << 20
#: Tokens for each shard of the filter, words of blocks for each part of the word counts, and bytes of
#: filter that are broadcast; beyond them probes travel to the shards.
SHARD_TOKENS = 2_000_000
PART_WORDS = 1_000_000
FILTER_BYTES = 96 << 20
#: Probes of each level, and bits for each level that is set: about one false level in 60.
PROBES = 6
BITS = 9
#: Counts are held as levels 1 + floor(log(count) / log(BASE)), each level being one more set of probes.
BASE = 1.5
LEVELS = 80
#: Bits of the second word in the fingerprint of a pair.
_SECOND = np.uint64(28)

_CODED = "block bigint, ids array<{}>, held array<boolean>, sizes array<int>, words binary, high binary, low binary, counts binary, n_tokens bigint, n_words bigint"
_FOR_PAIRS = ["block", "held", "sizes", "words", "high"]


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Tokens of a text: its words with A-Z in lower case, then the end, which is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def level_of(count: np.ndarray) -> np.ndarray:
    """Level that a positive count is held as."""
    return np.minimum(1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def level_counts() -> np.ndarray:
    """What each level reads as: the mean of the whole numbers that it holds; 0 for level 0."""
    first = np.ceil(BASE ** np.arange(LEVELS + 1) - 1e-9)
    return np.concatenate([[0.0], (first[:-1] + np.maximum(first[1:] - 1, first[:-1])) / 2])


class FilterShard:
    """One shard of the log-frequency filter: a pair of level q is entered once for each level 1 to q."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.size = np.uint64(8 * len(bits))

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray) -> FilterShard:
        levels = level_of(counts)
        marks = np.zeros(64 + 8 * (int(levels.sum()) * BITS // 8), bool)
        out = cls(np.zeros(len(marks) // 8, np.uint8))
        for level in range(1, int(levels.max(initial=0)) + 1):
            for place in out._places(prints[levels >= level], level):
                marks[place] = True
        out.bits = np.packbits(marks, bitorder="little")
        return out

    def _places(self, prints: np.ndarray, level: int):
        first = spread(prints + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        step = spread(first) | np.uint64(1)
        for i in range(PROBES):
            yield (first + np.uint64(i) * step) % self.size

    def levels(self, prints: np.ndarray) -> np.ndarray:
        """The level up to which all levels of each pair are present, 0 for none."""
        out, alive = np.zeros(len(prints), np.int64), np.arange(len(prints))
        for level in range(1, LEVELS + 1):
            keep = np.ones(len(alive), bool)
            for place in self._places(prints[alive], level):
                keep &= self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
            alive = alive[keep]
            if not len(alive):
                break
            out[alive] = level
        return out


def shard_of(prints: np.ndarray, shards: int) -> np.ndarray:
    """The shard that holds a pair."""
    return ((spread(prints) >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def part_of(firsts: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts the words with these first bits."""
    return ((spread(firsts) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def word_numbers(row: dict) -> np.ndarray:
    """The numbers of a block's tokens, which are kept compressed."""
    return np.frombuffer(pa.decompress(row["words"], 4 * sum(row["sizes"]), codec="zstd"), np.int32).astype(np.int64)


def pairs_of(row: dict, training: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, place of each token's pair, print) of the distinct pairs of neighbours in a block; the end stands before each text."""
    words, sizes = word_numbers(row), np.asarray(row["sizes"], np.int64)
    high = np.frombuffer(row["high"], np.uint64)
    before = np.roll(words, 1)
    before[np.cumsum(sizes) - sizes] = words[-1]
    code = before * len(high) + words
    if training:
        code = code[np.repeat(~np.asarray(row["held"], bool), sizes)]
    distinct, place = np.unique(code, return_inverse=True)
    first, second = np.divmod(distinct, len(high))
    return first, second, place, (high[first] >> _SECOND) << _SECOND | spread(high[second]) >> (np.uint64(64) - _SECOND)


class _Block:
    """Texts that are numbered together until they have BLOCK_BYTES."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids, self.held, self.words, self.size = [], [], [], 0

    def add(self, doc, held: bool, text: str | None) -> None:
        words = words_of(text)
        self.ids.append(doc)
        self.held.append(held)
        self.words.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.size += len(text or "")

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in self.words], np.int32)
        words = np.concatenate(self.words)
        counts = np.bincount(words[np.repeat(~np.array(self.held), sizes)], minlength=len(self.vocabulary)).astype(np.int64)
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.vocabulary)), np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(kind)), pa.array([self.held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())),
            pa.array([pa.compress(words.tobytes(), codec="zstd", asbytes=True)], pa.binary()), pa.array([keys[:, 0].tobytes()], pa.binary()),
            pa.array([keys[:, 1].tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([len(counts)], pa.int64()),
        ], ["block", "ids", "held", "sizes", "words", "high", "low", "counts", "n_tokens", "n_words"])


def _code(batches):
    """Texts as blocks of word numbers with the keys and training counts of their words."""
    number, block, kind = TaskContext.get().partitionId() << 32, _Block(), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, held, text in zip(*(c.to_pylist() for c in batch.columns)):
            block.add(doc, held, text)
            if block.size > BLOCK_BYTES:
                yield block.batch(number, kind)
                number, block = number + 1, _Block()
    if block.ids:
        yield block.batch(number, kind)


def _dealt(where: np.ndarray):
    """(name, places) of the entries that go to each shard or part, in order."""
    order = np.argsort(where, kind="stable").astype(np.int32)
    names, first = np.unique(where[order], return_index=True)
    return zip(names.tolist(), np.split(order, first[1:]))


def _packets(schema: str, deal):
    """A function over Arrow batches that yields what deal gives for each row, packed as one row of binaries each."""
    kinds = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for packet in deal(row):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip(packet, kinds)], schema=kinds)

    return run


_PAIRS = "shard int, prints binary, counts binary"
_PROBES = "shard int, block bigint, places binary, prints binary"
_SHARD = "shard int, bits binary, firsts binary, followers binary, once bigint, twice bigint"
_WORDS = "part int, block bigint, places binary, high binary, low binary, counts binary"
_COUNTED = "block bigint, places binary, counts binary, followers binary, total bigint, words bigint"


def _pair_packets(shards: int):
    """The distinct pairs of a block's training texts with their counts, by shard."""

    def deal(row):
        _, _, place, prints = pairs_of(row, training=True)
        counts = np.bincount(place, minlength=len(prints)).astype(np.uint32)
        for name, part in _dealt(shard_of(prints, shards)):
            yield name, prints[part].tobytes(), counts[part].tobytes()

    return _packets(_PAIRS, deal)


def _probe_packets(shards: int):
    """The distinct pairs of all texts of a block, by shard."""

    def deal(row):
        prints = pairs_of(row, training=False)[3]
        for name, part in _dealt(shard_of(prints, shards)):
            yield name, row["block"], part.tobytes(), prints[part].tobytes()

    return _packets(_PROBES, deal)


def _word_packets(parts: int):
    """The words of a block with their training counts, by the part that adds them up."""

    def deal(row):
        high, low, counts = np.frombuffer(row["high"], np.uint64), np.frombuffer(row["low"], np.uint64), np.frombuffer(row["counts"], np.int64)
        for name, part in _dealt(part_of(high >> _SECOND, parts)):
            yield name, row["block"], part.tobytes(), high[part].tobytes(), low[part].tobytes(), counts[part].tobytes()

    return _packets(_WORDS, deal)


def _follower_packets(parts: int):
    """How many followers the first words of a shard's pairs have in it, by the part that counts the word; they have no block."""

    def deal(row):
        firsts, followers = np.frombuffer(row["firsts"], np.uint64), np.frombuffer(row["followers"], np.int64)
        for name, part in _dealt(part_of(firsts, parts)):
            yield name, None, None, firsts[part].tobytes(), None, followers[part].tobytes()

    return _packets(_WORDS, deal)


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the counts of each."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _build(packets: pa.Table) -> pa.Table:
    """One filter shard from the pairs of all blocks, with the number of followers of each first word in it."""
    prints, counts = _summed(_joined(packets["prints"], np.uint64), _joined(packets["counts"], np.uint32).astype(np.int64))
    firsts, followers = np.unique(prints >> _SECOND, return_counts=True)
    return pa.table({
        "shard": packets["shard"][:1], "bits": pa.array([FilterShard.of(prints, counts).bits.tobytes()], pa.binary()), "firsts": pa.array([firsts.tobytes()], pa.binary()),
        "followers": pa.array([followers.astype(np.int64).tobytes()], pa.binary()), "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())],
    })


def _count(packets: pa.Table) -> pa.Table:
    """Counts and followers of the words of one part, addressed to the blocks that have them, and the part's totals."""
    of_blocks = packets.filter(pa.compute.is_valid(packets["block"]))
    others = packets.filter(pa.compute.is_null(packets["block"]))
    firsts, followers = _summed(_joined(others["high"], np.uint64), _joined(others["counts"], np.int64))
    high, low, n = _joined(of_blocks["high"], np.uint64), _joined(of_blocks["low"], np.uint64), _joined(of_blocks["counts"], np.int64)
    order = np.lexsort((low, high))
    new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])) if len(order) else np.zeros(0, bool)
    sums = np.add.reduceat(n[order], np.flatnonzero(new)) if len(order) else n
    count = np.zeros(len(n), np.int64)
    count[order] = sums[np.cumsum(new) - 1] if len(order) else sums
    at = np.minimum(np.searchsorted(firsts, high >> _SECOND), max(len(firsts) - 1, 0))
    after = np.where(firsts[at] == high >> _SECOND, followers[at], 0) if len(firsts) else np.zeros(len(n), np.int64)
    ends = np.cumsum([len(x) // 8 for x in of_blocks["high"].to_pylist()])
    cut = lambda x: [y.tobytes() for y in np.split(x, ends[:-1])] if len(ends) else []
    rows = of_blocks.num_rows
    return pa.table({
        "block": pa.array([*of_blocks["block"].to_pylist(), None], pa.int64()), "places": pa.array([*of_blocks["places"].to_pylist(), None], pa.binary()),
        "counts": pa.array([*cut(count), None], pa.binary()), "followers": pa.array([*cut(after), None], pa.binary()),
        "total": pa.array([None] * rows + [int(sums.sum())], pa.int64()), "words": pa.array([None] * rows + [int((sums > 0).sum())], pa.int64()),
    })


def _answers(probes: pa.Table, shard: pa.Table) -> pa.Table:
    """Levels of the pairs that were sent to a shard, addressed to their blocks; a shard that no training pair is in has none."""
    bits = shard["bits"].to_pylist()
    read = FilterShard(np.frombuffer(bits[0], np.uint8)).levels if bits else lambda p: np.zeros(len(p), np.int64)
    levels = [read(np.frombuffer(p, np.uint64)).astype(np.int8).tobytes() for p in probes["prints"].to_pylist()]
    return pa.table({"block": probes["block"], "places": probes["places"], "levels": pa.array(levels, pa.binary())})


class Model:
    """What scoring needs besides a block's own counts: totals, the discount, and the filter or its place."""

    def __init__(self, total: int, distinct: int, once: int, twice: int, shards: int):
        self.total, self.distinct, self.shards = total, distinct, shards
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def block_scores(row: dict, count: np.ndarray, followers: np.ndarray, model: Model, levels) -> list[np.ndarray]:
    """(tokens, known tokens, base score, score) of the texts of a block.

    The probability of a word after another is by absolute discounting: the pair's count less the
    discount, over the first word's count, and what all discounts have freed shared out by the base
    probability. A pair has no more than the count of either word, so pairs of unknown words have none.
    """
    first, second, place, prints = pairs_of(row, training=False)
    words, sizes = word_numbers(row), np.asarray(row["sizes"], np.int64)
    start = np.cumsum(sizes) - sizes
    base = model.base(count)
    pair = np.minimum(level_counts()[levels(prints)], np.minimum(count[first], count[second]))
    seen = np.maximum(count[first], 1)
    after = (np.maximum(pair - model.discount, 0) + model.discount * followers[first] * base[second]) / seen
    after = np.where((count[first] > 0) & (followers[first] > 0), np.minimum(after, 1.0), base[second])
    return [sizes, np.add.reduceat((count > 0)[words].astype(np.int64), start), np.add.reduceat(np.log10(base)[words], start), np.add.reduceat(np.log10(after)[place], start)]


def _score(model: Model, broadcast, names: list[str]):
    """Scores of a block from its row and the counts of its words; levels come from the broadcast filter or with the block."""
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        place = _joined(words["places"], np.int32)
        count, followers = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], followers[place] = _joined(words["counts"], np.int64), _joined(words["followers"], np.int64)
        shards = None if broadcast is None else broadcast.value
        kind, out = blocks.schema.field("ids").type.value_type, []
        for row in blocks.to_pylist():

            def levels(prints):
                found = np.zeros(len(prints), np.int64)
                if shards is None:
                    for answer in row["answers"]:
                        found[np.frombuffer(answer["places"], np.int32)] = np.frombuffer(answer["levels"], np.int8)
                    return found
                shard = shard_of(prints, model.shards)
                for name, bits in shards.items():
                    mine = np.flatnonzero(shard == name)
                    found[mine] = FilterShard(bits).levels(prints[mine])
                return found

            done = block_scores(row, count, followers, model, levels)
            ids = pa.array(row["ids"], kind)
            out.append(pa.table([ids, pa.array(row["held"], pa.bool_()), *(pa.array(x) for x in done[:2]), pa.array(np.full(len(ids), model.total)), *(pa.array(x) for x in done[2:])], names))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Language-model scores of every text (doc_id, text, held_out), learnt from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known (tokens that occur in training), train_tokens,
    base_score (log10 by smoothed counts of single words) and score (log10 by the model of pairs).
    Tokens are the words with A-Z in lower case, and one end.

    Texts are kept once as blocks of word numbers. The words of a block go, with 128-bit keys and
    their counts, to parts that add them up and send the sums back: counts of single words are exact.
    Pairs of neighbours go by a fingerprint to shards, which keep their counts as levels of a Bloom
    filter. Parts and shards number with the words and tokens, PART_WORDS and SHARD_TOKENS of them,
    and a block sends each word and pair once, so that frequent ones weigh no more than blocks.
    A filter of FILTER_BYTES at most is broadcast; a larger one is never gathered: the distinct pairs
    of each block are sent to its shards and the levels sent back, which gives the same rows.

    A null or empty text is its end alone. A null held_out counts as false. Repeated rows and ids are
    rows like any other, each learnt from and scored; a very long text is a block by itself; other
    columns are not read; without training texts every probability is 1; no rows give no rows.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    given = modest_batches(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"))
    coded = materialize(given.mapInArrow(_code, _CODED.format(kind)), "coded")
    tokens, n_words = (x or 0 for x in coded.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    shards, parts = max(1, -(-tokens // SHARD_TOKENS)), max(1, -(-n_words // PART_WORDS))

    pairs = coded.select(_FOR_PAIRS).mapInArrow(_pair_packets(shards), _PAIRS)
    kept = materialize(pairs.repartition(shards, "shard").groupBy("shard").applyInArrow(_build, _SHARD), "filter")
    size, once, twice = (x or 0 for x in kept.agg(F.sum(F.length("bits")), F.sum("once"), F.sum("twice")).first())
    words = coded.select("block", "high", "low", "counts").mapInArrow(_word_packets(parts), _WORDS)
    words = words.union(kept.select("firsts", "followers").mapInArrow(_follower_packets(parts), _WORDS))
    counted = materialize(words.repartition(parts, "part").groupBy("part").applyInArrow(_count, _COUNTED), "words")
    total, distinct = (x or 0 for x in counted.agg(F.sum("total"), F.sum("words")).first())

    blocks, filter_ = coded.select("ids", *_FOR_PAIRS), None
    if size <= FILTER_BYTES:
        held = kept.select("shard", "bits").toArrow()
        filter_ = spark.sparkContext.broadcast({s.as_py(): np.frombuffer(b.as_buffer(), np.uint8).copy() for s, b in zip(held["shard"], held["bits"])})
        release(kept)
    else:
        asked = coded.select(_FOR_PAIRS).mapInArrow(_probe_packets(shards), _PROBES)
        told = asked.groupBy("shard").cogroup(kept.select("shard", "bits").groupBy("shard")).applyInArrow(_answers, "block bigint, places binary, levels binary")
        blocks = blocks.join(told.groupBy("block").agg(F.collect_list(F.struct("places", "levels")).alias("answers")), "block")
    words = counted.where("block is not null").select("block", "places", "counts", "followers")
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    score = _score(Model(total, distinct, once, twice, shards), filter_, [c.split()[0] for c in out.split(", ")])
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(score, out)
