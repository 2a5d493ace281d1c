"""Operators on documents against brute-force versions, with odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from docloom.llm import byte_dups, decontaminate, edit_counts, packing, pii, simhash, substrings, toxicity
from docloom.llm.common import components
from docloom.llm.suffix import permuted_prefixes, suffix_array
from docloom.llm.tokens import default_tokenizer
from tests.llm.helpers import empty_docs, odd_docs, rows

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def print_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = documents(spark).select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text").where("doc_id is not null"))
    got = simhash.simhash_groups(docs).collect()
    prints = {}
    for doc, text in plain(docs):
        prints[doc] = print_of(text) if text is None or len(text) < 50000 else simhash.fingerprint(text)
    ids = sorted(prints)
    label = {i: i for i in ids}
    words = np.array([prints[i] for i in ids], np.uint64)
    for _ in range(len(ids)):
        old = dict(label)
        for k, i in enumerate(ids):
            near = np.flatnonzero(np.bitwise_count(words ^ words[k]) <= 2)
            label[i] = min(label[ids[j]] for j in near)
        if old == label:
            break
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{prints[i]:016x}", label[i]) for i in ids}
    assert len(got) == docs.count()


@pytest.mark.parametrize("ranges", [256, 16, 2])
def test_gray_index_finds_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    words = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for s in seeds for _ in range(90)}
    words = sorted(words | {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63})
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    table = spark.createDataFrame([(w,) for w in signed], "fp bigint").repartition(3)
    found = {r["node"]: r["component"] for r in components(simhash.simhash_links(table, ranges=ranges)).collect()}
    label = list(signed)
    array = np.array(words, np.uint64)
    for _ in range(len(words)):
        new = [min(label[j] for j in np.flatnonzero(np.bitwise_count(array ^ array[k]) <= 2)) for k in range(len(words))]
        if new == label:
            break
        label = new
    assert [found.get(k, k) for k in signed] == label


def test_gray_tree_prunes_groups():
    """Upper nodes turn most of the index away: of 20,000 words a search meets a few hundred and finds all links."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1)
    words = np.unique(np.concatenate([words, words[:50] ^ np.uint64(1 << 40), words[50:90] ^ np.uint64(5 << 60)]))
    words = words[np.argsort(simhash.gray_rank(words))]
    tree = simhash.GrayTree(np.full(len(words), ~np.uint64(0)), words)
    found = {(i, j) for a, b in tree.search(words, 2) for i, j in zip(a.tolist(), b.tolist()) if i < j}
    assert len(found) == 90 and all(bin(int(words[i] ^ words[j])).count("1") <= 2 for i, j in found)
    assert tree.pruned > 0.8 * tree.seen and tree.seen < 0.3 * len(words) ** 2
    assert found == {(i, j) for a, b in simhash.gray_pairs(words) for i, j in zip(a.tolist(), b.tolist())}


def test_near_duplicates_with_clashing_ids(spark):
    """Rows that share an id and are no near duplicates stay; repeated rows stay once."""
    words = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=60))
    table = [(1, words(1)), (1, words(2)), (2, words(1)), (3, words(3)), (3, words(3)), (None, words(1)), (4, None), (5, "")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    kept = rows(simhash.drop_near_duplicates(docs))
    assert kept == sorted([(1, words(1)), (1, words(2)), (3, words(3)), (None, words(1)), (4, None)], key=str)
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: got.get(x, x) for x in parent} == {x: root(x) for x in parent}


def windows_brute(table, size):
    count, cut = collections.Counter(), []
    for _, text in table:
        words = WORD.findall(text or "")
        cut.append(words)
        count.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for (doc, _), words in zip(table, cut):
        gone = set()
        for k in range(len(words) - size + 1):
            if count[tuple(words[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(800)]
    out = []
    for doc in range(40):
        words = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 700)
            words += base[at : at + rng.randint(3, 60)] if rng.random() < 0.5 else [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))]
        out.append((doc, " \n".join(words)))
    return out


@pytest.mark.parametrize("window, seed", [(12, 5), (35, 8)])
def test_repeated_windows(spark, window, seed):
    docs = odd_docs(spark, passages(window))
    assert rows(substrings.remove_repeated_windows(docs, window=window, seed=seed)) == windows_brute(plain(docs), window)


def test_index_compacts(spark):
    """Five loads need a compaction and find the seeds that one load finds."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([r for k in range(5) for r in passages(k)[:5] + passages(99)[:2]], "doc_id bigint, text string")
    keyed = table.select(F.xxhash64("doc_id", "text").alias("key"), F.hash("doc_id").alias("check"), "text")
    several, one = substrings.SubstringIndex(spark, 12, 5), substrings.SubstringIndex(spark, 12, 5)
    for k in range(5):
        several.load(keyed.where(F.pmod("key", F.lit(5)) == k))
    one.load(keyed)
    assert len(several.runs) == 2 < substrings.FANOUT
    assert rows(several.repeated_seeds()) == rows(one.repeated_seeds()) != []


def test_kept_index(spark, tmp_path):
    """Batches judged one after the other against a kept index, opened anew for each, as if their predecessors were there."""
    table = [*passages(12), (77, passages(12)[3][1]), (78, None), (79, "short")]
    batches = [table[:15], table[15:16], table[16:30], table[16:18], table[30:40], table[40:]]
    path = str(tmp_path / "index")
    for k, batch in enumerate(batches):
        index = substrings.open_index(spark, path, 12, 5)
        got = rows(substrings.remove_repeated_windows(spark.createDataFrame(batch, "doc_id bigint, text string"), index=index))
        seen = [r for b in batches[: k + 1] for r in b]
        want = windows_brute(seen, 12)
        assert got == [w for w in want if w[0] in {d for d, _ in batch}] or set(got) == {w for w in want if w[0] in {d for d, _ in batch}}, k
    assert len(substrings.open_index(spark, path, 12, 5).runs) < substrings.FANOUT


def bytes_brute(table, size):
    first = {}
    order = lambda doc: (doc is not None, doc or 0)
    for doc, text in sorted(table, key=lambda r: order(r[0])):
        data = (text or "").encode()
        for k in range(len(data) - size + 1):
            first.setdefault(data[k : k + size], (*order(doc), k))
    out = []
    for doc, text in table:
        data = (text or "").encode()
        gone = bytearray(len(data) + 1)
        for k in range(len(data) - size + 1):
            if first[data[k : k + size]] < (*order(doc), k):
                gone[k : k + size] = b"\1" * size
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, seed, contexts", [(20, 6, 8192), (20, 6, 1), (100, 24, 8192)])
def test_repeated_bytes(spark, monkeypatch, window, seed, contexts):
    monkeypatch.setattr(byte_dups, "SHARD_CONTEXTS", contexts)
    docs = odd_docs(spark, [*passages(window), (950, "x" * 300), (951, "ab" * 80), (952, "x" * 40)])
    assert rows(byte_dups.remove_repeated_bytes(docs, window=window, seed=seed)) == bytes_brute(plain(docs), window)


@pytest.mark.parametrize("contexts", [8192, 1])
def test_repeated_bytes_of_one_id(spark, monkeypatch, contexts):
    """Rows that share an id and differ in text: of equal strings those of a greater start go, whatever the rows' order."""
    monkeypatch.setattr(byte_dups, "SHARD_CONTEXTS", contexts)
    table = [(d // 3 if d % 7 else None, t) for d, t in passages(20)]
    first = {}
    order = lambda doc, k: (doc is not None, doc or 0, k)
    for doc, text in table:
        for k in range(len(text.encode()) - 19):
            window = text.encode()[k : k + 20]
            first[window] = min(first.get(window, order(doc, k)), order(doc, k))
    want = []
    for doc, text in table:
        data = text.encode()
        gone = {j for k in range(len(data) - 19) if first[data[k : k + 20]] < order(doc, k) for j in range(k, k + 20)}
        kept = bytes(b for j, b in enumerate(data) if j not in gone)
        want.append((doc, len(data), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(kept).hexdigest()))
    assert rows(byte_dups.remove_repeated_bytes(spark.createDataFrame(table, "doc_id bigint, text string"), window=20, seed=6)) == sorted(want, key=str)


def test_wanted_prefixes():
    """Only neighbours that are both wanted are compared, with the lengths that a comparison of all gives."""
    rng = np.random.default_rng(5)
    for n in (2, 9, 400):
        s = np.append(rng.integers(1, 3, n), 0)
        text = np.append(s, np.zeros(40, np.int64)).astype(np.uint8)
        sa = suffix_array(s, 3)
        wanted = rng.random(len(text)) < 0.5
        every, some = permuted_prefixes(text, sa, 32), permuted_prefixes(text, sa, 32, wanted)
        both = np.zeros(len(text), bool)
        both[sa[1:]] = wanted[sa[1:]] & wanted[sa[:-1]]
        assert np.array_equal(some, np.where(both, every, 0))


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(120):
        s = np.array([rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 80))] + [0])
        sa, text = suffix_array(s, 10), s.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        padded = np.concatenate([s.astype(np.uint8), np.zeros(40, np.uint8)])
        common = permuted_prefixes(padded, sa, 20)
        for a, b in zip(sa[:-1], sa[1:]):
            k = 0
            while k < 20 and max(a, b) + k < len(padded) and padded[a + k] == padded[b + k]:
                k += 1
            assert common[b] == k


def test_packing(spark):
    docs = odd_docs(spark, [(910, "a  b\n\n c <|endoftext|> x "), (911, " lead"), (912, "tail\n"), *plain(documents(spark))])
    got = packing.pack_documents(docs).toPandas()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = dict(plain(docs))
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = (got[got.doc_id == doc] if doc is not None else got[got.doc_id.isna()]).drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 2048).all()
        for start, length, crc in zip(mine.start, mine.length, mine.ids_crc32):
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group.offset.values == np.concatenate([[0], np.cumsum(group.length.values)[:-1]])).all() and group.length.sum() <= 2048
    bins = []
    for length in sorted(got.length, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= length
        else:
            bins.append(2048 - length)
    assert len(bins) == got.sequence_id.nunique()


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 32, 100])
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(20, capacity)))}
        bins, room = collections.Counter(), []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [k for k, r in enumerate(room) if r >= length]
                if fits:
                    room[min(fits, key=room.__getitem__)] -= length
                else:
                    room.append(capacity - length)
        plan = packing.best_fit_plan(counts, capacity)
        for k, (length, rank, first, per, offset) in enumerate(plan):
            stop = next((p[1] for p in plan[k + 1 :] if p[0] == length), counts[length])
            for j in range(stop - rank):
                bins[first + j // per] += length
        assert sorted(bins.values()) == sorted(capacity - r for r in room)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


def test_pii_base():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice("a.@1239-+ ()0_") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == base_brute(text)


def test_pii_trees_on_held_out_examples():
    for kind in pii.KINDS:
        trees, least = pii._model(kind, pii.TRAIN_EXAMPLES, pii.PRECISION)
        fresh = list(pii._examples(kind, random.Random(99), 400))
        p = trees.predict(np.array([pii._features(t, a, b, kind) for t, a, b, _ in fresh]))
        y = np.array([r[3] for r in fresh])
        assert ((p >= least) == y).mean() > 0.93 and y[p >= least].mean() > 0.95


def test_pii(spark):
    docs = odd_docs(spark, [(920, "mail a.b@c.de or call (415) 555-1234 or +1 (429) 555-5467"), (921, "jane dot doe at example dot com")])
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert (got[920]["n_email"], got[920]["n_phone"]) == (1, 1) and got[920]["redacted"] == "mail <email> or call <phone> or <phone>"
    assert got[920]["base_sha256"] == hashlib.sha256(b"email:5:13,phone:40:57").hexdigest()
    assert "email" in got[921]["spans"] and got[900]["spans"] == "" and got[905]["redacted"] == "é漢😀\x00"
    assert pii.find_pii(docs).count() == docs.count()


def test_decontamination(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "too short"), (3, None), (4, "one two three four five six seven eight")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    crossed = "x Zeta eta, theta iota kappa! y alpha beta gamma delta epsilon z"
    docs = odd_docs(spark, [(1, items[0][1]), (2, crossed), (3, "alpha beta gamma delta epsilon"), (4, "too short"), (5, f"{'pad ' * 300}{items[3][1]} {items[0][1]}")])
    got = {r["doc_id"]: (r["items"], r["coverage"]) for r in decontaminate.decontamination(docs, bench).collect()}
    assert got[1] == ("1", 1.0) and got[2] == ("1", 1.0) and got[3] == ("", 0.0) and got[4] == ("", 0.0) and got[5] == ("1,4", 1.0)
    assert all(got[k][0] == "" for k in (900, 901, 902, 903, 904, 905))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.decontamination(empty_docs(spark), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - {1, 2, 5}


def greedy_tiles(item, doc, least):
    """All matching runs tried at every step: the longest, then the smallest places."""
    used_item, used_doc, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_item and j + n not in used_doc:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        used_item.update(range(i, i + n))
        used_doc.update(range(j, j + n))


def test_tiles_are_those_of_greedy_tiling():
    rng = random.Random(15)
    for _ in range(400):
        letters = rng.choice([[b"a"], [b"a", b"b"], [b"a", b"b", b"c", b"d"]])
        item, doc = ([rng.choice(letters) for _ in range(rng.randint(0, 22))] for _ in range(2))
        assert decontaminate.tiles(item, doc, 3) == greedy_tiles(item, doc, 3)
    long = [b"word"] * 60000
    assert decontaminate.tiles([b"word"] * 1000, long) == [(0, 0, 1000)]


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Items with shared phrases, repeated and missing ids."""
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 2)
    rng = random.Random(16)
    phrase = "one phrase that stands in very many items of the benchmark".split()
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 3)
    items = [(rng.choice([None, 1, 2, *range(3, 60)]), " ".join([*phrase[: rng.randint(0, 11)], *(word() for _ in range(rng.randint(3, 12)))])) for _ in range(150)]
    docs = []
    for doc in range(120):
        words = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            cut = rng.randint(0, len(part))
            words[(at := rng.randint(0, len(words))) : at] = rng.choice([part, part[cut:] + part[:cut], part[: cut + 1], phrase])
        docs.append((doc, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in decontaminate.decontamination(odd_docs(spark, docs), bench).collect()}
    hits = 0
    for doc, text in docs:
        best = {}
        for item, t in items:
            words = decontaminate.plain_words(t)
            if len(words) >= 5 and (share := sum(n for *_, n in greedy_tiles(words, decontaminate.plain_words(text), 5)) / len(words)) >= 0.8:
                best[item] = max(share, best.get(item, 0))
        named = [str(i) for i in sorted(best, key=lambda i: (i is None, i or 0))]
        assert (got[doc]["items"], got[doc]["n_items"]) == (",".join(named), len(named)), doc
        assert got[doc]["coverage"] == pytest.approx(max(best.values(), default=0), abs=1e-5)
        hits += len(named)
    assert hits > 50


def test_texts_over_a_block(monkeypatch):
    """Blocks so small that most texts go by parts give what whole texts give."""
    texts = [t for _, t in passages(5)] + [None, "", "word " * 900]
    every = lambda h: np.ones(len(h), bool)
    seeds = lambda: sorted((int(k), int(h)) for index, hashes in decontaminate._seeds_of(texts, every) for k, h in zip(index, hashes))

    def windows():
        out = set()
        for index, shift, buffer in substrings.blocks_of(texts, 12):
            owner, first, count, h, _ = substrings.seeds_of(buffer, 12, 5)
            out |= {(index[o], f + shift + k, int(x)) for o, f, n, x in zip(owner.tolist(), first.tolist(), count.tolist(), h.tolist()) for k in range(n)}
        return out

    def byte_windows():
        out = set()
        raw = [(t or "").encode() for t in texts]
        for index, shift, data, bounds in byte_dups.parts_of(raw, 20):
            owner, first, count, h, *_ = byte_dups.seeds_of(data, bounds, 20, 6)
            out |= {(index[o], f + shift + k, int(x)) for o, f, n, x in zip(owner.tolist(), first.tolist(), count.tolist(), h.tolist()) for k in range(n)}
        return out

    whole = seeds(), windows(), byte_windows()
    for module, name, value in ((decontaminate, "_BLOCK_BYTES", 300), (decontaminate, "_CHUNK_WORDS", 20), (substrings, "_BLOCK_BYTES", 300), (substrings, "_BLOCK_WORDS", 40), (byte_dups, "_BLOCK_BYTES", 200)):
        monkeypatch.setattr(module, name, value)
    assert (seeds(), windows(), byte_windows()) == whole


def test_phrase_of_ten_thousand_items(spark):
    """A phrase that half of every item's words are brings no candidates, and is no key of any item."""
    rng = random.Random(17)
    phrase = "this is the phrase that all of the many items share".split()
    items = [(k, " ".join(phrase + [f"w{rng.randrange(10**9)}" for _ in range(11)])) for k in range(10_000)]
    docs = [(k, " ".join(["pad"] * 30 + phrase + ["end"] * 30)) for k in range(300)] + [(400, items[77][1])]
    got = decontaminate.decontamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert [(r["doc_id"], r["items"]) for r in got.where("contaminated").collect()] == [(400, "77")]
    weight = {s: 10_000 for s in decontaminate.seed_hashes([w.encode() for w in phrase]).view(np.int64).tolist()}
    keys = decontaminate.key_seeds([w.encode() for w in items[0][1].split()], weight)
    assert keys and not set(keys) & set(weight)


def test_pieces_of_longer_numbers_are_not_proposed():
    for text in ("card 4111 1111 1111 1112", "in 2001 2002 2003 2004 2005", "No 4471 2210 9981 2034 7716 5"):
        assert not any(pii.added_spans(text, pii.base_spans(text)).values()), text
    text = "Tel. 030 12 34 56 78. 3 people asked."
    assert pii.added_spans(text, pii.base_spans(text))["phone"] == [(5, 20)]


def test_added_spans_in_documents():
    """Forms that the base patterns miss, put into whole documents, against the documents' own numbers."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t and len(t) < 5000]
    forms = {
        "email": ["write to anna [at] lakeside [dot] org", "mail bob.ray (at) stonehill (dot) net", "contact eve at northgate dot com"],
        "ip": ["login from 172[.]16[.]254[.]3", "host 2001:4860:4860:8888:1212:3434:5656:7878", "server 8(.)26(.)56(.)26"],
        "card": ["card 4000/0566/5566/5556", "paid with 5105.1051.0510.5100", "visa 4242_4242_4242_4242"],
        "phone": ["call (312) 555-0142", "tel 0044 113 496 001", "phone 503-555-0177"],
    }
    rng, right, wrong, missed = random.Random(12), collections.Counter(), collections.Counter(), collections.Counter()
    for text in texts:
        found = pii.added_spans(text, pii.base_spans(text))
        for a, b in found["card"]:
            assert pii.luhn(re.sub("[^0-9]", "", text[a:b])), text[a:b]
        wrong.update({k: len(v) for k, v in found.items()})
    for kind, kinds in forms.items():
        for text in rng.sample(texts, 60):
            form = rng.choice(kinds)
            at = text.find(" ", rng.randrange(len(text) // 2 + 1)) + 1
            whole = f"{text[:at]}{form} {text[at:]}"
            found = pii.added_spans(whole, pii.base_spans(whole))
            hit = any(a < at + len(form) and b > at for a, b in found[kind])
            right[kind] += hit
            missed[kind] += not hit
    for kind in forms:
        assert right[kind] >= 0.9 * (right[kind] + wrong[kind]), (kind, right, wrong)
        assert right[kind] >= 0.8 * (right[kind] + missed[kind]), (kind, right, missed)


def test_edit_counts():
    count = edit_counts.counter(default_tokenizer())
    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = True
    whole = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(4)
    units = ["a", "b", " ", "\n", "'s", "'r", "e", "1", "é", ".", "  ", "ab", "<|endoftext|>", "x y"]
    for _ in range(1500):
        text = "".join(rng.choice(units) for _ in range(rng.choice([0, 5, 30, 200])))
        given = [{"start": (a := rng.randint(0, len(text) + 2)), "end": a + rng.randint(0, 6), "text": rng.choice([None, "", " ", "zz", "\n\n", "'s", "e"])} for _ in range(rng.randint(0, 5))]
        edits = edit_counts.usable_edits(text, given)
        tree = edit_counts.tree_of(text, count)
        assert tree.total == whole(text)
        final, _ = edit_counts.apply_edits(text, edits, tree, count)
        want = text
        for a, b, new in reversed(edits):
            want = want[:a] + new + want[b:]
        assert final == want and tree.total == whole(want)


@pytest.mark.parametrize("leaf", [1, 8, 32])
def test_recounted_leaves(monkeypatch, leaf):
    """Edits on kept leaves, again and again, give the counts of the edited text and read little."""
    monkeypatch.setattr(edit_counts, "LEAF_PIECES", leaf)
    count, rng = edit_counts.counter(default_tokenizer()), random.Random(leaf)
    units = ["a", "b", " ", "\n", "'s", "'r", "e", "1", "é", ".", "  ", "ab", "x y", "hello world ", "don't ", "\n\n\n"]
    for _ in range(500):
        text = "".join(rng.choice(units) for _ in range(rng.choice([0, 1, 5, 30, 200])))
        pieces = edit_counts.PIECES.findall(text)
        leaves = edit_counts.leaf_texts(pieces)
        chars, tokens = list(map(len, leaves)), [sum(map(count.count, pieces[k : k + leaf])) for k in range(0, len(pieces), leaf)]
        for _ in range(2):
            given = [{"start": (a := rng.randint(0, len(text) + 2)), "end": a + rng.randint(0, 6), "text": rng.choice([None, "", " ", "zz", "\n\n", "'s", "e"])} for _ in range(rng.randint(0, 4))]
            edits = edit_counts.cut_edits(len(text), given)
            new, chars, tokens, _ = edit_counts.recount_leaves(leaves.__getitem__, chars, tokens, edits, count)
            leaves = [leaves[t] if isinstance(t, int) else t for t in new]
            for a, b, x in reversed(edits):
                text = text[:a] + x + text[b:]
            assert "".join(leaves) == text and chars == list(map(len, leaves))
            assert sum(tokens) == sum(map(count.count, edit_counts.PIECES.findall(text)))
    asked = set()
    edit_counts.recount_leaves(lambda b: asked.add(b) or " word" * 32, [160] * 1000, [32] * 1000, [(80_000, 80_001, "x")], count)
    assert len(asked) <= 4


def test_kept_trees(spark):
    from pyspark.sql import functions as F

    docs = odd_docs(spark, plain(documents(spark))[:60])
    at = F.greatest(F.length("text") / 2, F.lit(0)).cast("bigint")
    edits = F.array(*[F.struct(p.alias("start"), (p + 3).alias("end"), F.lit("new").alias("text")) for p in (F.lit(1).cast("bigint"), at)])
    once = edit_counts.edit_token_counts(docs, edits).select("doc_id", "n_tokens_after", "n_edits")
    trees = edit_counts.count_trees(docs)
    size = F.aggregate("leaf_chars", F.lit(0).cast("bigint"), lambda t, n: t + n)
    half = (size / 2).cast("bigint")
    kept = F.array(*[F.struct(p.alias("start"), (p + 3).alias("end"), F.lit("new").alias("text")) for p in (F.lit(1).cast("bigint"), half)])
    after = edit_counts.recount(trees, kept)
    assert rows(after.select("doc_id", "n_tokens", "n_edits")) == rows(once)
    assert after.where("doc_id = 903").first()["n_reencoded"] < 300
    assert rows(edit_counts.recount(after, F.lit(None)).select("doc_id", "n_tokens")) == rows(once.select("doc_id", "n_tokens_after"))
    assert edit_counts.recount(trees.where("false"), kept).count() == 0


def test_edit_counts_rows(spark):
    from pyspark.sql import functions as F

    docs = odd_docs(spark)
    edit = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end"), F.lit("new").alias("text")))
    got = edit_counts.edit_token_counts(docs, F.when(F.col("doc_id") != 901, edit))
    assert got.count() == docs.count() and got.where("doc_id = 901 and n_edits = 0 and n_tokens = 0").count() == 1
    assert got.where("doc_id = 903").first()["n_reencoded"] < 10


def test_kernel():
    from itertools import combinations

    def slow(s, t, n=3, d=toxicity.DECAY):
        pairs = ((a, b) for a in combinations(range(len(s)), n) for b in combinations(range(len(t)), n))
        return sum(d ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a, b in pairs if [s[i] for i in a] == [t[j] for j in b])

    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert toxicity.subsequence_kernel([a], [b])[0] == pytest.approx(slow(a, b), rel=1e-4)
    words = ["".join(rng.choice("abcdeidot") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    marks = toxicity.Landmarks(["idiot", "dotted"])
    near = marks.similar(words)
    for k, mark in enumerate(marks.words):
        for w, v in zip(words, near[:, k]):
            k_ww = slow(w, w)
            exact = slow(w, mark) / np.sqrt(k_ww * slow(mark, mark)) if k_ww else 0.0
            assert v == pytest.approx(exact, abs=1e-3)


def insults(seed, n=400):
    rng = random.Random(seed)
    common = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    bad = ["idiot", "worthless", "disgusting"]
    out = []
    for doc in range(n):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad) if rng.random() < 0.7 else rng.choice(["idxiot", "w-o-r-t-h-l-e-s-s", "d1sgusting", "iddiot"]))
        out.append((doc, " ".join(words), toxic))
    return out


def test_tokens_of_one_word(monkeypatch):
    """Each word is compared once, whatever signs its tokens have, and a memo of any size gives the same values."""
    texts = ["idiot, you", "an Idiot! here", "id1ot. you?", "", "an (idiot) and an idiom", "here you; are"] * 3
    marks, cut = toxicity.Landmarks(["^idiot", "here"]), []
    want = np.concatenate([toxicity.WordScorer(marks).features([t]) for t in texts])
    for size in (0, 3, 150_000):
        monkeypatch.setattr(toxicity, "MEMO_WORDS", size)
        scorer = toxicity.WordScorer(marks)
        assert np.array_equal(np.concatenate([scorer.features([t]) for t in texts]), want)
    monkeypatch.setattr(toxicity, "parts_of", lambda w, parts=toxicity.parts_of: cut.append(w) or parts(w))
    scorer = toxicity.WordScorer(marks)
    assert np.array_equal(np.concatenate([scorer.features([t]) for t in texts]), want)
    assert sorted(cut) == ["an", "and", "are", "here", "idiom", "idiot", "you"]


def test_toxicity(spark):
    table = insults(1)
    docs = odd_docs(spark, [r[:2] for r in table])
    labels = spark.createDataFrame([(r[0], r[2]) for r in table] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {r[0]: r[2] for r in table}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in truth)
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.95
    assert all(got[d]["predicted"] == 0 for d in (900, 901, 902, 903, 904, 905))
    none = toxicity.fit_toxicity(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def altered(rng, word):
    """The word with two letters inserted, or glued to another in front."""
    if rng.random() < 0.4:
        return "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 5))) + word
    for _ in range(2):
        at = rng.randrange(1, len(word))
        word = word[:at] + rng.choice("xqz") + word[at:]
    return word


def test_inserted_letters_and_glued_words(spark):
    """Insults with two inserted letters, glued ones and one of three letters, a third of them altered in training too."""
    rng = random.Random(8)
    bad = ["idiot", "worthless", "disgusting", "fuk"]
    clean = lambda: ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(20)]
    table = []
    for doc in range(2000):
        word = rng.choice(bad)
        table.append((doc, " ".join([*clean(), *([altered(rng, word) if doc % 3 == 0 else word] if doc % 2 or doc % 16 == 0 else [])]), int(doc % 2 or doc % 16 == 0)))
    docs = spark.createDataFrame([r[:2] for r in table], "doc_id bigint, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in table], "doc_id bigint, toxic int"))
    kinds = {"idiot": 0, "worthless": 50, "disgusting": 100}
    texts = [" ".join([*clean(), altered(rng, w)]) for w in kinds for _ in range(50)] + [" ".join([*clean(), "fuk"]) for _ in range(50)]
    texts += [" ".join(clean()) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(rows, model).collect()}
    caught = [sum(got[at + i] for i in range(50)) for at in (0, 50, 100, 150)]
    wrong = sum(got[k] for k in range(200, 400))
    assert min(caught) >= 35 and sum(caught) >= 160 and wrong <= 20, (caught, wrong)


def test_held_out_accuracy(spark):
    """On the test tables, whose labels are noisy in three of four languages."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    held = docs.join(labels, "doc_id").where(toxicity.is_held_out(docs["doc_id"]))
    scored = toxicity.score_toxicity(held, model).join(held.select("doc_id", "lang", "toxic"), "doc_id").toPandas()
    pos, neg = scored.score[scored.toxic == 1].values, scored.score[scored.toxic == 0].values
    assert np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos]) > 0.95
    for part, least_caught, least_right in ((scored, 0.75, 0.85), (scored[scored.lang == "en"], 0.85, 0.95)):
        caught, right = part.predicted[part.toxic == 1].mean(), part.toxic[part.predicted == 1].mean()
        assert caught >= least_caught and right >= least_right, (caught, right)


@pytest.mark.parametrize("run", [
    simhash.simhash_groups, substrings.remove_repeated_windows, byte_dups.remove_repeated_bytes, pii.find_pii, packing.pack_documents,
], ids=lambda f: f.__name__)
def test_empty_tables(spark, run):
    assert run(empty_docs(spark)).count() == 0
