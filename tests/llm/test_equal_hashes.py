"""Texts made so that their polynomial hashes modulo 2^64 are equal though they differ."""

import hashlib

import numpy as np

from docloom.llm.byte_dups import remove_repeated_bytes
from docloom.llm.rolling import Prefix
from docloom.llm.substrings import open_index, remove_repeated_windows

SCHEMA = "doc_id bigint, text string"


def thue_morse(n, swap=False):
    """The Thue-Morse word of 2^n letters, or its complement."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if swap else word


def test_the_pair_has_equal_hashes():
    pair = [thue_morse(11, swap).encode() for swap in (False, True)]
    ends = np.array([0]), np.array([2048])
    assert pair[0] != pair[1] and all(len({int(Prefix(w, which).of(*ends)[0]) for w in pair}) == 1 for which in (0, 1))


def test_windows_that_differ_stay(spark, tmp_path):
    words = [f"w{i}" for i in range(34)]
    texts = [" ".join([*words[:17], thue_morse(11, swap), *words[17:]]) for swap in (False, True)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    whole = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    for index in (None, open_index(spark, str(tmp_path))):
        got = sorted(tuple(r) for r in remove_repeated_windows(docs, index=index).collect())
        assert got == [(i, 35, 0, whole[i]) for i in (0, 1)]


def test_bytes_that_differ_stay(spark):
    """Each word is repeated in itself, so what differs is the letters around: brute force over all windows."""
    texts = [left + thue_morse(11, swap) + right for swap in (False, True) for left, right in (("x", "y"), ("z" * 99, "q"))]
    earlier, want = set(), []
    for i, text in enumerate(texts):
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 99):
            if text[at : at + 100] in earlier:
                gone[at : at + 100] = True
            earlier.add(text[at : at + 100])
        kept = "".join(c for c, g in zip(text, gone) if not g)
        want.append((i, len(text), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    got = remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == want
