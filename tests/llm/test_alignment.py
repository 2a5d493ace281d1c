"""Alignment of two tokenizers against a version that goes token by token over whole texts."""

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import alignment
from docloom.llm.alignment import Aligner, align_tokens, aligner, byte_values, common_cuts, default_models, expand_links
from tests.llm.helpers import empty_docs, odd_docs

DATA = "/root/testdata/sf0.001"


def slowly(rows):
    """Rows of the contract from whole encodings, with a walk over the ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = default_models()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    value, links, out = byte_values(), [], []

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelled = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelled):
            links.append([])
            out.append([doc, 0, 0, 0, 0, ""])
            continue
        groups, mine, i, j = [], [], 0, 0
        while i < len(ids_a):
            first, end_a, end_b = (i, j), len(spelled[0][i]), len(spelled[1][j])
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a += len(spelled[0][i])
                else:
                    j += 1
                    end_b += len(spelled[1][j])
            mine.append((ids_a[i], ids_b[j]))
            i, j = i + 1, j + 1
            groups.append(",".join(map(str, ids_a[first[0] : i])) + "|" + ",".join(map(str, ids_b[first[1] : j])))
        links.append(mine)
        out.append([doc, len(ids_a), len(ids_b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(p for mine in links for p in mine)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return [tuple([*row[:5], sum(count[p] == most[p[1]] for p in mine), sum(count[p] for p in mine), row[5]]) for row, mine in zip(out, links)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def both(docs):
    got = sorted((tuple(r) for r in align_tokens(docs).select(COLUMNS).collect()), key=str)
    return got, sorted(slowly([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]), key=str)


def test_whole_table(spark):
    got, want = both(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert got == want and sum(r[4] for r in got) > 10_000


HARD = [" lead", "tail ", "a  b", "a\nb c\n\nd", "▁x y", "x ▁ y", "<0x41> <s> </s> <|endoftext|> <unk>", "　z ﬁ é", "it's we'll  don't", "\t", "😀 👩‍👩‍👧 漢字", "\x1c a \x85 b"]


def test_odd_rows(spark):
    got, want = both(odd_docs(spark, [(1000 + i, t) for i, t in enumerate(HARD)]))
    assert got == want
    zero = {r[0] for r in got if r[1] == 0}
    assert {900, 901, 1004, 1005} <= zero and 904 not in zero and [r for r in got if r[0] == 904][0][4] > 0


def test_no_rows(spark):
    assert align_tokens(empty_docs(spark)).collect() == []


def test_kept_groups(spark):
    got = align_tokens(spark.createDataFrame([(1, "Hello tokenizers")], "doc_id bigint, text string"), keep_groups=True).collect()[0]
    assert hashlib.sha256(got["groups"].encode()).hexdigest() == got["groups_sha256"] and got["groups"].count(";") + 1 == got["n_groups"]


def test_pairs_are_bounded_by_the_vocabularies():
    known = aligner(default_models())
    assert len(known.pairs) <= known.size_a.sum() + known.size_b.sum()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n▁é漢'1\t \x1f"), max_size=12), min_size=1, max_size=4))
def test_pieces_are_as_whole_texts(texts):
    known = aligner(default_models())
    for text, found in zip(texts, known.align(texts)):
        whole = known._encoded([text])[0] if text else None
        assert (found is None) == (whole is None)
        assert whole is None or found == (whole[2], whole[3], whole[0][:-1], whole[1])


def test_memo_changes_its_generation(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_BYTES", 2000)
    known, fresh = Aligner(*default_models()), aligner(default_models())
    texts = [f"word{i} and some other words {i % 7}" for i in range(200)]
    assert [known.align([t])[0] for t in texts] == [fresh.align([t])[0] for t in texts]
    assert len(known.memo) < 50


def test_links_repeat_where_several_tokens_end():
    a, b = np.array([2, 2, 5, 7]), np.array([1, 2, 2, 2, 7])
    cuts = common_cuts(a, b)
    assert cuts.tolist() == [2, 7]
    assert sorted(zip(*[x.tolist() for x in expand_links(a, b, cuts)])) == sorted([(i, j) for i in (0, 1) for j in (1, 2, 3)] + [(3, 4)])
