"""Alignment of two tokenizers: groups between common cuts, links of tokens that end together, corpus-wide pair counts."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, modest_batches

#: Parts that the rows of one pair are summed in before they meet.
SALTS = 16
#: Bytes of one of the two generations of a worker's memo, and of an entry besides its contents.
MEMO_BYTES = 64 << 20
_ENTRY = 420
_TEXTS_AT_ONCE = 256
_PIECES_AT_ONCE = 20_000

_ONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[tuple[str, str], Aligner] = {}


def default_models() -> tuple[str, str]:
    """Places of the public byte-level vocabulary and of the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_values() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens of both sides end."""
    return np.intersect1d(ends_a, ends_b)


def expand_links(ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens that end at the same cut, by repeats of the counts at each cut."""
    first_a, first_b = np.searchsorted(ends_a, cuts, "left"), np.searchsorted(ends_b, cuts, "left")
    n_a, n_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    pairs = n_a * n_b
    within = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    wide = np.repeat(n_b, pairs)
    return np.repeat(first_a, pairs) + within // wide, np.repeat(first_b, pairs) + within % wide


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the list of id pairs that can ever be linked.

    Tokens that end together share their last bytes, so one is the end of the other: the pairs
    that can occur are counted by the vocabularies (`pairs`, fewer than the bytes of all their
    tokens) and not by the corpus. A link is a place in this list.

    Texts are cut at single spaces between other characters, which no token of either side
    crosses; a piece is aligned once and remembered while it recurs. Where a piece does not come
    back as its own bytes, or the piece model has tokens with an inner space, texts stay whole.
    """

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        value = byte_values()
        vocabulary = self.a.get_vocab()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(value[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.pairs = self._possible_pairs()
        self.text_a = [np.array([f"{i}{s}" for i in range(len(self.bytes_a))], object) for s in ",|"]
        self.text_b = [np.array([f"{i}{s}" for i in range(len(self.bytes_b))], object) for s in ",;"]
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0

    def _possible_pairs(self) -> np.ndarray:
        """Sorted codes a * (number of B ids) + b of all pairs of which one token is the end of the other."""
        ids_a: dict[bytes, list[int]] = {}
        ids_b: dict[bytes, list[int]] = {}
        for ids, tokens in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            for i, t in enumerate(tokens):
                if t:
                    ids.setdefault(t, []).append(i)
        wide, found = len(self.bytes_b), set()
        for t, mine in ids_a.items():
            found.update(a * wide + b for at in range(len(t)) for b in ids_b.get(t[at:], ()) for a in mine)
        for t, mine in ids_b.items():
            found.update(a * wide + b for at in range(len(t)) for a in ids_a.get(t[at:], ()) for b in mine)
        return np.array(sorted(found), np.int64)

    def _encoded(self, pieces: list[str]) -> list[tuple]:
        """(groups, links, tokens of A, tokens of B) of each piece with a space before it; None where the bytes differ."""
        want = [b" " + p.encode() for p in pieces]
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        for_a, for_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = [b"".join(map(for_a, x)) == w and b"".join(map(for_b, y)) == w for x, y, w in zip(a, b, want)]
        a, b = [x for x, s in zip(a, same) if s], [y for y, s in zip(b, same) if s]
        done = iter(self._aligned(a, b))
        return [next(done) if s else None for s in same]

    def _aligned(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        """The pieces one after the other as one stretch of bytes: all their ends, cuts, groups and links at once."""
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        ids_a = np.fromiter((i for x in a for i in x), np.int64, n_a.sum())
        ids_b = np.fromiter((i for x in b for i in x), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = common_cuts(ends_a, ends_b)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        at_a, at_b = expand_links(ends_a, ends_b, cuts)
        links = np.searchsorted(self.pairs, ids_a[at_a] * len(self.bytes_b) + ids_b[at_b]).astype("<u4").tobytes()
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        shown = np.concatenate([np.where(last_a, self.text_a[1][ids_a], self.text_a[0][ids_a]), np.where(last_b, self.text_b[1][ids_b], self.text_b[0][ids_b])])
        shown = shown[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        stop = np.cumsum(n_a + n_b).tolist()
        stop_a = np.cumsum(n_a)
        stop_link = (4 * np.searchsorted(at_a, stop_a)).tolist()
        out, at, at_link = [], 0, 0
        for k, k_link, x, y in zip(stop, stop_link, n_a.tolist(), n_b.tolist()):
            out.append(("".join(shown[at:k]).encode(), links[at_link:k_link], x, y))
            at, at_link = k, k_link
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Have all pieces in the new generation of the memo."""
        if self.held > MEMO_BYTES:
            self.old, self.memo, self.held = self.memo, {}, 0
        missing = pieces.difference(self.memo)
        kept = {p: self.old[p] for p in missing.intersection(self.old)}
        new = list(missing.difference(kept))
        for at in range(0, len(new), _PIECES_AT_ONCE):
            part = new[at : at + _PIECES_AT_ONCE]
            kept.update(zip(part, self._encoded(part)))
        self.memo.update(kept)
        self.held += _ENTRY * len(kept) + sum(len(p) + (len(v[0]) + len(v[1]) if v else 0) for p, v in kept.items())

    def align(self, texts: list[str]) -> list[tuple[int, int, bytes, bytes] | None]:
        """(tokens of A, tokens of B, groups, links) of each text; None for one without tokens."""
        cut = [_ONE_SPACE.split(t) if self.cuttable else [t] for t in texts]
        self._learn({p for t, pieces in zip(texts, cut) if t for p in pieces})
        out: list[tuple[int, int, bytes, bytes] | None] = []
        for text, pieces in zip(texts, cut):
            found = [self.memo[p] for p in pieces] if text else [None]
            if None in found and len(found) > 1:
                found = self._encoded([text])
            if None in found:
                out.append(None)
                continue
            groups, links, n_a, n_b = zip(*found)
            out.append((sum(n_a), sum(n_b), b"".join(groups)[:-1], b"".join(links)))
        return out


def aligner(models: tuple[str, str]) -> Aligner:
    """The worker's aligner of these files, loaded once."""
    if models not in _loaded:
        _loaded[models] = Aligner(*models)
    return _loaded[models]


def _align(models: tuple[str, str], keep_groups: bool):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"] + ["groups"] * keep_groups

    def run(batches):
        align = aligner(models).align
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                done = [x or (0, 0, b"", b"") for x in align([t or "" for t in part.column(1).to_pylist()])]
                arrays = [
                    part.column(0),
                    pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[1] for x in done], pa.int64()),
                    pa.array([x[2].count(b";") + 1 if x[2] else 0 for x in done], pa.int64()),
                    pa.array([len(x[3]) // 4 for x in done], pa.int64()),
                    pa.array([hashlib.sha256(x[2]).hexdigest() if x[2] else "" for x in done], pa.string()),
                    pa.array([x[3] for x in done], pa.binary()),
                ]
                if keep_groups:
                    arrays.append(pa.array([x[2].decode() for x in done], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _count(models: tuple[str, str]):
    def run(batches):
        known = aligner(models)
        total = np.zeros(len(known.pairs), np.int64)
        for batch in batches:
            held = b"".join(x.as_buffer() for x in batch.column(0))
            total += np.bincount(np.frombuffer(held, "<u4"), minlength=len(total))
        seen = np.flatnonzero(total)
        salt = np.full(len(seen), TaskContext.get().partitionId() % SALTS, np.int32)
        codes = known.pairs[seen]
        a, b = np.divmod(codes, len(known.bytes_b))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, salt, total[seen])], ["a_id", "b_id", "salt", "n"])

    return run


def pair_counts(aligned: DataFrame, models: tuple[str, str]) -> DataFrame:
    """(a_id, b_id, n, is_best): how many links of all documents hold an id pair, and whether no other pair of its B id has more.

    Each task adds its links up; its sums meet first by pair and salt, then by pair.
    """
    per_task = aligned.select("links").mapInArrow(_count(models), "a_id bigint, b_id bigint, salt int, n bigint")
    salted = per_task.groupBy("a_id", "b_id", "salt").agg(F.sum("n").alias("n"))
    counts = salted.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    best = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(best, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("is_best"))


def _weigh(counts: np.ndarray, best: np.ndarray):
    def run(batches):
        for batch in batches:
            links = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("links")]
            n_best = pa.array([int(best[x].sum()) for x in links], pa.int64())
            total = pa.array([int(counts[x].sum()) for x in links], pa.int64())
            kept = [n for n in batch.schema.names if n != "links"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), n_best, total], [*kept, "n_best", "count_sum"])

    return run


def align_tokens(docs: DataFrame, models: tuple[str, str] | None = None, keep_groups: bool = False) -> DataFrame:
    """How the tokens of two tokenizers stand to each other in every document (doc_id, text).

    A encodes a space and the text by the byte-level vocabulary models[0], B the text by the piece
    model models[1]; strings of special tokens are plain text. Returns doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum and groups_sha256, with keep_groups also groups, the text that is
    hashed. Byte offsets where tokens of both end part the groups; a link is a pair of tokens that
    end at the same offset; n_best counts the links whose pair is the most frequent one of its B id
    in all documents, count_sum adds up the corpus-wide counts of a document's links.

    The driver and the tasks hold one number for each id pair of which one token is the end of the
    other. The two vocabularies bound these (324,302 with the public ones, 3 MB), whatever
    the corpus. Texts that are null, empty, or do not come back byte by byte from both sides have
    zeros and an empty hash. Repeated rows, ids and null ids are rows like any other and count each
    time; very long texts are aligned whole, in their task; other columns are not read; no rows
    give no rows.
    """
    models = models or default_models()
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
    schema += ", groups string" if keep_groups else ""
    rows = modest_batches(docs.select("doc_id", "text"))
    aligned = materialize(rows.mapInArrow(_align(models, keep_groups), schema), "aligned")
    known = aligner(models)
    counted = pair_counts(aligned, models).toArrow()  # one row for each possible pair at most
    code = counted["a_id"].to_numpy() * len(known.bytes_b) + counted["b_id"].to_numpy()
    place = np.searchsorted(known.pairs, code)
    counts, best = np.zeros(len(known.pairs), np.int64), np.zeros(len(known.pairs), bool)
    counts[place], best[place] = counted["n"].to_numpy(), counted["is_best"].to_numpy(zero_copy_only=False)
    out = schema.replace(", links binary", "") + ", n_best bigint, count_sum bigint"
    return aligned.mapInArrow(_weigh(counts, best), out)
