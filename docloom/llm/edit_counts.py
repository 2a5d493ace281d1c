"""Token counts that follow edits: a tree over pre-tokens, of which only touched parts are encoded anew."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import modest_batches
from docloom.llm.pii import KINDS, base_spans
from docloom.llm.rolling import small
from docloom.llm.tokens import default_tokenizer

LEAF_PIECES = 32
MEMO_ENTRIES = 400_000
KEY_CHARS = 48
#: The pre-tokenizer of the byte-level vocabulary, as published with it: the file names no pattern but the
#: byte-level kind, whose pattern this is, so it is fixed with the file's kind and not a choice of ours.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Tokens of single pre-tokens, with a memo; strings of special tokens count as ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, int] = {}
        self.encoded = 0

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not yet known, all together."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        new = [p for p in pieces if p not in self.memo and len(p) <= KEY_CHARS]
        self.memo.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))

    def count(self, piece: str) -> int:
        known = self.memo.get(piece)
        if known is None:
            known = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= KEY_CHARS:
                self.memo[piece] = known
        return known


def counter(path: str) -> PieceCounter:
    """The worker's counter of this vocabulary, loaded once."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


class PieceTree:
    """Characters and tokens of a text's pre-tokens, summed in a segment tree over small blocks of them."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        cuts = range(0, max(1, len(lengths)), LEAF_PIECES)
        self.blocks = [(lengths[k : k + LEAF_PIECES], counts[k : k + LEAF_PIECES]) for k in cuts]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (chars, tokens) in enumerate(self.blocks):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(chars), sum(tokens)
        for k in range(self.size - 1, 0, -1):
            self._add_up(k)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def at(self, place: int) -> tuple[int, int, int]:
        """(block, piece in it, start) of the piece that holds a character; past the end, one beyond the last piece."""
        if place >= self.chars[1]:
            return len(self.blocks) - 1, len(self.blocks[-1][0]), self.chars[1]
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.size
        for k, n in enumerate(self.blocks[block][0]):
            if place < start + n:
                return block, k, start
            start += n
        raise AssertionError("sums disagree with blocks")

    def splice(self, first: tuple[int, int], stop: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Replace the pieces from first up to stop and update the sums above the touched blocks."""
        (b1, k1), (b2, k2) = first, stop
        tail = [part[k2:] for part in self.blocks[b2]]
        self.blocks[b1] = tuple(part[:k1] + new + rest for part, new, rest in zip(self.blocks[b1], (lengths, counts), tail))
        for b in range(b1 + 1, b2 + 1):
            self.blocks[b] = ([], [])
        if len(self.blocks[b1][0]) > 8 * LEAF_PIECES:
            self._build([n for c, _ in self.blocks for n in c], [n for _, t in self.blocks for n in t])
            return
        touched = set()
        for b in range(b1, b2 + 1):
            self.chars[self.size + b], self.tokens[self.size + b] = map(sum, self.blocks[b])
            touched.add((self.size + b) // 2)
        while touched and 0 not in touched:
            for node in touched:
                self._add_up(node)
            touched = {node // 2 for node in touched}


def tree_of(text: str, count: PieceCounter) -> PieceTree:
    """Tree of a whole text."""
    pieces = PIECES.findall(text)
    return PieceTree(list(map(len, pieces)), [count.count(p) for p in pieces])


def usable_edits(text: str, edits: list[dict] | None) -> list[tuple[int, int, str]]:
    """Edits (start, end, new text) in order, cut to the text; one that starts inside an earlier one is left out."""
    return cut_edits(len(text), edits)


def cut_edits(size: int, edits: list[dict] | None) -> list[tuple[int, int, str]]:
    """The same for a text of so many characters."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits or [], key=lambda e: (e["start"], e["end"])):
        start, end = max(0, min(e["start"], size)), max(0, min(e["end"], size))
        if end >= start and (not out or start >= out[-1][1]):
            out.append((start, end, e["text"] or ""))
    return out


def apply_edits(text: str, edits: list[tuple[int, int, str]], tree: PieceTree, count: PieceCounter) -> tuple[str, int]:
    """The edited text and the number of pieces encoded anew; the tree follows the text.

    A piece depends on its characters and the next one, an apostrophe on the next two,
    and white space on its whole run and what follows it; so cutting starts two characters
    before an edit, or before the run of white space that leads to it. It ends at the first
    new boundary past the edit that was a boundary before: from there on the text is the same.
    """
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    final = "".join([*parts, text[at:]])
    shift = redone = k = 0
    while k < len(edits):
        start = edits[k][0] + shift
        back = start - 1
        while back > 0 and final[back].isspace():
            back -= 1
        block, piece, place = tree.at(max(0, min(back, start - 2)))
        delta, reach, lengths, counts = 0, -1, [], []  # reach: end, in the final text, of the edits in this cut
        q = place
        while True:
            while k < len(edits) and edits[k][0] + shift + delta <= max(q, start):
                delta += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                reach = edits[k][1] + shift + delta
                k += 1
            if q >= reach:
                stop = tree.at(q - delta)
                if stop[2] == q - delta:
                    break
            m = PIECES.match(final, q)
            if not m:
                stop = tree.at(q - delta)
                break
            lengths.append(m.end() - q)
            counts.append(count.count(m[0]))
            q = m.end()
        redone += len(lengths)
        tree.splice((block, piece), stop[:2], lengths, counts)
        shift += delta
    return final, redone


def redaction_edits(text: Column) -> Column:
    """Edits that replace the base personal data of a text by its kind in angle brackets."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint,text:string>>")
    def edits(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"start": a, "end": b, "text": f"<{k}>"} for k in KINDS for a, b in base_spans(t)[k]] if t else [] for t in texts], dtype=object
        )

    return edits(text)


def _count_rows(path: str):
    names = ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]

    def run(batches):
        count = counter(path)
        for batch in small(batches, 128):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = [PIECES.findall(t) for t in texts]
            count.learn(set().union(*cut))
            rows = []
            for doc, text, pieces, edits in zip(batch.column(0).to_pylist(), texts, cut, batch.column(2).to_pylist()):
                tree = PieceTree(list(map(len, pieces)), [count.count(p) for p in pieces])
                before, usable = tree.total, usable_edits(text, edits)
                _, redone = apply_edits(text, usable, tree, count)
                rows.append((doc, len(pieces), before, len(usable), redone, tree.total))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return run


def leaf_texts(pieces: list[str]) -> list[str]:
    """The texts of the leaves of a tree over pieces."""
    return ["".join(pieces[k : k + LEAF_PIECES]) for k in range(0, len(pieces), LEAF_PIECES)]


def recount_leaves(leaves, chars: list[int], tokens: list[int], edits: list[tuple[int, int, str]], count: PieceCounter):
    """Leaves of an edited text from those of the text before: (texts, chars, tokens, pieces encoded anew).

    leaves gives the text of a leaf by its number; only leaves that an edit touches and some beside them are
    asked for, others come back as their number. Edits are in order and do not overlap. A piece depends on
    three characters after it, or on a whole run of white space and the next character; so a stretch
    of leaves begins where as much stands before its first edit, and ends where a new piece meets
    the end of an old leaf with as much, unedited, behind it.
    """
    ends = np.cumsum(chars) if chars else np.zeros(0, np.int64)
    n = len(chars)
    leaf_of = lambda place: max(0, min(int(np.searchsorted(ends, place, side="right")), n - 1))
    start_of = lambda leaf: int(ends[leaf - 1]) if leaf else 0
    enough = lambda text: len(text) >= 3 and not text.isspace()
    out_text, out_chars, out_tokens, redone, at, k = [], [], [], 0, 0, 0
    while k < len(edits):
        low = leaf_of(edits[k][0])
        while low > at and not enough("".join(leaves(b) for b in range(low, min(n, leaf_of(edits[k][0]) + 1)))[: edits[k][0] - start_of(low)]):
            low -= 1
        start, last, high = start_of(low), k, low
        while True:
            seen = high
            while seen < n and not enough("".join(leaves(b) for b in range(high, seen))):
                seen += 1
            if last < len(edits) and (last == k or edits[last][0] <= start_of(seen)):
                high = max(high, min(n, leaf_of(edits[last][1]) + 1))
                last += 1
                continue
            old, done, parts = "".join(leaves(b) for b in range(low, high)), 0, []
            for a, b, new in edits[k:last]:
                parts += [old[done : a - start], new]
                done = b - start
            fresh = "".join([*parts, old[done:]])
            view = fresh + "".join(leaves(b) for b in range(high, seen))
            pieces, size = [], 0
            while size < len(fresh):
                pieces.append(PIECES.match(view, size)[0])
                size += len(pieces[-1])
            if size == len(fresh):
                break
            high += 1
        out_text += [*range(at, low), *leaf_texts(pieces)]
        groups = [pieces[q : q + LEAF_PIECES] for q in range(0, len(pieces), LEAF_PIECES)]
        out_chars += chars[at:low] + [sum(map(len, g)) for g in groups]
        out_tokens += tokens[at:low] + [sum(map(count.count, g)) for g in groups]
        redone, at, k = redone + len(pieces), high, last
    return out_text + list(range(at, n)), out_chars + chars[at:], out_tokens + tokens[at:], redone


_LEAVES = "leaf_text array<string>, leaf_chars array<int>, leaf_tokens array<int>"


def _tree_rows(path: str):
    def run(batches):
        count = counter(path)
        for batch in small(batches, 128):
            cut = [PIECES.findall(t or "") for t in batch.column(1).to_pylist()]
            count.learn(set().union(*cut))
            texts = [leaf_texts(pieces) for pieces in cut]
            tokens = [[sum(map(count.count, p[k : k + LEAF_PIECES])) for k in range(0, len(p), LEAF_PIECES)] for p in cut]
            columns = [batch.column(0), pa.array(texts, pa.list_(pa.string())), pa.array([list(map(len, t)) for t in texts], pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sum(t) for t in tokens], pa.int64())], ["doc_id", "leaf_text", "leaf_chars", "leaf_tokens", "n_tokens"])

    return run


def count_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """The token counts of documents to be kept: (doc_id, leaf_text, leaf_chars, leaf_tokens, n_tokens).

    A document is kept as the leaves of its tree, LEAF_PIECES pre-tokens each, with the characters
    and tokens of each; `recount` follows edits on them. A null text has no leaves; null ids and
    repeated rows stay.
    """
    narrow = modest_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_tree_rows(tokenizer_path or default_tokenizer()), f"doc_id bigint, {_LEAVES}, n_tokens bigint")


def _recount_rows(path: str):
    def run(batches):
        count = counter(path)
        for batch in small(batches, 128):
            rows = []
            for r in range(batch.num_rows):
                texts, chars, tokens = batch.column(1)[r], batch.column(2)[r].as_py() or [], batch.column(3)[r].as_py() or []
                usable = cut_edits(sum(chars), batch.column(4)[r].as_py())
                new, new_chars, new_tokens, redone = recount_leaves(lambda b: texts[b].as_py(), chars, tokens, usable, count)
                new = [texts[t].as_py() if isinstance(t, int) else t for t in new]
                rows.append((batch.column(0)[r].as_py(), new, new_chars, new_tokens, sum(new_tokens), len(usable), redone))
            types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "leaf_text", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "n_reencoded"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names) if rows else batch.slice(0, 0)

    return run


def recount(trees: DataFrame, edits: Column, tokenizer_path: str | None = None) -> DataFrame:
    """Kept trees after edits: the columns of `count_trees`, n_edits and n_reencoded.

    edits is an array column of (start, end, text) over trees, as for `edit_token_counts`. Leaves that no
    edit touches keep their text and counts unread; the sums follow. A tree can be edited again and again.
    """
    narrow = modest_batches(trees).select("doc_id", "leaf_text", "leaf_chars", "leaf_tokens", edits.cast(_EDITS).alias("edits"))
    return narrow.mapInArrow(_recount_rows(tokenizer_path or default_tokenizer()), f"doc_id bigint, {_LEAVES}, n_tokens bigint, n_edits bigint, n_reencoded bigint")


def edit_token_counts(
    docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None
) -> DataFrame:
    """Token counts before and after the edits of each row:
    (doc_id, n_pieces, n_tokens, n_edits, n_reencoded, n_tokens_after).

    edits is an array column of (start, end, text) in code points of the text. Each row
    is counted in its own task; n_reencoded is the number of pre-tokens that the edits
    made necessary to encode again.

    Defined results: a null text counts as empty; null edits are none, null new text is
    empty, places beyond the text are moved to its end, and an edit that starts inside an
    earlier one is left out; a null id keeps its row; repeated rows give repeated results;
    an empty table gives no rows; other columns are not read.
    """
    narrow = modest_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), edits.cast(_EDITS).alias("edits"))
    names = ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]
    return narrow.mapInArrow(_count_rows(tokenizer_path or default_tokenizer()), ", ".join(f"{n} bigint" for n in names))
