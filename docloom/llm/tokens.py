"""Byte-level BPE ids of whole texts with a memo of recurring pieces."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Bytes of one of the memo's two generations; with about as much for the other this bounds a worker's memory.
MEMO_BYTES = 72 << 20
#: Bytes that an entry takes besides its characters and ids.
_ENTRY = 170
#: Pieces that are encoded as one string.
_JOINED = 256

_TWO_SPACES = re.compile(r"\s\s")
_ONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, PieceEncoder] = {}


def default_tokenizer() -> str:
    """Place of the public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Encodes texts cut at single spaces and line ends.

    The pre-tokenizer never joins what stands before a single space or line end with
    what follows it, so such pieces are encoded apart and remembered. A text with two
    white-space characters in a row is cut at single spaces between other characters
    only; one with a special token's string is encoded whole.

    The memo has two generations: what a batch of texts uses is entered in, or moved to,
    the new one; when that is full it becomes the old one and the former old one goes. So
    frequent pieces stay, and no more than the rare ones are encoded again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():  # each sign of a byte-level token stands for a byte
            self.token_bytes[number] = len(token)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces whose encodings, one after the other, are the text's; None if it must stay whole."""
        if any(s in text for s in self.special):
            return None
        if _TWO_SPACES.search(text):
            return _ONE_SPACE.split(text)
        return text.replace("\n", " \n").split(" ")

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of spelled pieces, none of which ends in white space: encoded together and cut by their bytes."""
        out: list[bytes] = []
        groups = [pieces[at : at + _JOINED] for at in range(0, len(pieces), _JOINED)]
        encoded = self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, encoded):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.cumsum(self.token_bytes[ids])
            want = np.cumsum(np.fromiter((len(p.encode()) for p in group), np.int64, len(group)))
            stop = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
            if not np.array_equal(ends[stop], want):
                out += self._whole(group)
                continue
            raw, at = ids.tobytes(), 0
            for k in (4 * (stop + 1)).tolist():
                out.append(raw[at:k])
                at = k
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Have all pieces in the new generation."""
        if self.size > MEMO_BYTES:
            self.old, self.memo, self.size = self.memo, {}, 0
        missing = pieces.difference(self.memo)
        kept = {p: self.old[p] for p in missing.intersection(self.old)}
        new = list(missing.difference(kept))
        for at in range(0, len(new), 20_000):
            part = [p for p in new[at : at + 20_000] if p and not p[-1].isspace()]
            kept.update(zip(part, self._joined([p if p[0] == "\n" else " " + p for p in part])))
            rest = [p for p in new[at : at + 20_000] if p not in kept]
            kept.update(zip(rest, self._whole([p if p[:1] == "\n" else " " + p for p in rest])))
        self.memo.update(kept)
        self.size += _ENTRY * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; equal texts are encoded once."""
        distinct = list(dict.fromkeys(texts))
        cut = [self._pieces(t) for t in distinct]
        self._learn({p for pieces in cut if pieces for p in pieces[1:]})
        heads = list({pieces[0] for pieces in cut if pieces})
        head = dict(zip(heads, self._whole(heads)))
        whole = iter(self._whole([t for t, pieces in zip(distinct, cut) if pieces is None]))
        known = self.memo.__getitem__
        done = {
            t: next(whole) if pieces is None else head[pieces[0]] + b"".join(map(known, pieces[1:]))
            for t, pieces in zip(distinct, cut)
        }
        return [done[t] for t in texts]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this file, loaded once."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]
