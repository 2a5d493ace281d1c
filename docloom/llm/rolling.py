"""Hashes of any substring of a byte buffer from one prefix pass, vectorised, and digests that stand for the bytes themselves.

The hashes are polynomials modulo 2^64. They find candidates; texts can be made whose hashes are
equal though their bytes differ, so whoever removes text compares it, or its `digests`.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Fixed odd multipliers of two independent polynomial hashes modulo 2^64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (11, 12)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, for at least n places."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        m = MULTIPLIERS[which]
        up = np.full(size, m, np.uint64)
        down = np.full(size, pow(m, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[which] = have
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of all bits over all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Prefix hashes of a buffer; of() gives the hash of buffer[start:end] for arrays of places, or slices of them."""

    def __init__(self, buffer: bytes | np.ndarray, which: int = 0):
        data = np.frombuffer(buffer, np.uint8) if isinstance(buffer, bytes) else buffer
        up, self.down = _power_tables(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_tables[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


class WordBuffer:
    """Words of many texts in one buffer, one space between words, with hashes of word runs.

    table maps every byte that parts words to a space; words of all texts are numbered
    through, and text t has the words bounds[t] up to bounds[t + 1].
    """

    def __init__(self, texts: list[bytes], table: bytes):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        data = np.frombuffer(b" ".join(texts).translate(table) + b" ", np.uint8)
        space = data == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        self.data = data[keep]
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        kept = np.concatenate([[0], np.cumsum(keep)])[first]
        self._prefix: dict[int, Prefix] = {}
        self.bounds = np.append(np.searchsorted(self.starts, kept), len(self.starts))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of each run of `size` words that lies in one text."""
        count = np.diff(self.bounds)
        text = np.repeat(np.arange(len(count)), count)
        word = np.arange(len(text))
        inside = word + size <= self.bounds[text + 1]
        return word[inside], text[inside]

    def hashes(self, word: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hash of the run of `size` words from each given word on."""
        if which not in self._prefix:
            self._prefix[which] = Prefix(self.data, which)
        return self._prefix[which].of(self.starts[word], self.ends[word + size - 1])

    def digests(self, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """Digest of the words first to stop - 1, for arrays of word numbers."""
        return digests(self.data.tobytes(), self.starts[first], self.ends[stop - 1])


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Cryptographic digests of data[start:end] for arrays of places: 16 bytes that are equal for equal bytes only."""
    view = memoryview(data)
    return [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each run of `width` values."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        span += step
    return best


def sliding_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each run of `width` hashes, the first of equal ones.

    The low bits of a hash give way to its place, so fewer than 2^21 hashes are taken.
    """
    n = len(hashes)
    if n >= 1 << 21:
        raise ValueError("too many hashes at once")
    low = np.uint64((1 << 21) - 1)
    keyed = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width + width, ~np.uint64(0))
    padded[:n] = keyed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (best & low).astype(np.int64)


def by_bytes(sizes: list[int], limit: int):
    """Slices of consecutive items of together at most `limit` bytes, or of one larger item."""
    at = total = 0
    for k, size in enumerate(sizes):
        if total + size > limit and k > at:
            yield slice(at, k)
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def small(batches, rows: int = 512):
    """Arrow batches of at most so many rows, so that few texts are unpacked at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
