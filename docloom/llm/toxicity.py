"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, modest_batches, release
from docloom.llm.rolling import by_bytes

#: Labelled rows that the model is fitted on at most (those of smallest hash), and its landmarks.
TRAIN_ROWS = 6000
LANDMARKS = 40
#: Kernel value from which a landmark is too much like an earlier one.
ALIKE = 0.5
#: Landmarks that chance alone may be expected to bring: the floor of the likelihood ratio follows from it and the number of candidates.
BY_CHANCE = 0.5
ORDER = 3
DECAY = 0.7
#: Powers of the kernel, each a kernel by itself, that the machine weighs: higher ones tell strong likeness apart.
POWERS = (1, 2, 4)
#: Letters of a word's windows, and of the shortest landmark.
WINDOW = 8
LEAST = 3
#: Rows of each of the two generations of a worker's memo, and texts and tokens that are scored together.
MEMO_WORDS = 150_000
TEXTS_AT_ONCE = 256
TOKENS_AT_ONCE = 50_000

#: Characters commonly written for letters.
_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_INNER = re.compile(r"[^\W\d_]+", re.UNICODE)
_SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){3,}(?!\S)")


def normal_word(token: str) -> str:
    """Lower-case letters of a token: look-alike digits and signs inside it are read as letters, others go."""
    token = token.lower()
    if token.isalpha():
        return token
    core = token.strip(".,;:!?|\"'()[]{}<>*#%&$-_=+")
    if not core.isalpha():
        core = "".join(_LOOKALIKES.get(c, c) for c in core)
        core = "".join(_INNER.findall(core))
    return core


def tokens_of(text: str) -> set[str]:
    """Distinct tokens between white space, and those that letters spelled apart make."""
    tokens = set(text.split())
    tokens.update("".join(c for c in m[0] if c.isalnum()) for m in _SPACED.finditer(text))
    return tokens


def parts_of(word: str) -> list[str]:
    """Overlapping windows that cover a word, those of its start marked; of long words twice as wide ones too, for inserted letters."""
    parts = ["^" + word[:WINDOW]] + [word[at : at + WINDOW] for at in range(2, len(word) - LEAST, 2)]
    if len(word) > WINDOW:
        parts += ["^" + word[: 2 * WINDOW]] + [word[at : at + 2 * WINDOW] for at in range(4, len(word) - WINDOW, 4)]
    return parts


def powers(x: np.ndarray) -> np.ndarray:
    """Kernel values raised to each of POWERS, one block after the other."""
    return np.concatenate([x**p for p in POWERS], axis=-1)


def _codes(words: list[str]) -> np.ndarray:
    """Code points, padded with 0."""
    width = max(map(len, words), default=1) or 1
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def subsequence_kernel(a: list[str], b: list[str] | None, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of a[i] and b[i] for each i: common subsequences of
    `order` letters, each weighted by decay to the power of the lengths it spans in both.
    Without b, of each a[i] and itself."""
    s = _codes(a)
    t = s if b is None else _codes(b)
    rows, m, n = len(a), s.shape[1], t.shape[1]
    if not rows or m < order or n < order:
        return np.zeros(rows)
    same = ((s.T[:, None] == t.T[None]) & (s.T[:, None] > 0)).astype(np.float32)
    inner = np.ones((m + 1, n + 1, rows), np.float32)
    for _ in range(order - 1):
        step = decay**2 * same * inner[:m, :n]
        inner = np.zeros((m + 1, n + 1, rows), np.float32)
        for j in range(1, n + 1):  # first along b, then along a: each letter passed costs a factor
            inner[1:, j] = decay * inner[1:, j - 1] + step[:, j - 1]
        for i in range(2, m + 1):
            inner[i] += decay * inner[i - 1]
    return decay**2 * np.einsum("ijr,ijr->r", same, inner[:m, :n], dtype=np.float64)


def largest(values: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest of values[index], by column, in each of the runs of index that begin at `first`; runs are taken together place by place."""
    count = np.diff(np.append(first, len(index)))
    order = np.argsort(-count, kind="stable")
    start, count = first[order], count[order]
    best = values[index[start]]
    for at in range(1, count[0] if len(count) else 0):
        live = int(np.searchsorted(-count, -at))  # runs of more than `at` rows
        np.maximum(best[:live], values[index[start[:live] + at]], out=best[:live])
    out = np.empty_like(best)
    out[order] = best
    return out


class Landmarks:
    """Normalised kernel between words and landmark words.

    The kernel of order 3 is the inner product of two sparse vectors, which hold for every
    three letters the weights of their common subsequences. Those of the landmarks are
    laid out in a table by letters once; a word looks up its own threes in it.
    """

    def __init__(self, words: list[str], decay: float = DECAY):
        self.words, self.decay = words, decay
        self.self_kernel = subsequence_kernel(words, words, ORDER, decay)
        letters = sorted(set("".join(words)))
        self.letters, self.base = np.array([ord(c) for c in letters], np.uint32), len(letters) + 1
        self.threes: dict[int, tuple[np.ndarray, ...]] = {}
        held: dict[int, np.ndarray] = {}
        for k, word in enumerate(words):
            if len(word) < ORDER:
                continue
            codes, weights = self._threes_of(_codes([word]))
            for code, weight in zip(codes[0].tolist(), weights.tolist()):
                held.setdefault(code, np.zeros(len(words), np.float32))[k] += weight
        self.row = np.zeros(self.base**3, np.int32)
        self.row[list(held)] = np.arange(1, len(held) + 1)
        self.weights = np.concatenate([np.zeros((1, len(words)), np.float32), *(v[None] for v in held.values())])

    def _threes_of(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each three letters of words of one length (0 if no landmark has one of them), and the weights by place."""
        n = grid.shape[1]
        if n not in self.threes:
            places = np.array(list(combinations(range(n), ORDER)), np.int64)
            self.threes[n] = (*places.T, (self.decay ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32))
        i, j, k, weights = self.threes[n]
        at = np.minimum(np.searchsorted(self.letters, grid), len(self.letters) - 1)
        index = np.where(self.letters[at] == grid, at + 1, 0).astype(np.int32)
        a, b, c = index[:, i], index[:, j], index[:, k]
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, 0), weights

    def similar(self, words: list[str]) -> np.ndarray:
        """(word, landmark) values from 0, with nothing shared, to 1, for equal words."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            mine = np.flatnonzero(lengths == n)
            for at in range(0, len(mine), 2048):
                rows = mine[at : at + 2048]
                part = [words[r] for r in rows.tolist()]
                codes, weights = self._threes_of(_codes(part))
                held = self.row[codes]
                which, three = np.nonzero(held)
                if not len(which):
                    continue
                shared = self.weights[held[which, three]] * weights[three, None]
                first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                hit = which[first]
                own = subsequence_kernel([part[h] for h in hit.tolist()], None, ORDER, self.decay)
                out[rows[hit]] = np.add.reduceat(shared, first) / np.sqrt(own[:, None] * self.self_kernel)
        return np.clip(out, 0, 1)


class WordScorer:
    """Best landmark values over a text's words, with a memo of recurring tokens.

    The memo has two generations of at most MEMO_WORDS tokens: what a group of texts uses is
    entered in, or moved to, the new one; when that is full it becomes the old one. Tokens of one word share its row of values.
    Values are short floats from 0 to 1, compared by their bits, whose order is the same.
    """

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.old: tuple[dict[str, int], dict[str, int], list[str], np.ndarray] = ({}, {}, [], self._blank(0))
        self.rows: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.values = self._blank(0)

    def _blank(self, rows: int) -> np.ndarray:
        return np.zeros((rows, len(self.landmarks.words)), np.uint16)

    def _of_words(self, words: list[str]) -> np.ndarray:
        """Values of different words: the best of each one's parts."""
        cut = [parts_of(w) for w in words]
        place: dict[str, int] = {}
        index = np.array([place.setdefault(p, len(place)) for parts in cut for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum([len(parts) for parts in cut])[:-1]])
        return largest(self.landmarks.similar(list(place)).astype(np.float16).view(np.uint16), index, first)

    def _learn(self, tokens: set[str]) -> None:
        """Have all tokens in the new generation."""
        if len(self.rows) > MEMO_WORDS:
            self.old = (self.rows, self.words, list(self.words), self.values[: len(self.words)].copy())
            self.rows, self.words = {}, {}
        known, old_words, named, values = self.old
        missing = list(tokens.difference(self.rows))
        words = [named[known[t]] if t in known else normal_word(t) for t in missing]
        needed = [w for w in dict.fromkeys(words) if w not in self.words]
        kept, new = [w for w in needed if w in old_words], [w for w in needed if w not in old_words]
        need = len(self.words) + len(needed)
        if need > len(self.values):
            grown = self._blank(need + need // 2)
            grown[: len(self.words)] = self.values[: len(self.words)]
            self.values = grown
        for part, of in ((kept, lambda ws: values[[old_words[w] for w in ws]]), (new, self._of_words)):
            for at in range(0, len(part), 10_000):
                some = part[at : at + 10_000]
                start = len(self.words)
                self.values[start : start + len(some)] = of(some)
                self.words.update(zip(some, range(start, start + len(some))))
        self.rows.update(zip(missing, map(self.words.__getitem__, words)))

    def features(self, texts: list[str]) -> np.ndarray:
        """(text, landmark): the best value of any word in the text."""
        out = np.zeros((len(texts), len(self.landmarks.words)), np.float32)
        found = [tokens_of(t) for t in texts]
        for block in by_bytes([len(f) for f in found], TOKENS_AT_ONCE):
            if any(f for f in found[block]):
                self._learn(set().union(*found[block]))
                some = [k for k in range(block.start, block.stop) if found[k]]
                index = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(found[k] for k in some)), np.int64)
                sizes = [len(found[k]) for k in some]
                out[some] = np.maximum.reduceat(self.values[index], np.concatenate([[0], np.cumsum(sizes)[:-1]])).view(np.float16)
        return out


@dataclass
class ToxicityModel:
    """Landmark words, the weights of a linear machine on Nyström features, and its calibration."""

    words: list[str]
    project: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        margin = powers(features) @ self.project @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine on squared hinge loss by accelerated gradient steps; classes weigh alike."""
    sign = 2.0 * y - 1
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    ones = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    rate = 1 / (2 * np.linalg.norm(ones * np.sqrt(share)[:, None], 2) ** 2 + penalty)
    w = v = np.zeros(ones.shape[1])
    shrink = np.append(np.full(x.shape[1], penalty), 0)
    for k in range(steps):
        lack = np.maximum(0, 1 - sign * (ones @ v))
        grad = -2 * ones.T @ (share * sign * lack) + shrink * v
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic slope and shift of margins by Newton steps, with smoothed labels."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * margin**2).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sketch(text: str) -> int:
    """The smallest hash of five words in a row, which most copies of a text share whatever small edits they have had."""
    words = text.split()
    rows = [" ".join(words[at : at + 5]) for at in range(max(1, len(words) - 4))]
    return min(map(xxhash.xxh3_64_intdigest, rows)) >> 1


def _candidate_rows(batches):
    """(word, toxic, sketch) once per text: the marked beginnings of its words, from LEAST letters on, and pieces from inside them."""
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            mark = sketch(text.as_py() or "")
            words = {w for w in map(normal_word, tokens_of(text.as_py() or "")) if len(w) >= LEAST}
            heads = {"^" + w[:k] for w in words for k in range(LEAST, min(len(w), WINDOW) + 1)}
            heads = sorted(heads | {w[at : at + k] for w in words for k in (5, WINDOW) for at in range(1, len(w) - k + 1)})
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array([toxic] * len(heads), pa.int32()), pa.array([mark] * len(heads))], ["word", "toxic", "sketch"])


def _spread(words: list[str], wanted: int) -> list[str]:
    """The first words of a ranking that are not much like an earlier choice."""
    chosen: list[str] = []
    sizes: list[float] = []
    for word in words:
        if len(chosen) == wanted:
            break
        own = subsequence_kernel([word], [word])[0]
        if own > 0 and (not chosen or (subsequence_kernel([word] * len(chosen), chosen) / np.sqrt(own * np.array(sizes))).max() < ALIKE):
            chosen.append(word)
            sizes.append(own)
    return chosen


def _likelihood_ratio(p: Column, q: Column, n1: int, n0: int) -> Column:
    """Twice the log likelihood ratio of a word's counts among toxic and other texts against one common share; 0 where it is no sign of toxicity.

    For a word that has nothing to do with the label it exceeds 2 log(m) with a chance of about 1 / m.
    """
    def part(k: Column, n: int) -> Column:
        share = (p + q) / (n1 + n0)
        seen = F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
        return seen + F.when(k < n, (n - k) * F.log((1 - k / n) / (1 - share))).otherwise(0.0)

    return F.when(p / n1 > q / n0, 2 * (part(p, n1) + part(q, n0))).otherwise(0.0)


def _feature_rows(words: list[str]):
    def run(batches):
        scorer = WordScorer(Landmarks(words))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                x = scorer.features([t.as_py() or "" for t in part.column(0)])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), part.column(1)], ["x", "toxic"])

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS,
) -> ToxicityModel:
    """Fit on at most train_rows labelled documents that are not held out.

    Landmarks are beginnings and inner pieces of words whose share among toxic texts exceeds their share
    among others most, and so clearly that no more than BY_CHANCE of all candidates would by chance; the driver gets 40 for each landmark and train_rows short feature rows.
    With no labelled row, or one class only, the model is that class's constant score.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(
        F.max((F.col(label_col) > 0).cast("int")).alias("toxic")
    )
    chosen = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"))
        .where(~is_held_out(F.col("doc_id")))
        .join(known, "doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    chosen = materialize(chosen, "training_ids")
    rows = modest_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id")  # train_rows ids, of rows that share one the text of smallest hash
    one = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    sample = materialize(one.select("text", "toxic"), "training")
    release(chosen)
    per_class = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = per_class.get(1, 0), per_class.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(["^none"], np.eye(1), np.zeros(1), 0.0, 1.0, 0.0, 1.0 if n1 else 0.0)
    # copies of one text count once, or what stands in a crowd of them would look like a sign
    once = sample.mapInArrow(_candidate_rows, "word string, toxic int, sketch bigint").groupBy("word", "sketch").agg(F.max("toxic").alias("toxic"))
    counted = once.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    counted = materialize(counted, "counted")
    floor = 2 * log(max(1, counted.count()) / BY_CHANCE)
    ranked = counted.where("p >= 2").withColumn("ratio", _likelihood_ratio(F.col("p"), F.col("q"), n1, n0)).where(F.col("ratio") >= floor)
    ranked = ranked.orderBy(F.desc("ratio"), F.desc(F.length("word")), "word").limit(40 * landmarks)
    words = _spread([r["word"] for r in ranked.collect()], landmarks)
    release(counted)
    if not words:
        return ToxicityModel(["^none"], np.eye(1), np.zeros(1), 0.0, 1.0, 0.0, n1 / (n1 + n0))
    got = sample.mapInArrow(_feature_rows(words), "x array<float>, toxic int").collect()  # at most train_rows rows
    x, y = np.array([r["x"] for r in got], np.float64), np.array([r["toxic"] for r in got], np.float64)
    release(sample)
    order = np.lexsort(np.concatenate([x.T, y[None]]))
    x, y = x[order], y[order]
    gram = Landmarks(words).similar(words).astype(np.float64)
    x, size = powers(x), len(words)
    project = np.zeros((x.shape[1], x.shape[1]))
    for at, block in zip(range(0, len(project), size), np.split(powers(gram), len(POWERS), axis=1)):
        value, vector = np.linalg.eigh((block + block.T) / 2)
        project[at : at + size, at : at + size] = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    weight, bias = train_svm(x @ project, y)
    slope, shift = calibrate(x @ project @ weight + bias, y)
    return ToxicityModel(words, project, weight, bias, max(slope, 1e-3), shift)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The model's score of a text column, null texts counting as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = WordScorer(Landmarks(model.words)) if model.constant is None else None
        for texts in parts:
            x = np.zeros((len(texts), len(model.words)))
            for at in range(0, len(texts) if scorer else 0, TEXTS_AT_ONCE):
                x[at : at + TEXTS_AT_ONCE] = scorer.features([t or "" for t in texts.iloc[at : at + TEXTS_AT_ONCE]])
            yield pd.Series(model.score(x))

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, from its text alone.

    Each row is scored in place, without a shuffle. Defined results: a null text counts
    as empty and gets the score of a text without any landmark; a null id is held out;
    repeated rows give repeated results; words of any length are read in overlapping
    windows; an empty table gives no rows; other columns are not read.
    """
    score = toxicity_score(model, F.col(text_col).cast("string"))
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
