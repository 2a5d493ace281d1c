"""Interfaces to embedding and text models, with deterministic ones that need no network."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from docloom.functions.text import SPACES
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension and input characters of the embedding model.
DIMENSION, INPUT_CHARS = 384, 8000
#: A sentence or, where it is long, its next 200 characters; what is no part of a word; what is left off a sentence's ends.
SENTENCE = r"[^.!?\n]{1,200}"
NO_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x9F•" + SPACES
EDGES = SPACES + "-*•"
_SENTENCE, _WORD = re.compile(SENTENCE), re.compile(f"[^{NO_WORD}]+")


class Embedder(Protocol):
    """Turns texts into unit vectors."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class TextGenerator(Protocol):
    """Answers a prompt."""

    def generate(self, prompt: str) -> str: ...


#: An instruction, and what makes the client that follows it.
Asked = tuple[str, Callable[[], TextGenerator]]


class HashEmbedder:
    """Unit vectors from hashed words: alike texts are near each other, and no model file is needed."""

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSION))
        for row, text in zip(out, texts):
            for word in text[:INPUT_CHARS].lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % DIMENSION] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class FirstSentences:
    """Answers a prompt with the beginning of its last paragraph."""

    def __init__(self, chars: int = 200):
        self.chars = chars

    def generate(self, prompt: str) -> str:
        return prompt.rsplit("\n\n", 1)[-1][: self.chars]


class FirstOfText(FirstSentences):
    """Answers a prompt of one paragraph and a text with the beginning of the text, whatever lines it has."""

    def generate(self, prompt: str) -> str:
        return prompt.partition("\n\n")[2][: self.chars]


class FirstOfLast(FirstSentences):
    """Answers a prompt over parts with the beginning of the last part."""

    def __init__(self, glue: str, chars: int = 200):
        super().__init__(chars)
        self.glue = glue

    def generate(self, prompt: str) -> str:
        return prompt.partition("\n\n")[2].rsplit(self.glue, 1)[-1][: self.chars]


@lru_cache(maxsize=1)
def weighed_sentences(text: str) -> dict[str, int]:
    """The sentences of a text in order, each once, with how often its words are in the whole text; those without words are left out."""
    told = [(s.strip(EDGES), _WORD.findall(s)) for s in _SENTENCE.findall(text)]
    times = Counter(w for _, words in told for w in words)
    return {s: sum(map(times.__getitem__, set(words))) for s, words in told if words}


class KeySentences:
    """Answers a prompt of one paragraph and a text with the sentences whose words make up most of the whole text, the earlier of equals.

    The answer has a line for each sentence, in the order of the text.
    """

    def __init__(self, most: int, bullet: str = ""):
        self.most, self.bullet = most, bullet

    def generate(self, prompt: str) -> str:
        weights = weighed_sentences(prompt.partition("\n\n")[2])
        best = set(sorted(weights, key=weights.__getitem__, reverse=True)[: self.most])
        return "\n".join(self.bullet + s for s in weights if s in best)


class Fallback:
    """The first of several generators that answers; each is tried again after doubling waits, unless the error is final."""

    def __init__(self, generators: list[TextGenerator], retries: int = 2, wait: float = 2.0, final: Callable[[Exception], bool] = lambda e: False):
        self.generators, self.retries, self.wait, self.final = generators, retries, wait, final

    def generate(self, prompt: str) -> str:
        problem: Exception | None = None
        for generator in self.generators:
            for attempt in range(self.retries + 1):
                try:
                    return generator.generate(prompt)
                except Exception as e:  # noqa: BLE001  providers raise what they like
                    problem = e
                    if self.final(e):
                        break
                    time.sleep(self.wait * 2**attempt if attempt < self.retries else 0)
        raise RuntimeError("no generator answered") from problem


def embedding(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    """Vectors of a text column; the model is made once per task."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            yield pd.Series(list(model.embed([t or "" for t in texts]).astype(np.float32)))

    return embed(text)


def generated(prompt: Column, make: Callable[[], TextGenerator] = FirstSentences) -> Column:
    """Answers to a prompt column, null to no prompt; the client is made once per task."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in parts:
            yield pd.Series([None if p is None else model.generate(p) for p in prompts], dtype=object)

    return answer(prompt)


def generated_over(texts: Column, asked: dict[str, tuple[Asked, Asked]], glue: str) -> Column:
    """Answers by name over an array of texts: to one text at once, to more by text and then over the joined answers, null to none.

    The clients are made once per task; a text goes to a worker once, and all is asked about it before the next.
    """

    def told(row: Sequence[str], models: list) -> list[str | None]:
        by_text = [[model.generate(f"{instruction}\n\n{t}") for (instruction, model), _ in models] for t in row]
        if len(by_text) > 1:
            return [model.generate(f"{instruction}\n\n{glue.join(parts)}") for (_, (instruction, model)), parts in zip(models, zip(*by_text))]
        return by_text[0] if by_text else [None] * len(models)

    @F.pandas_udf(f"struct<{', '.join(f'{name}: string' for name in asked)}>")
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = [tuple((instruction, make()) for instruction, make in pair) for pair in asked.values()]
        for rows in parts:
            yield pd.DataFrame([told(row, models) for row in rows], columns=list(asked), dtype=object)

    return answers(texts)
