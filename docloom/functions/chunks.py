"""Chunking of texts into overlapping passages, and packing of paragraphs."""

from __future__ import annotations

import re

import pandas as pd
from docloom.functions.text import chunk_normalize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a passage, of its overlap, and of the shortest passage kept.
SIZE, OVERLAP, LEAST = 600, 120, 80
TRANSLATION_SIZE = 3000

_HEADING = re.compile(r"(#{1,6}\s|\d+\.\s|[A-Z][A-Z\s]{2,}:)", re.ASCII)


class _Packer:
    """Joins units to passages of at most SIZE characters. Short leftovers are lost unless lossless."""

    def __init__(self, lossless: bool):
        self.done: list[str] = []
        self.open = ""
        self.lossless = lossless

    def close(self) -> None:
        if len(self.open) >= LEAST or (self.lossless and self.open):
            self.done.append(self.open)
        self.open = ""

    def add(self, unit: str, glue: str) -> bool:
        """Whether the unit fitted behind what is open."""
        joined = f"{self.open}{glue}{unit}" if self.open else unit
        if len(joined) > SIZE:
            return False
        self.open = joined
        return True


def _pack_words(text: str, lossless: bool) -> list[str]:
    p = _Packer(lossless)
    for word in text.split():
        if not p.add(word, " "):
            p.close()
            p.open = word
    p.close()
    return p.done or [text[:SIZE]]


def _pack_sentences(text: str, lossless: bool) -> list[str]:
    p = _Packer(lossless)
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if p.add(sentence, " "):
            continue
        p.close()
        if len(sentence) <= SIZE:
            p.open = sentence
        else:
            parts = _pack_words(sentence, lossless)
            if lossless:
                p.done.extend(parts[:-1])
            p.open = parts[-1] if lossless else parts[0]
    p.close()
    return p.done or [text]


def chunk_text(text: str, lossless: bool = False) -> list[str]:
    """Passages of a normalised text before overlap.

    Paragraphs are joined while they fit; a heading begins a passage; a long paragraph is cut
    at sentences, a long sentence at words. Leftovers under LEAST characters between
    passages are lost, as in the system this follows; lossless=True keeps them.
    """
    p = _Packer(lossless)
    for paragraph in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        if _HEADING.match(paragraph) and len(p.open) > LEAST:
            p.close()
            p.open = paragraph
            continue
        if p.add(paragraph, "\n\n"):
            continue
        p.close()
        if len(paragraph) <= SIZE:
            p.open = paragraph
            continue
        parts = _pack_sentences(paragraph, lossless)
        if len(parts) <= 1:
            parts = _pack_words(paragraph, lossless)
        p.done.extend(parts[:-1])
        p.open = parts[-1]
    if len(p.open.strip()) >= LEAST or (p.open and (not p.done or lossless)):
        p.done.append(p.open)
    merged: list[str] = []
    for chunk in p.done:
        if merged and len(chunk) < LEAST:
            merged[-1] = f"{merged[-1]} {chunk}"
        else:
            merged.append(chunk)
    return merged


def chunks_of(text: Column, lossless: bool = False) -> Column:
    """Passages of a text column, before overlap."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t, lossless) if t else [] for t in texts], dtype=object)

    return cut(chunk_normalize(text))


def overlapped(chunks: Column, size: int = OVERLAP) -> Column:
    """Each passage behind the end of the one before it, whose first, partial word is cut off."""
    tail = lambda c: F.regexp_replace(F.right(c, F.lit(size)), r"^\S+\s", "")
    before = lambda i: F.get(chunks, i - 1)
    return F.transform(chunks, lambda c, i: F.when(i > 0, F.concat_ws(" ", tail(before(i)), c)).otherwise(c))


def explode_chunks(docs: DataFrame, id_col: str, text_col: str, lossless: bool = False) -> DataFrame:
    """(document_id, chunk_index, text, token_count): the passages of all documents, without a shuffle."""
    cut = docs.select(F.col(id_col).alias("document_id"), chunks_of(F.col(text_col), lossless).alias("chunks"))
    rows = cut.select("document_id", F.posexplode(overlapped(F.col("chunks"))).alias("chunk_index", "text"))
    return rows.withColumn("token_count", F.ceil(F.length("text") / 4).cast("int"))


def pack_paragraphs(text: Column, size: int = TRANSLATION_SIZE) -> Column:
    """Paragraphs joined to parts of at most `size` characters; a longer paragraph stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = F.length(joined) <= size
        flushed = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        return F.struct(F.when(fits, acc["done"]).otherwise(flushed).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    def finish(acc):
        return F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    packed = F.aggregate(F.split(text, r"\n\n+"), start, step, finish)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)
