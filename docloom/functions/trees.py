"""Mind-map trees: bounded, cleaned JSON out of a model's answer."""

from __future__ import annotations

import json
import re

import pandas as pd
from docloom.functions.values import tolerant_json
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depth, children by level, and characters of titles and summaries by level.
DEPTH = 3
CHILDREN = (6, 4, 4, 0)
TITLE, SUMMARY, ROOT_TITLE, ROOT_SUMMARY = 90, 220, 120, 260


def _clean(value: object, fallback: str, limit: int) -> str:
    text = re.sub(r"\s+", " ", value).strip() if isinstance(value, str) else ""
    return (text or fallback)[:limit]


def _node(given: object, fallback: str, level: int) -> dict:
    given = given if isinstance(given, dict) else {}
    children = given.get("children")
    kept = children[: CHILDREN[level]] if isinstance(children, list) and level < DEPTH else []
    return {
        "title": _clean(given.get("title"), fallback, TITLE),
        "summary": _clean(given.get("summary"), "", SUMMARY),
        "children": [_node(c, f"Idee {i + 1}", level + 1) for i, c in enumerate(kept)],
    }


def normalize_tree(answer: str | None, title: str) -> dict:
    """A tree of at most DEPTH levels below its root, with texts trimmed and cut."""
    try:
        given = json.loads(answer) if answer else {}
    except ValueError:
        given = {}
    given = given if isinstance(given, dict) else {}
    return {
        "title": _clean(given.get("title"), title, ROOT_TITLE),
        "summary": _clean(given.get("summary"), "", ROOT_SUMMARY),
        "root": _node(given.get("root"), title, 0),
    }


def mind_map(answer: Column, title: Column) -> Column:
    """The normalised tree of a model's answer as JSON."""

    @F.pandas_udf("string")
    def tree(answers: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(normalize_tree(a, t or ""), ensure_ascii=False) for a, t in zip(answers, titles)], dtype=object)

    return tree(tolerant_json(answer), title)
