"""Numbers, dates, priorities and nested values."""

from __future__ import annotations

from collections.abc import Callable

from docloom.functions.text import WS, js_trim
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, which sends negative halves up."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """Whole percent of part in whole; 0 when there is nothing."""
    return F.when(whole > 0, F.floor(100.0 * part / whole + 0.5)).otherwise(0).cast("bigint")


def plain_number(c: Column) -> Column:
    """A numeric string without white space and with its first comma as a point."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", ""), "^([^,]*),", "$1.")


def is_numeric_text(c: Column) -> Column:
    """Whether a string reads as a plain decimal number."""
    return F.coalesce(plain_number(c).rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))


def to_number(c: Column) -> Column:
    """Chart value of a string: blank and null are 0, what is no number is null."""
    text = plain_number(c)
    return F.when(c.isNull() | (text == ""), F.lit(0.0)).otherwise(text.try_cast("double"))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def to_date_string(c: Column) -> Column:
    """YYYY-MM-DD from year-first or day-first dates with dashes or slashes, or a sheet's serial number; else null.

    The calendar is not checked.
    """
    return bind(js_trim(c), _date_string)


def _date_string(raw: Column) -> Column:
    iso, local = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    part = lambda p, k: F.lpad(F.regexp_extract(raw, p, k), 2, "0")
    serial = F.when(raw.rlike(r"^\d{5}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(raw.try_cast("double")).cast("int")))
    return (
        F.when(raw.rlike(iso), F.concat_ws("-", F.regexp_extract(raw, iso, 1), part(iso, 2), part(iso, 3)))
        .when(raw.rlike(local), F.concat_ws("-", F.regexp_extract(raw, local, 3), part(local, 2), part(local, 1)))
        .when(serial.isNotNull(), F.date_format(serial, "yyyy-MM-dd"))
        .otherwise(F.date_format(raw.try_cast("timestamp"), "yyyy-MM-dd"))
    )


def priority_of(c: Column) -> Column:
    """low, medium or high from English and French words."""
    word = F.lower(js_trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(word.isin("high", "haute", "urgent", "elevee", "élevée"), "high")
        .when(word.isin("low", "basse", "faible"), "low")
        .otherwise("medium")
    )


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(""))


def column_role(header: Column) -> Column:
    """What a spreadsheet column holds, by words in its header."""
    h = F.lower(header)
    has = lambda *words: F.lit(False) if not words else has(*words[1:]) | F.contains(h, F.lit(words[0]))
    return (
        F.when(h.isin("n°", "no", "n") | F.startswith(h, F.lit("n°")), "index")
        .when(has("product", "produit", "name", "nom"), "name")
        .when(has("link", "lien", "url"), "link")
        .when(has("desc"), "desc")
        .when(has("image", "img", "photo"), "image")
        .when(has("price", "prix", "cost", "coût"), "price")
        .otherwise("default")
    )


def nearest_rank(values: Column, p: float) -> Column:
    """Value at rank round((n - 1) p) of a sorted array."""
    at = F.floor((F.size(values) - 1) * p + 0.5) + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), at.cast("int")))


def is_json(c: Column) -> Column:
    """Whether a string is one JSON value and nothing else; the parser alone does not look behind the first value."""
    alone = lambda before, after: F.try_parse_json(F.concat(F.lit(before), c, F.lit(after))).isNotNull()
    return alone("[", "]") & alone('{"a":', "}")


def tolerant_json(c: Column) -> Column:
    """A JSON text out of a model's answer: without code fences, whole or from its first to its last brace; else null."""
    bare = js_trim(F.regexp_replace(c, "(?i)```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(is_json(bare), bare).when(is_json(inner), inner)


def key_points(c: Column) -> Column:
    """Points of a model's answer: a JSON list's filled strings; else bulleted or plain lines of over 10 characters; else the answer."""
    bare = js_trim(F.regexp_replace(c, "(?i)```(?:json)?", ""))
    listed = F.filter(F.from_json(bare, "array<string>"), lambda x: js_trim(x) != "")
    lines = F.transform(F.split(bare, "\n"), lambda x: js_trim(F.regexp_replace(x, r"^\s*[-*•\d.]+\s*", "")))
    lines = F.filter(lines, lambda x: F.length(x) > 10)
    return (
        F.when(is_json(bare) & (F.size(listed) > 0), listed).when(~is_json(bare) & (F.size(lines) > 0), lines).otherwise(F.array(c))
    )
