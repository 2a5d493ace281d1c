"""Text expressions, all as native columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's runtime sees it, beyond what Java's \s covers.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_CONTROLS = "".join(map(chr, (*range(9), 11, 12, *range(14, 32), 127)))
SPACES = " \t\n\v\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
#: Edges of ASCII words.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Words that a lexical query leaves out.
LEXICAL_STOP_WORDS = (
    "a about an and are dans de des du est for is la le les me of on pour que qui the this un une what".split()
)
#: Words that stand for each other in lexical queries.
LEXICAL_ALIASES = {
    "etudiant": ["etudiant", "etudiante", "etudiant(e)", "stagiaire", "student"],
    "student": ["student", "etudiant", "etudiante", "stagiaire"],
    "stagiaire": ["stagiaire", "etudiant", "etudiante", "student"],
    "nom": ["nom", "name", "appele", "appelle"],
    "name": ["name", "nom"],
    "cin": ["cin", "cni", "numero"],
}


def _letters_with_marks() -> tuple[str, str]:
    """Composed Latin letters and the letters they are built on, from the Unicode tables."""
    composed = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in composed if len(unicodedata.normalize("NFD", c)) > 1}
    return "".join(plain), "".join(plain.values())


_MARKED, _PLAIN = _letters_with_marks()


def strip_marks(c: Column) -> Column:
    """Letters without accents; composed Latin letters and combining marks are covered."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[\u0300-\u036f]", "")


def normalize_lexical(c: Column) -> Column:
    """Accent-free lower case, for lexical matching."""
    return F.lower(strip_marks(c))


def js_trim(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.btrim(c, F.lit(SPACES))


def normalize_key(c: Column) -> Column:
    """Column-name form: trimmed, accent-free, lower case, runs of white space and dashes as one underscore."""
    return F.regexp_replace(normalize_lexical(js_trim(c)), r"[\s-]+", "_")


def clean_text(c: Column) -> Column:
    """Extraction clean-up in a fixed order of rewrites (line ends, hyphens, spaces, blank lines, page numbers, controls)."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, r"(?<=[A-Za-z0-9_])-\n(?=[A-Za-z0-9_])", "")
    c = F.regexp_replace(c, " {2,}", " ")
    for end in "\n\u2028\u2029":  # no more than one space is left before a line's end
        c = F.replace(c, F.lit(" " + end), F.lit(end))
    c = F.rtrim(c)
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?m)^\s*\d{1,3}\s*$", "")
    return js_trim(F.translate(c, _CONTROLS, ""))


def chunk_normalize(c: Column) -> Column:
    """Line ends, tabs and blank lines as the chunker wants them."""
    c = F.translate(F.regexp_replace(c, r"\r\n", "\n"), "\t", " ")
    return js_trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def lexical_tokens(c: Column) -> Column:
    """Distinct tokens of two or more ASCII letters or digits, without stop words, in first-seen order."""
    tokens = F.filter(F.split(normalize_lexical(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    return F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, LEXICAL_STOP_WORDS)))


def lexical_groups(c: Column) -> Column:
    """Each token with the words that stand for it."""
    pairs = [x for k, v in LEXICAL_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    aliases = F.create_map(*pairs)
    return F.transform(lexical_tokens(c), lambda t: F.coalesce(F.element_at(aliases, t), F.array(t)))


def regex_escape(c: Column) -> Column:
    """A string as a literal inside a regular expression."""
    return F.regexp_replace(c, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def word_count(c: Column) -> Column:
    """Number of runs of non-white-space characters."""
    return F.size(F.filter(F.split(c, f"{WS}+"), lambda w: w != "")).cast("bigint")


def token_estimate(c: Column) -> Column:
    """Tokens as a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("bigint")


def xml_decode(c: Column) -> Column:
    """The five XML entities, the ampersand first, so that a doubly escaped one is decoded twice."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def xml_blocks(c: Column, tag: str) -> Column:
    """Contents of all elements of a tag, shortest matches, in order."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 text that was read as Latin-1, read again; left alone where that fails."""
    again = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    sure = c.rlike("Ã.|Â.|â[^\\s]?") & ~c.rlike(r"[^\u0000-\u00ff]") & ~F.contains(again, F.lit("�"))
    return F.when(sure, again).otherwise(c)


def column_index(c: Column) -> Column:
    """Spreadsheet column letters as an index from 0."""
    letters = F.split(F.upper(F.regexp_extract(c, "^([A-Za-z]+)", 1)), "")
    return (F.aggregate(letters, F.lit(0).cast("bigint"), lambda a, x: a * 26 + F.ascii(x) - 64) - 1).cast("bigint")


def safe_filename(c: Column) -> Column:
    """File name with unusual characters as underscores, of at most 255 characters."""
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_"), 1, 255)


def truncate(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where text was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def format_bytes(c: Column) -> Column:
    """Size in B, KB, MB or GB with at most one decimal."""
    power = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.log(1024.0, F.greatest(c, F.lit(1))))))
    value = F.round(c / F.pow(F.lit(1024.0), power), 1)
    text = F.regexp_replace(value.cast("string"), r"\.0$", "")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), (power + 1).cast("int"))
    return F.when(c <= 0, F.lit("0 B")).otherwise(F.concat_ws(" ", text, unit))


def highlight(c: Column, terms: list[str]) -> Column:
    """Terms wrapped in mark elements, whatever their case."""
    if not terms:
        return c
    escape = str.maketrans({x: "\\" + x for x in ".*+?^${}()|[]\\"})
    return F.regexp_replace(c, f"(?i)({'|'.join(t.translate(escape) for t in terms)})", "<mark>$1</mark>")


def fixed_segments(c: Column, size: int) -> Column:
    """Consecutive pieces of `size` characters."""
    starts = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int"))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array())


def matched_terms(answer: Column, chunk: Column) -> Column:
    """The first 8 different words of over 4 letters that an answer shares with a passage."""
    words = F.array_distinct(F.filter(F.split(F.lower(answer), "[^A-Za-z0-9_]+"), lambda w: F.length(w) > 4))
    return F.slice(F.filter(words, lambda w: F.contains(F.lower(chunk), w)), 1, 8)
