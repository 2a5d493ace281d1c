"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import modest_batches

#: Words and link share that decide a block in the first pass.
LONG_WORDS = 12
STOP_SHARE = 0.2
FEW_STOPS = 0.08
LINK_SHARE = 0.5
MOSTLY_LINKS = 0.9

#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this at from or an have not but which "
    "le la les de des du et un une est que qui dans pour par sur pas au avec ce il "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las del y en se por con una su para al lo como más o".split()
)

#: HTML element names by role.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BREAKS = frozenset(["br", "input"])
_RAW = frozenset("script style noscript template textarea title svg iframe select button canvas audio video".split())
_TO_THE_END = frozenset("script style textarea title".split())
_SELF_CLOSING = frozenset(["p", "li", "dt", "dd", "td", "th", "tr", "option"])
_VOID = frozenset(["hr"])
_FURNITURE = frozenset("nav aside footer head dialog menu".split())
#: Elements that hold a page's content, whatever their class says, and those that may hold its article.
_WRAPPERS = frozenset("html body main article".split())
_CONTAINERS = frozenset(["article", "main"])
#: Words in class, id or role that name page furniture.
_FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidenav widget footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply "
    "replies respond disqus discussion pagination pager copyright disclaimer alert toolbar search complementary contentinfo".split()
)
#: Words that may stand beside these in one class name without changing its meaning ("site-footer", "share-buttons").
_PLAIN_WORDS = frozenset(
    "site page main top bottom left right primary secondary global list item items area box block section bar link links button buttons "
    "icon icons post posts article articles story stories media text message form thread container panel holder unit slot row col inner outer "
    "google facebook twitter more you may also like id the of and in user visitor reader guest customer top below above".split()
)
_LASTING = frozenset("nav aside footer form comment comments commentlist reply replies disqus discussion hidden".split())
#: Furniture whose class gives way when nothing else on the page is main text.
_SOFT = frozenset("banner sidebar widget menu related recommended recommendations social share sharing search promo promotion notice alert complementary header".split())
#: Texts that only mark an advert.
_ADVERT_LABELS = frozenset(["advertisement", "advert", "sponsored", "sponsored content", "anzeige", "werbung", "publicité", "publicidad", "anuncio"])

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*+")
_TAG_REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]+")
#: Scripts written without spaces: about two signs make a word.
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")


@dataclass
class Block:
    """A run of text between block elements and where it stands: container and form are the numbers of the
    innermost article or main and of the outermost form around it, or -1, and heading the level of a heading, or 0."""

    text: str
    words: int
    stops: float
    links: float
    container: int
    form: int
    furniture: str | None
    by_class: bool
    heading: int
    in_list: bool
    label: bool | None = None


@dataclass
class Page:
    """The blocks of a page, and of each article or main, by number, the one around it and the last one inside it."""

    blocks: list[Block]
    parents: list[int]
    lasts: list[int]

    def inside(self, block: Block, container: int | None) -> bool:
        return container is not None and container <= block.container <= self.lasts[container]


def _role(name: str, attrs: str, in_article: bool) -> tuple[str | None, bool]:
    """The word that makes an element page furniture, if any, and whether its class, id or role says so."""
    if name in _FURNITURE or (name == "header" and not in_article):
        return name, False
    if not attrs:
        return None, False
    values: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in values and values["hidden"].lower() != "false" or values.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(values.get("style", "")):
        return "hidden", False
    if name in _WRAPPERS and not (name == "article" and in_article):
        return None, False
    for named in (n for key in ("class", "id", "role") for n in values.get(key, "").split()):
        words = [w for w in _LETTERS.findall(_CAMEL.sub("-", named).lower()) if len(w) > 1]
        own = [w for w in words if w in _FURNITURE_WORDS]
        if own and all(w in _FURNITURE_WORDS or w in _PLAIN_WORDS for w in words):
            return own[0], True
        if words == ["header"] and not in_article:
            return "header", True
    return None, False


def tags_of(page: str):
    """(text before, element name, whether it closes, attributes) for each tag, and the rest with no name.

    Every place is passed over a bounded number of times. Comments and declarations are left
    out; without an end they reach to the end of the page. A tag that no > outside its quoted
    values ends is read to its first >, and so are all after it.
    """
    at, done, last, quotes = 0, 0, page.rfind(">"), True
    missing: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1 : at + 2]
        if sign in ("!", "?") or sign == "/" and not page[at + 2 : at + 3].isalpha():
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + 2 * len(mark) - 2)
            yield page[done:at], "", False, ""
            at = done = end + len(mark) if end >= 0 else len(page)
            continue
        m = _NAME.match(page, at + 1)
        if not m or at > last:
            at += 1
            continue
        rest = _TAG_REST.match(page, m.end()) if quotes else None
        if not rest:
            quotes = False
        end = rest.end() if rest else page.find(">", at) + 1
        name = m[0].lower()
        yield page[done:at], name.lstrip("/"), name[0] == "/", page[m.end() : end - 1]
        at = done = end
        if name in _RAW and page[end - 2] != "/" and name not in missing:
            found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if found:
                at = done = (page.find(">", found.end()) + 1) or len(page)
            elif name in _TO_THE_END:
                at = done = len(page)
            else:
                missing.add(name)
    yield page[done:], "", False, ""


def blocks_of(page: str) -> Page:
    """The blocks of a page in order, with empty ones left out."""
    found: list[Block] = []
    # element, furniture word, whether its class says so, container, form
    stack: list[tuple[str, str | None, bool, int, int]] = [("", None, False, -1, -1)]
    parents: list[int] = []
    lasts: list[int] = []
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    links = forms = 0

    def flush():
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            words = [w.strip(".,;:!?()[]\"'%*#&$").lower() for w in text.split()]
            unspaced = len(_UNSPACED.findall(text))
            inside = len("".join(html.unescape("".join(linked)).split()))
            name, furniture, by_class, container, form = stack[-1]
            found.append(
                Block(
                    text, len(words) + unspaced // 2, sum(w in STOP_WORDS for w in words) / len(words), inside / max(1, len(text.replace(" ", ""))),
                    container, form, furniture, by_class, int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0, name in ("li", "dt", "dd"),
                )
            )
        pieces.clear()
        linked.clear()

    def text(part: str):
        pieces.append(part)
        if links:
            linked.append(part)

    def close():
        name, _, _, container, _ = stack.pop()
        is_open[name] -= 1
        if container != stack[-1][3]:
            lasts[container] = len(parents) - 1

    for before, name, closing, attrs in tags_of(page):
        if before:
            text(before)
        if name == "a":
            links = 0 if closing else 1
        elif name in _BREAKS or name in _RAW:
            text(" ")
        elif name in _BLOCKS:
            flush()
            links = 0
            if closing:
                if is_open[name]:
                    while stack[-1][0] != name:
                        close()
                    close()
            elif name not in _VOID:
                if stack[-1][0] == "p" or stack[-1][0] == name and name in _SELF_CLOSING:
                    close()
                inner, outer, by_class, container, form = stack[-1]
                if inner == "head":
                    outer = None
                own, own_class = _role(name, attrs, container >= 0)
                if name == "form" and form < 0:
                    form, forms = forms, forms + 1
                if name in _CONTAINERS and own is None:
                    parents.append(container)
                    lasts.append(-1)
                    container = len(parents) - 1
                    outer = outer if outer in _LASTING else None
                stack.append((name, own or outer, own_class if own else by_class, container, form))
                is_open[name] += 1
    flush()
    while len(stack) > 1:
        close()
    return Page(found, parents, lasts)


def _is_prose(b: Block) -> bool:
    return b.words >= LONG_WORDS and b.stops >= STOP_SHARE and b.links <= LINK_SHARE


def _judge_forms(page: Page) -> None:
    """Forms are furniture, but for one around the article: it holds most of the page's prose, or its first heading where there is no prose."""
    free = [b for b in page.blocks if not b.furniture]
    prose = sum(len(b.text) for b in free if _is_prose(b))
    held: Counter[int] = Counter()
    for b in free:
        held[b.form] += len(b.text) * _is_prose(b) if prose else b.heading == 1
    for b in free:
        if b.form >= 0 and (2 * held[b.form] < prose or not held[b.form]):
            b.furniture = "form"


def _article(page: Page) -> tuple[int | None, bool]:
    """The innermost article or main that holds most of the text of all of them, and no less than a third
    of the prose outside it; if there is none, whether articles are but teasers beside the page's prose."""
    free = [b for b in page.blocks if not b.furniture]
    held, prose = [0] * len(page.parents), [0] * len(page.parents)
    beside = 0
    for b in free:
        if b.container >= 0:
            held[b.container] += len(b.text)
            prose[b.container] += len(b.text) * _is_prose(b)
        else:
            beside += len(b.text) * _is_prose(b)
    inside, of_articles = sum(held), sum(prose)
    for c in range(len(held) - 1, -1, -1):  # what an inner one holds, those around it hold too
        if page.parents[c] >= 0:
            held[page.parents[c]] += held[c]
            prose[page.parents[c]] += prose[c]
    chosen = max((c for c, n in enumerate(held) if 2 * n > inside and 3 * n >= beside + of_articles - prose[c]), default=None)
    return chosen, beside > inside


def _decide(page: Page, article: int | None, teasers: bool) -> list[bool]:
    """The first pass of `label_blocks`; returns which blocks the measures have decided, so that they tell on others."""
    blocks = page.blocks
    served = any(_is_prose(b) for b in blocks if not b.furniture)
    inside = [page.inside(b, article) for b in blocks]
    first = inside.index(True) if True in inside else 0
    titled = any(b.heading == 1 for b, i in zip(blocks, inside) if i and not b.furniture)
    above = [k for k in range(first) if blocks[k].heading == 1 and not blocks[k].furniture]
    title = above[-1] if above and not titled else None
    tells = [False] * len(blocks)
    for k, b in enumerate(blocks):
        if b.furniture or b.text.strip(" :.-–—").lower() in _ADVERT_LABELS:
            b.label = False
            continue
        if article is not None and not inside[k]:
            b.label = k == title
            continue
        if article is None and teasers and b.container >= 0:
            b.label = False
        elif b.links > LINK_SHARE and (b.in_list or b.links > MOSTLY_LINKS or not inside[k]) and (b.words < LONG_WORDS or not inside[k]):
            b.label = False
        elif _is_prose(b) or b.words >= LONG_WORDS and not served:
            b.label = True
        tells[k] = b.label is not None
    return tells


def label_blocks(page: Page) -> None:
    """Set each block's label: True for main text.

    First pass: furniture, forms, marks of adverts and link lists are not main text, nor is anything
    outside the page's article but the last h1 before it, or inside articles that are but teasers; long
    blocks are decided by their share of stop words, by length and links alone on pages in no language
    served. What is left are short blocks, and wordy ones with few stop words. Second pass: those take
    the label of the nearest block that the measures decided; what is furniture by its element or class
    tells nothing about the blocks beside it. Headings take the label of the decided block that follows.
    At equal distance of unlike ones an article's blocks are main text and others are not; with none
    decided, or none found to be main text, what is left is main text.
    """
    blocks = page.blocks
    _judge_forms(page)
    article, teasers = _article(page)
    tells = _decide(page, article, teasers)
    some = any(t and b.label for t, b in zip(tells, blocks))
    near: list[list[tuple[int, bool] | None]] = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last, side = None, [None] * len(blocks)
        for k in order:
            side[k] = (abs(k - last), blocks[last].label) if last is not None else None
            if tells[k]:
                last = k
        near.append(side)
    for k, b in enumerate(blocks):
        if b.label is not None:
            continue
        sides = [s for s in (near[0][k], near[1][k]) if s]
        closest = {label for d, label in sides if d == min(d for d, _ in sides)}
        if not some:
            b.label = True
        elif b.heading and near[1][k]:
            b.label = near[1][k][1] or (b.heading == 1 and page.inside(b, article))
        elif page.inside(b, article):
            b.label = closest != {False}
        else:
            b.label = closest == {True}


def main_text(page: str | None) -> str:
    """Main text of a page, blocks joined by line feeds; empty when there is none.

    If class names leave nothing, those that are often set around whole pages are not believed.
    """
    found = blocks_of(page or "")
    blocks = found.blocks
    label_blocks(found)
    if not any(b.label for b in blocks) and any(b.by_class and b.furniture in _SOFT and _is_prose(b) for b in blocks):
        for b in blocks:
            b.label = None
            if b.by_class and b.furniture in _SOFT:
                b.furniture = None
        label_blocks(found)
    return "\n".join(b.text for b in blocks if b.label)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, each page by itself in its task.

    Defined results: null or empty html, and pages without main text, give an empty text;
    unclosed elements, comments and quotes are read to the end of what holds them; null
    ids and urls stay null; repeated rows give repeated results; an empty table gives no
    rows; pages of any length are read whole; other columns are not read.
    """
    narrow = modest_batches(pages).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return narrow.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
