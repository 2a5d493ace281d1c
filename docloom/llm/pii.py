"""Personal data: overlapping candidates from loose generators, chosen by boosted trees."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.boosting import BoostedTrees
from docloom.llm.common import modest_batches

KINDS = ("email", "ip", "card", "phone")
#: Examples of each kind, made up for training, and the share of them that must be right above a threshold.
TRAIN_EXAMPLES = 900
PRECISION = 0.97
CONTEXT = 28

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Loose generators by kind; they propose, the trees decide.
_LOOSE = {
    "email": re.compile(
        r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63}(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s(?:at|AT|@)\s|\s?@\s?)"
        r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]{2,63}){1,4}"
    ),
    "ip": re.compile(
        r"(?<![\w.:])(?:[0-9]{1,3}(?:\s?[\[(]\.[\])]\s?[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7})(?![\w:])"
    ),
    "card": re.compile(r"(?<![\w.])[0-9](?:[ .\-_/]{0,2}[0-9]){12,18}(?![\w])"),
    "phone": re.compile(r"(?<![\w.+])(?:00[1-9][0-9]{0,2}[ .\-/]?)?\(?[0-9]{2,5}\)?(?:[ .\-/]{1,2}[0-9]{2,5}){1,4}(?![\w])"),
}
_HINTS = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "addr", "from", "login", "client"),
    "card": ("card", "visa", "master", "pay", "carte", "karte", "tarjeta", "credit"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "whatsapp", "ring", "number", "sms"),
}
#: Words that often stand before "at" without being anyone's address.
_COMMON = ("look", "us", "online", "available", "here", "open", "page", "them", "start", "meet", "arrive", "site")
_AGAINST = ("order", "version", "isbn", "invoice", "serial", "page", "sku", "ref", "id", "date", "$", "no.")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (2 if place % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base e-mail pattern, found from each @ so that the time stays linear."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base patterns' spans by kind, in code points."""
    out = {"email": _base_emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    separators = set(re.findall(r"[^\w]", s))
    parts = re.split(r"[.:]", re.sub(r"[\[\]()\s]", "", s))
    return [
        len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        sum(c.isalpha() for c in s), len(separators), s.count("."), s.count("-"), s.count(" "), s.count(":"), s.count("/"),
        float("(" in s), float("[" in s), float("@" in s), float(bool(re.search(r"\bat\b", s, re.I))),
        float(bool(re.search(r"\bdot\b", s, re.I))), float(13 <= len(d) <= 19 and luhn(d)),
        float(bool(d) and d[0] in "3456"), float(len(parts) == 4 and all(p.isdigit() and int(p[-4:]) <= 255 for p in parts)),
        float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")), float(len(set(map(len, groups))) == 1),
        float(any(h in before for h in _HINTS[kind])), float(any(h in before for h in _AGAINST)),
        float(any(h in after for h in _HINTS[kind])), float(before[-1:] in "=#:/"), float(before[-1:].isspace() or not before),
        float(after[:1] in ",. \n;)"), float(d[:1] == "0"), float(len(set(d)) <= 2),
        float(s.split(" ")[0].lower() in _COMMON), float("dot" in s.lower() or s.count("@") > 0 or "(" in s or "[" in s),
    ]


def _examples(kind: str, rng: random.Random, n: int):
    """Made-up (text, start, end, label) candidates of one kind: forms the base patterns miss against look-alikes.

    Wrong cards have the digits, separators and leads of right ones and a broken check digit.
    """
    word = lambda: "".join(rng.choice("aeiounrstlmdg") for _ in range(rng.randint(2, 8)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(n):
        good = rng.random() < 0.5
        hint = rng.choice(_HINTS[kind]) if rng.random() < (0.5 if good else 0.2) else rng.choice(_AGAINST) if not good and rng.random() < 0.4 else word()
        lead = f"{word()} {hint}{rng.choice([' ', ': ', ' ', ' is '])}"
        if kind == "email":
            user, site, top = word() + rng.choice(["", ".", "_"]) + word(), word(), rng.choice(["com", "org", "net", "de", "fr"])
            if good:
                at = rng.choice([" at ", " [at] ", "(at)", " @ ", " (at) ", " AT "])
                dot = rng.choice([" dot ", " [dot] ", ".", "(dot)", " DOT "])
                s = user + at + site + (dot if at.strip().lower() != "at" or dot != "." else " dot ") + top
            else:
                s = f"{rng.choice([word(), *_COMMON])} {rng.choice(['at', 'at', '@'])} {rng.choice([word(), 'docs', 'www'])}.{rng.choice([word(), 'org', 'com', 'then'])}"
        elif kind == "ip":
            if good:
                sep = rng.choice(["[.]", "(.)", ":"])
                s = sep.join(str(rng.randint(1, 255)) for _ in range(4)) if sep != ":" else ":".join(f"{rng.randint(256, 65535):x}" for _ in range(8))
            else:
                s = rng.choice([
                    f"{rng.randint(0, 23)}:{num(2)}:{num(2)}", ":".join(f"{rng.randint(0, 255):02x}" for _ in range(rng.choice([3, 6]))),
                    rng.choice(["[.]", "(.)"]).join(str(rng.randint(256, 999) if k != 1 else rng.randint(0, 999)) for k in range(4)), f"{rng.randint(1, 28)}:{rng.randint(1, 40)}:{num(1)}",
                ])
        elif kind == "card":
            d = num(rng.choice([12, 14, 15, 15, 15, 18]))
            last = next(c for c in "0123456789" if luhn(d + c))
            d += last if good else rng.choice([c for c in "0123456789" if c != last])
            sep = rng.choice([".", "_", "/", " - ", ". "] if good else ["", "", " ", "-", ".", "_", "/", " - "])
            s = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            if good:
                s = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{rng.choice('1347')}{num(1)} {num(3)} {num(3)} {num(3)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)}/{num(3)} {num(3)}"])
            else:
                s = rng.choice([
                    f"{rng.choice(['19', '20'])}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}.{num(2)}", f"{num(4)} {num(4)} {num(4)} {num(4)} {num(4)}",
                    f"{num(3)} {num(3)}", f"{num(2)} {num(3)} {num(3)}", f"{num(2)}-{num(3)}", f"978-{num(1)}-{num(2)}-{num(4)}{num(2)}-{num(1)}", f"{num(3)}-{num(2)}-{num(4)}", f"{rng.choice(['19', '20'])}{num(2)}-{rng.choice(['19', '20'])}{num(2)}",
                ])
        yield f"{lead}{s} {word()} {word()}", len(lead), len(lead) + len(s), float(good)


#: Sentences of other make than the examples, by which the thresholds are set: a candidate stands between
#: braces, after + where it is personal data and after - where it is not.
_SENTENCES = {
    "email": """
        Write to +{jane.doe (at) example (dot) org} before Friday.
        You can reach the editor under +{press [at] harbour-times [dot] com}.
        His address, +{m_keller @ uni-bonn.de}, is still valid.
        Questions go to +{help(at)library.net} or to the desk.
        Mail me: +{sam at fastmail dot com}, I answer at night.
        Kontakt: +{info [at] gasthof-linde.de} oder telefonisch.
        Contact +{billing AT cornershop DOT net} about the invoice.
        Courriel : +{a.dupont (at) mairie.fr}, bureau 12.
        Send it to +{r.ortiz(at)correo(dot)es} by noon.
        Reach out to +{team [at] opendata [dot] org} for access.
        The manual is -{online at docs.python.org} for everyone.
        More photos are -{available at gallery.example} from Monday.
        They met -{us at station.Then} they left together.
        Please have a -{look at example.com} for details.
        We stopped -{looking at noon.It} rained.
        The shop, -{open at ten.Closed} on Sundays, sells tea.
        See -{us at www.trainline} for tickets.
        Prices start -{here at shop.then} they rise.
    """,
    "ip": """
        The login came from +{10[.]20[.]30[.]40} at night.
        Block +{203(.)0(.)113(.)7} on the server.
        Host +{192[.]168[.]1[.]77} does not answer.
        The client +{2001:db8:85a3:8d3:1319:8a2e:370:7348} was refused.
        Its address was +{fe80:1234:5678:9abc:def0:1111:2222:3333} all along.
        Traffic to +{198[.]51[.]100[.]23} was dropped.
        The train left at -{10:42:07} sharp.
        Lap time -{1:02:33} was a record.
        The recording runs -{02:13:45} in full.
        Device -{00:1b:44:11:3a:b7} joined the network.
        Part number -{300(.)412(.)777(.)901} is sold out.
        A ratio of -{12:24:8} worked best.
        Verse -{3:16:2} is often quoted.
        Sunset at -{20:15:00} local time.
    """,
    "card": """
        Pay with card +{4111.1111.1111.1111} if you can.
        The number +{5500/0000/0000/0004} was on the slip.
        Visa +{4012_8888_8888_1881} expired in May.
        He read out +{4222 - 2222 - 2222 - 2220} twice.
        On the card it says +{3782.8224.6310.005} in small print.
        Charged to +{6011.1111.1111.1117} yesterday.
        Order -{4111.1111.1111.1112} has shipped.
        Tracking code -{9400111899223817} shows no progress.
        Serial -{5500/0000/0000/0007} is engraved below.
        Our account -{4012888888881882} was closed.
        Invoice -{1234567890123456} is overdue.
        He paid with card -{4539148803436468} or so he said.
        The meter -{8839_2217_0042_1197} was read in June.
        Parcel -{3782.8224.6310.006} went missing.
        The value -{1414213562373095} has sixteen digits.
        A run took -{3141592653589790} steps.
    """,
    "phone": """
        Call +{(212) 555-0187} after six.
        Tel. +{030 12 34 56 78} or ask at the door.
        My number is +{415-555-0132}, leave a message.
        Fax +{0049 301 234 567} is still in use.
        Ring +{0151/234 567} when you arrive.
        The office, +{646.555.0199}, opens at nine.
        Phone +{01 44 32 18 90} for a table.
        WhatsApp +{0044 207 946 018} works best.
        The treaty of -{1998-04-10} ended it.
        Due on -{12/03/2021} at the latest.
        Version -{10.15} came out in autumn.
        ISBN -{978-3-16-148410-0} is out of print.
        It cost -{12 500 000} in total.
        The war of -{1914-1918} changed it.
        Born -{24.12.1963} in Graz.
        Form -{123-45-6789} has two pages.
        Page -{112-115} has the table.
        A crowd of -{120 000} came.
        Reference -{4471 2210 9981 2034 7716} was quoted.
        Order -{21-884} is ready.
    """,
}


def labelled_sentences(kind: str) -> list[tuple[str, int, int, float]]:
    """(text, start, end, label) of each line of _SENTENCES of a kind."""
    out = []
    for line in filter(None, map(str.strip, _SENTENCES[kind].splitlines())):
        at, stop = line.index("{"), line.index("}")
        out.append((line[: at - 1] + line[at + 1 : stop] + line[stop + 1 :], at - 1, stop - 2, float(line[at - 1] == "+")))
    return out


@cache
def _model(kind: str, examples: int, precision: float) -> tuple[BoostedTrees, float]:
    """Trees, and the threshold above which they are right often enough on the labelled sentences and on
    examples kept apart."""
    rows = list(_examples(kind, random.Random(f"{kind}:7"), examples))
    x = np.array([_features(t, a, b, kind) for t, a, b, _ in rows])
    y = np.array([r[3] for r in rows])
    fit = np.arange(len(y)) % 3 > 0
    trees = BoostedTrees().fit(x[fit], y[fit])
    sentences = labelled_sentences(kind)
    other = np.array([_features(t, a, b, kind) for t, a, b, _ in sentences])
    least = 0.5
    for p, truth in ((trees.predict(x[~fit]), y[~fit]), (trees.predict(other), np.array([r[3] for r in sentences]))):
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(right >= precision)
        around = p[order][ok[-1] : ok[-1] + 2] if len(ok) else np.array([1.1])  # between the last one taken and the next
        least = max(least, float(around.mean()))
    return trees, least


#: What joins groups of digits to one number, before and behind a span.
_DIGITS_BEFORE = re.compile(r"[0-9][ .\-/()]?\Z")
_DIGITS_BEHIND = re.compile(r"[ .\-/()]?[0-9]")


def _is_piece(text: str, start: int, end: int) -> bool:
    """Whether a span of digits is but a piece of a longer run of groups of digits."""
    return bool(_DIGITS_BEFORE.search(text, max(0, start - 3), start) or _DIGITS_BEHIND.match(text, end))


def _candidates(text: str, kind: str) -> list[tuple[int, int]]:
    """Overlapping proposals of a kind's loose generator: a later one may start inside an earlier one.

    A phone or card number is proposed as a whole only, not a piece of a longer number.
    """
    found, at, pattern = [], 0, _LOOSE[kind]
    while m := pattern.search(text, at):
        if kind not in ("phone", "card") or not _is_piece(text, *m.span()):
            found.append(m.span())
        cut = re.compile(r"\W").search(text, m.start() + 1)
        at = max(m.start() + 1, min(m.end(), cut.end() if cut else m.end()))
    return found


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], examples: int = TRAIN_EXAMPLES, precision: float = PRECISION):
    """Candidates that the trees select: best score first, none touching a base span or a better one."""
    taken = _Taken(s for spans in base.values() for s in spans)
    scored = []
    for kind in KINDS:
        hinted = "@" in text or re.search(r"\bdot\b|\[\.|\(\.", text, re.I) if kind == "email" else _DIGIT.search(text)
        if not hinted:
            continue
        spans = [s for s in _candidates(text, kind) if taken.free(*s)]
        if spans:
            trees, least = _model(kind, examples, precision)
            p = trees.predict(np.array([_features(text, a, b, kind) for a, b in spans]))
            scored += [(-q, a, b, kind) for q, (a, b) in zip(p.tolist(), spans) if q >= least]
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for _, a, b, kind in sorted(scored):
        if taken.free(a, b):
            out[kind].append((a, b))
            taken.add(a, b)
    return out


class _Taken:
    """Spans, disjoint within a kind, kept sorted, with a quick test for touching one."""

    def __init__(self, spans):
        self.ends = sorted((b, a) for a, b in spans)

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, (start, end))
        return all(a >= end for _, a in self.ends[k : k + len(KINDS)])  # a place is in one span of each kind at most

    def add(self, start: int, end: int) -> None:
        bisect.insort(self.ends, (end, start))


def _spelled(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, or run of touching spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _scan(examples: int, precision: float):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                extra = added_spans(text, base, examples, precision)
                every = {k: base[k] + extra[k] for k in KINDS}
                sha = hashlib.sha256(_spelled(base).encode()).hexdigest()
                clean = redact(text, every) if any(every.values()) else text
                rows.append((doc, *(len(base[k]) for k in KINDS), sha, _spelled(every), clean))
            if rows:
                types = [pa.int64()] * 5 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def redacted_text(text: Column, examples: int = TRAIN_EXAMPLES, precision: float = PRECISION) -> Column:
    """A text column with all personal data replaced; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = base_spans(t) if t else {k: [] for k in KINDS}
            extra = added_spans(t, spans, examples, precision) if t else spans
            every = {k: spans[k] + extra[k] for k in KINDS}
            out.append(redact(t, every) if any(every.values()) else t)
        return pd.Series(out, dtype=object)

    return clean(text)


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = TRAIN_EXAMPLES, precision: float = PRECISION
) -> DataFrame:
    """Personal data of every text: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted).

    The four counts and base_sha256 cover the base patterns; spans also has what the
    boosted trees add; redacted is the whole text with all spans replaced. Each row is
    handled alone, without a shuffle. The trees are trained in the worker on a fixed
    number of made-up examples; their thresholds are set on sentences of other make.

    Defined results: a null text counts as empty; a null id keeps its row; repeated rows
    give repeated results; an empty table gives no rows; other columns are not read.
    """
    narrow = modest_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return narrow.mapInArrow(
        _scan(examples, precision), f"doc_id bigint, {counts}, base_sha256 string, spans string, redacted string"
    )
