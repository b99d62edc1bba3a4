"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Spans of the base rules always stay. Beside them, looser generators propose spans (addresses written out, telephone numbers
without a plus, card numbers with other lengths or separators, IPv6): boosted trees score each by its format and its surroundings,
and a threshold a kind, set for PRECISION on lines written in another way, decides. Accepted spans that meet a base span or a
better one give way.

There are no labelled spans, so the trees are fitted on SAMPLE synthetic lines drawn by a fixed rule, and the thresholds on half as
many; the driver does so in seconds, and only the trees (a few kilobytes) travel. Documents stream through in whole texts; nothing is shuffled.

Defined cases: null texts are empty; offsets are code points, end exclusive; other columns are ignored by find(), kept by redact().
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import boosting
from tidelog.llm import common as C

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SEED, PRECISION = 6000, 11, 0.99
#: Characters of context on either side.
CONTEXT = 32

# The base rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain.domain, found from each @ so that long runs of letters cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = base_emails(text)
    if _ANY_DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_ANY_DIGIT = re.compile("[0-9]")
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= ))", r"(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= ))"
# The generators: what they propose is meant to be far more than what is kept. Runs are taken whole (possessively), so a text is read once.
GENERATORS = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+ ?{_AT} ?[A-Za-z0-9-]++(?: ?(?:{_DOT}|\.) ?[A-Za-z0-9-]{{2,}}+)++", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)[0-9A-Fa-f:]++(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-]{1,2})[0-9]{2,8}(?:[ ./-][0-9]{2,8}){0,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.,/-])[0-9]{8,12}(?![0-9A-Za-z])"),
}
_SIGNS = {
    "email": re.compile(r"(?:\(|\[|\{|\b)at(?:\)|\]|\}|\b)", re.I),
    "ip": re.compile(r"[0-9A-Fa-f:]:"),
}
# Words that speak for a kind, against any, and endings of domains.
_FOR = {
    "email": "mail email mails contact write correo courriel kontakt reach address".split(),
    "ip": "ip ipv6 host server address addr client from login connect ping dns".split(),
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment paid".split(),
    "phone": "phone tel call mobile fax telefon telefono telephone teléfono téléphone ring whatsapp handy".split(),
}
_AGAINST = "isbn order version date invoice serial page chapter id ref art no nr total sum price amount eur usd tracking mac time at born year part build".split()
_ENDINGS = frozenset("com org net edu gov de fr es io eu info".split())
_WORD = re.compile(r"[^\W\d_]+")


def _is_ipv6(s: str) -> bool:
    try:
        return s.count(":") > 1 and ipaddress.IPv6Address(s) is not None
    except ValueError:
        return False


def features(kind: str, text: str, span: Span) -> list[float]:
    """Format and context of a span as numbers."""
    s, e = span
    inside, before, after = text[s:e], text[max(0, s - CONTEXT) : s].lower(), text[e : e + CONTEXT].lower()
    d = _digits(inside)
    ahead = _WORD.findall(before)[-4:]
    words = set(ahead) | set(_WORD.findall(after)[:2])
    groups = re.findall("[0-9]+", inside)
    parts = inside.split(":")
    return [
        KINDS.index(kind),
        len(inside), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(d)) if len(d) >= 13 else -1.0,
        float(d[:1] in "3456") if d else -1.0,
        float(d[:1] == "0"), float(inside[:1] == "("),
        inside.count(" "), inside.count("-"), inside.count("."), inside.count("/"), inside.count(":"), inside.count(". "),
        float(any(c in inside for c in "([{")), sum(c.isalpha() for c in inside),
        float(re.split(r"[^a-z0-9-]+", inside.lower())[-1] in _ENDINGS),
        float(any(w in words for w in _FOR[kind])), float(any(w in words for w in _AGAINST)), float(bool(ahead) and ahead[-1] in _FOR[kind]), float(bool(ahead) and ahead[-1] in _AGAINST),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in ":="), float(before.rstrip()[-1:] in "$€#/."), float(len(set(d)) <= 2) if d else -1.0,
        float(_is_ipv6(inside)) if kind == "ip" else -1.0, float(len(parts) == 6 and all(len(x) == 2 for x in parts)), max(map(len, parts)) if kind == "ip" else -1.0,
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}.(?:0[1-9]|1[0-2]).[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}", inside))),
    ]


def _card_number(rng: random.Random, n: int) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


# Two ways to write lines; the second sets thresholds, so these hold on forms and words that the trees have not seen.
_STYLES = (
    {"words": "er on an th in de la st or es un men tion".split(), "names": "john anna m.silva k_weber paul.d info sales".split(), "hosts": "example mailbox acme uni-bonn".split(), "seps": " -./", "cue": 0.75, "near": 0.25},
    {"words": "the of and she house river when went with long stone blue und der que les pour".split(), "names": "maria.lopez j-smith office x99 dr.huber support".split(), "hosts": "post-haus firma my-site web4you".split(), "seps": " -.", "cue": 0.6, "near": 0.35},
)


def _email(rng: random.Random, style: dict, good: bool) -> str:
    name, host, end = rng.choice(style["names"]), rng.choice(style["hosts"]), rng.choice(("com", "org", "net", "de", "fr", "es"))
    if good:
        o, c = rng.choice((("(", ")"), ("[", "]"), ("{", "}")))
        return rng.choice((f"{name} {o}at{c} {host}.{end}", f"{name}{o}at{c}{host}{o}dot{c}{end}", f"{name} {o}at{c} {host} {o}dot{c} {end}", f"{name} at {host} dot {end}", f"{name} at mail.{host}.{end}"))
    w = lambda: "".join(rng.choice(style["words"]) for _ in range(rng.randint(1, 2)))
    return rng.choice((f"{w()} at {w()}. {w().title()}", f"{w()} at {w()}. {w().title()}. {w().title()}. {w().title()}", f"{w()} at {w()}.{w()}", f"{w()} at {w()} dot {w()}", f"look at {host}.{end}", f"sold at {rng.randint(2, 99)}.{rng.randint(10, 99)}"))


def _ip(rng: random.Random, style: dict, good: bool) -> str:
    h = lambda: f"{rng.randrange(65536):x}"
    two = lambda: f"{rng.randrange(60):02}"
    if good:
        return rng.choice((":".join(h() for _ in range(8)), f"fe80::{h()}:{h()}", f"2001:db8::{rng.randint(1, 99)}", f"::{rng.randint(1, 9)}", f"{h()}:{h()}::{h()}", f"2a0{rng.randint(0, 9)}:{h()}:{h()}::{rng.randint(1, 9)}"))
    x = lambda: f"{rng.randrange(256):02x}"
    return rng.choice((f"{rng.randint(1, 23)}:{two()}:{two()}", f"{two()}:{two()}:{two()}:{two()}", ":".join(x() for _ in range(6)), "::", f"{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", ":".join(h() for _ in range(7)), f"{x()}:{x()}:", f"{rng.randint(1, 150)}:{rng.randint(1, 30)}::"))


def _card(rng: random.Random, style: dict, good: bool, num) -> str:
    sep = rng.choice(style["seps"])
    if good:
        c = _card_number(rng, rng.choice((13, 14, 15, 15, 16, 16)))
        return sep.join(c[j : j + 4] for j in range(0, len(c), 4)) if rng.random() < 0.6 else c
    return rng.choice((num(13), num(14), num(16), f"{num(4)}{sep}{num(4)}{sep}{num(4)}", f"978{num(10)}", f"20{num(2)}-{num(4)}-{num(4)}", _card_number(rng, 14), f"20240{num(7)}"))


def _phone(rng: random.Random, style: dict, good: bool, num) -> str:
    sep = rng.choice(style["seps"])
    if good:
        return rng.choice((f"({num(3)}) {num(3)}{sep}{num(4)}", f"0{rng.randint(1, 9)}{num(1)} {num(6)}", f"0{rng.randint(1, 9)}{num(2)}{sep}{num(3)}{sep}{num(4)}", f"00{rng.randint(1, 9)}{num(1)}{sep}{num(3)}{sep}{num(3)}{sep}{num(3)}", f"{rng.randint(2, 9)}{num(2)}-{num(3)}-{num(4)}", f"0{num(9)}", f"0{rng.randint(1, 9)}{sep}{num(2)}{sep}{num(2)}{sep}{num(2)}{sep}{num(2)}"))
    day = f"{rng.randint(1, 28):02}"
    return rng.choice((f"{num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(3)}", f"20{num(2)}-0{rng.randint(1, 9)}-{day}", f"{day}.0{rng.randint(1, 9)}.20{num(2)}", f"({num(4)}) {num(2)}-{num(2)}", f"0{num(1)}.0{num(1)}.{num(4)}", num(9), f"{num(3)}-{num(3)}-{num(4)}", f"19{num(2)}-19{num(2)}", num(10)))


def synthetic(n: int = SAMPLE, seed: int = SEED, style: int = 0) -> list[tuple[str, str, Span, int]]:
    """(kind, line, span, 1 if personal): lines by a fixed rule, half of them near misses. Both halves hold some without a word that tells, and some near misses have one that speaks for them."""
    rng, how = random.Random(seed), _STYLES[style]
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(how["words"]) for _ in range(rng.randint(1, 3)))
    filler = lambda k: " ".join(word() for _ in range(k))
    make = {"email": lambda g: _email(rng, how, g), "ip": lambda g: _ip(rng, how, g), "card": lambda g: _card(rng, how, g, num), "phone": lambda g: _phone(rng, how, g, num)}
    out = []
    for i in range(n):
        kind, good = KINDS[i % 4], (i // 4) % 2
        s = make[kind](good)
        cue = rng.choice(_FOR[kind]) if rng.random() < (how["cue"] if good else 0.1) else rng.choice(_AGAINST) if rng.random() < (0.03 if good else 0.5) else word()
        between = filler(1) + " " if rng.random() < how["near"] else ""
        head = f"{filler(rng.randint(0, 5))} {cue}{rng.choice((' ', ': ', ' '))}{between}"
        line = f"{head}{s}{rng.choice(('.', ' ', ', ', ''))}{filler(rng.randint(0, 3))}" if good or rng.random() < 0.8 else f"{head}{rng.choice('$€#')}{s} {filler(2)}"
        at = line.index(s, len(head) - 1)
        hit = [f for m in GENERATORS[kind].finditer(line) if (f := m.span())[0] < at + len(s) and f[1] > at]
        if hit:
            out.append((kind, line, hit[0], good))
    return out


@lru_cache(1)
def trained() -> tuple[boosting.Model, dict[str, float]]:
    """The model, grown and calibrated on lines of the first style, and each kind's threshold, set on lines of the second."""
    table = lambda rows: (np.array([features(k, t, s) for k, t, s, _ in rows]), np.array([r[3] for r in rows], float))
    model = boosting.fit(*table(synthetic()))
    x, y = table(synthetic(SAMPLE // 2, SEED + 1, 1))
    p, kinds = model.probability(x), x[:, 0]
    return model, {k: max(0.5, boosting.threshold_for(p[kinds == i], y[kinds == i], PRECISION)) for i, k in enumerate(KINDS)}


def proposals(text: str) -> list[tuple[str, Span]]:
    out = []
    for kind, pattern in GENERATORS.items():
        if kind in _SIGNS and not _SIGNS[kind].search(text) or kind in ("card", "phone") and not _ANY_DIGIT.search(text):
            continue
        out += [(kind, m.span()) for m in pattern.finditer(text)]
    return out


class _Taken:
    """Places of a text that spans cover."""

    def __init__(self, spans: list[Span]):
        self._starts, self._ends = [], []
        for s, e in sorted(spans):
            if self._ends and s <= self._ends[-1]:
                self._ends[-1] = max(self._ends[-1], e)
            else:
                self._starts.append(s)
                self._ends.append(e)

    def meets(self, span: Span) -> bool:
        at = bisect_left(self._starts, span[1]) - 1
        return at >= 0 and self._ends[at] > span[0]

    def add(self, span: Span) -> None:
        at = bisect_left(self._starts, span[0])
        self._starts.insert(at, span[0])
        self._ends.insert(at, span[1])


def find_spans(texts: list[str], model: boosting.Model, thresholds: dict[str, float]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """(base, all) spans of each text. Of accepted spans that meet, the more probable one stays, of equal ones the earlier."""
    base, taken, asked, rows = [], [], [], []
    for i, t in enumerate(texts):
        b = base_spans(t)
        base.append(b)
        taken.append(_Taken([s for spans in b.values() for s in spans]))
        for kind, span in proposals(t):
            if not taken[i].meets(span):
                asked.append((i, kind, span))
                rows.append(features(kind, t, span))
    every = [{k: list(v) for k, v in b.items()} for b in base]
    if rows:
        p = model.probability(np.array(rows))
        for j in np.argsort(-p, kind="stable").tolist():
            i, kind, span = asked[j]
            if p[j] >= thresholds[kind] and not taken[i].meets(span):
                taken[i].add(span)
                every[i][kind].append(span)
    return [(b, {k: sorted(v) for k, v in e.items()}) for b, e in zip(base, every, strict=True)]


def spelled(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of docs (doc_id, text); counts are of base spans."""
    model, thresholds = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find_spans([t or "" for t in b["text"].to_pylist()], model, thresholds)
            cols = {"doc_id": b["doc_id"]}
            cols |= {f"n_{k}": pa.array([len(f[0][k]) for f in found], pa.int64()) for k in KINDS}
            cols |= {"base_sha256": pa.array([hashlib.sha256(spelled(f[0]).encode()).hexdigest() for f in found], pa.string()), "spans": pa.array([spelled(f[1]) for f in found], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; null texts stay null. Overlapping base spans of several kinds become one."""
    model, thresholds = trained()

    def one(t: str, spans: dict[str, list[Span]]) -> str:
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, v in spans.items() for s, e in v):
            if s >= at:
                out += [t[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[text].to_pylist()
            found = find_spans([t or "" for t in texts], model, thresholds)
            new = pa.array([None if t is None else one(t, f[1]) for t, f in zip(texts, found, strict=True)], b.schema.field(text).type)
            yield b.set_column(b.schema.get_field_index(text), b.schema.field(text), new)

    return C.mapped(docs, run, docs.schema)
