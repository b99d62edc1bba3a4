"""Plain versions of the operators' contracts."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from html import unescape
from math import log, log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def repeats(docs, n=20):
    """(n_words, n_removed, sha256) by row, in order of id."""
    seen, out = set(), []
    for _, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone[k : k + n] = [True] * n
            seen.add(x)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def luhn(d):
    return sum(v - 9 * (v > 9) for k, c in enumerate(d[::-1]) for v in [int(c) * (1 + k % 2)]) % 10 == 0


def personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15],
    }
    return ",".join(f"{k}:{a}:{b}" for k in found for a, b in found[k])


def quality(t):
    w = WORD.findall(t)
    c, cov = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            cov |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)


def licences(t):
    names = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)), [], set()
    for p, label in names.items():
        q = p.split()
        for k in range(len(w)):
            if w[k : k + len(q)] == q:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def notices(t, templates, rare, slack, threshold):
    """(labels by notice, best score) of a text: votes of each template's rarest words for its offset, counted in bins."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    spelled, every = f" {' '.join(w)} ", [x.split() for _, x, _ in templates]
    df = Counter(v for x in every for v in set(x))
    labels, best = set(), 0.0
    for (label, _, must), x in zip(templates, every, strict=True):
        weight = {v: log(1 + len(every) / df[v]) for v in x}
        top = sorted(weight, key=lambda v: (-weight[v], -len(v), v))[:rare]
        bins = defaultdict(set)
        for i, v in enumerate(w):
            for p in range(len(x)):
                if x[p] == v and v in top:
                    for shift in (0, slack):
                        bins[shift, (i - p + shift) // (2 * slack)].add(p)
        score = max((sum(weight[x[p]] for p in ps) for ps in bins.values()), default=0) / sum(weight[v] for v in x if v in top)
        best = max(best, min(1, score))
        if score >= threshold and all(f" {p} " in spelled for p in must):
            labels.add(label)
    return labels, best


def unigrams(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) by row."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs]
    tokens = [[*WORD.findall(low(t or "")), None] for _, t in docs]
    c = Counter(x for h, ts in zip(held, tokens, strict=True) if not h for x in ts)
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    return [(h, len(ts), sum(c[x] > 0 for x in ts), n, round(sum(log10((c[x] + 0.5) / d) for x in ts), 6)) for h, ts in zip(held, tokens, strict=True)]


def pair_scores(docs):
    """Scores by row of the pair model over all counts, quantised but without a filter."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs]
    tokens = [[None, *WORD.findall(low(t or "")), None] for _, t in docs]
    train = [ts for h, ts in zip(held, tokens, strict=True) if not h]
    c, cc = Counter(x for ts in train for x in ts[1:]), Counter(p for ts in train for p in zip(ts, ts[1:], strict=False))
    d = sum(c.values()) + 0.5 * (len(c) + 1)
    q = lambda n: 1.5 * 2 ** (n.bit_length() - 1) - 0.5 if n else 0.0

    def p(v, w):
        a = q(c[v]) / (q(c[v]) + 8)
        return a * min(1, q(cc[v, w]) / max(q(c[v]), 1)) + (1 - a) * (q(c[w]) + 0.5) / (d + 1)

    return [sum(log10(p(v, w)) for v, w in zip(ts, ts[1:], strict=False)) for ts in tokens]


def shingles(t, n):
    w = WORD.findall(low(t or ""))
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def linked(docs, n, num, den):
    """(n_shingles, component, links) by id."""
    sets, inv = {i: shingles(t, n) for i, t in docs}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    up, deg = {i: i for i in sets}, Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in inv[x] if j > i).items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                deg[i] += 1
                deg[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), deg[i]) for i in sets}


def pieces(t, tokenizer, capacity=4096):
    ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    return [(k, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, at in enumerate(range(0, len(ids), capacity)) for x in [ids[at : at + capacity]]]


def article(page):
    """Text of a page whose article is marked and holds only h1, p, b and br."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
    return " ".join(x for x in (" ".join(unescape(b).split()) for b in re.split("</?(?:p|h1)>", body)) if x)


def nearest(item, region):
    """Edits from item to the nearest run of region."""
    before = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(region, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)
