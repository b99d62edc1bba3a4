"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs cover all training documents. A unit sends its distinct words and pairs once, with how often they
occur in its training documents, so a frequent word costs one entry a unit; parts sum them. For the model, counts are quantised to
powers of two and n-grams enter a Bloom filter once for each level up to theirs; a count is read by probing level after level
until one is missing. The filter holds all words and pairs of training documents, those seen once included, at BITS_EACH bits an
insertion, so its error stays the same and it grows with the corpus: each part of the keys has its own share of it, which its task
fills and probes in blocks of BITS bits at most. Units are answered with the level the filter gives each n-gram they sent, and with
their words' exact counts for the base score. Nothing is collected or broadcast.

p(w | v) = a * min(1, c(v, w) / c(v)) + (1 - a) * (c(w) + 0.5) / (N + 0.5 * (V + 1)), a = c(v) / (c(v) + PRIOR), with c as read
from the filter; the token before the first is the end token. Held out are documents whose crc32(doc_id as text) mod 5 is 1.

Defined cases: null or empty texts are the end token alone; a null id counts as empty text in the checksum; rows with one id are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common as C

BITS, PROBES, BITS_EACH, PRIOR, LEVELS = 1 << 27, 5, 9.0, 8.0, 40
END = C.mix(np.array([0x454E44], C.U64))[0]
_PAIR = C.U64(0x9E6C63D0876A9A63)


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == C.NULL_ID else str(i).encode()) % 5 == 1 for i in ids.tolist()], bool)


class _Tokens:
    """A unit's tokens: words in lower case and one end each document."""

    def __init__(self, unit: C.Unit):
        words, _, _, bounds = unit.words(True)
        docs = len(unit.ids)
        self.bounds = bounds + np.arange(docs + 1)
        self.doc = np.repeat(np.arange(docs), np.diff(self.bounds))
        self.token = np.full(len(words) + docs, END, C.U64)
        ends = np.zeros(len(self.token), bool)
        ends[self.bounds[1:] - 1] = True
        self.token[~ends] = words
        self.held = held_out(unit.ids)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.bounds[:-1]] = END
        self.before = before
        with np.errstate(over="ignore"):
            self.pair = C.mix(before * _PAIR + self.token)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each occurs where train is set)."""
    k, back = np.unique(keys, return_inverse=True)
    return k, np.bincount(back[train], minlength=len(k)).astype("<u4")


def _blobs(unit: int, kind: str, lg: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = C.cut(keys, lg)
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(full), pa.string()), "part": pa.array(full.astype(np.int32)), "unit": pa.array(np.full(len(full), unit, np.int64)), "body": pa.array([keys[at[k] : at[k + 1]].tobytes() + n[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())})


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = len(body) // 12
    return np.frombuffer(body, C.U64, m), np.frombuffer(body, "<u4", m, 8 * m)


def _summed(bodies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (keys, counts), by key."""
    k, back = np.unique(np.concatenate([b[0] for b in bodies]), return_inverse=True)
    return k, np.bincount(back, np.concatenate([b[1] for b in bodies]), len(k)).astype(np.int64)


def _levels(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1)) + 1e-9).astype(np.int64) + 1, 0)


def _middle(levels: np.ndarray) -> np.ndarray:
    """Counts as the middle of their level; 0 if they have none."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels.astype(np.int64) - 1) - 0.5, 0.0)


class LogBloom:
    """A block of the filter."""

    def __init__(self, bits: int = BITS, probes: int = PROBES):
        self.bits, self.probes = bits, probes
        self.data = np.zeros(-(-bits // 8), np.uint8)

    @staticmethod
    def levelled(keys: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return C.mix(keys ^ C.mix(np.asarray(level).astype(C.U64) * C.U64(0xA24BAED4963EE407)))

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """Bit numbers of each probe."""
        size, a, b = C.U64(self.bits), h & C.U64(0xFFFFFFFF), (h >> C.U64(26)) | C.U64(1)
        for k in range(self.probes):
            with np.errstate(over="ignore"):
                yield (a + C.U64(k) * b) % size

    def add(self, h: np.ndarray) -> None:
        bit = np.zeros(8 * len(self.data), bool)
        for at in self.places(h):
            bit[at.astype(np.int64)] = True
        self.data |= np.packbits(bit, bitorder="little")

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h):
            out &= (self.data[(at >> C.U64(3)).astype(np.int64)] >> (at & C.U64(7)).astype(np.uint8)) & 1 > 0
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level that is there; 0 if none is."""
        out, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, LEVELS):
            left = left[self.has(self.levelled(keys[left], level))]
            if not len(left):
                break
            out[left] = level
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return _middle(self.levels(keys))


def modelled(keys: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Levels of a part's keys as the filter gives them, which holds all that occur. A block follows another where the insertions would need more than bits."""
    top, out = _levels(n), np.zeros(len(keys), np.uint8)
    need = np.cumsum(top) * BITS_EACH
    at = np.concatenate(([0], np.searchsorted(need, np.arange(bits, need[-1] if len(need) else 0, bits)), [len(keys)]))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        k, t = keys[lo:hi], top[lo:hi]
        bloom = LogBloom(max(64, int(t.sum() * BITS_EACH)))
        bloom.add(np.concatenate([LogBloom.levelled(k[t >= level], level) for level in range(1, int(t.max(initial=0)) + 1)] or [k[:0]]))
        out[lo:hi] = bloom.levels(k)
    return out


_SUMS = "kind string, part int, unit long, exact binary, levels binary, tokens long, types long"


def _count_part(table: pa.Table, bits: int) -> pa.Table:
    """Sums a part and fills its share of the filter; answers each unit with its n-grams' levels, and its words' counts."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    bodies = [_opened(x) for x in table["body"].to_pylist()]
    keys, n = _summed(bodies)
    levels = modelled(keys, n, bits)
    rows = [(kind, part, None, None, None, int(n.sum()), int((n > 0).sum()))]
    for unit, (sent, _) in zip(table["unit"].to_pylist(), bodies, strict=True):
        at = np.searchsorted(keys, sent)
        rows.append((kind, part, unit, n[at].tobytes() if kind == "word" else None, levels[at].tobytes(), None, None))
    names = ("kind", "part", "unit", "exact", "levels", "tokens", "types")
    types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    out = pa.table({k: pa.array(c, t) for k, c, t in zip(names, zip(*rows, strict=True), types, strict=True)})
    del bodies, keys, n, levels, rows
    C.trim()
    return out


def score(docs: DataFrame, bits: int = BITS, unit_bytes: int = C.UNIT_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text). bits: what a task holds of the filter at a time."""
    spark = docs.sparkSession
    home = C.shared_dir(spark)
    size = C.text_bytes(docs)
    lg = C.parts_for(size / 12)
    units = C.written(C.pack(docs, unit_bytes), f"{home}/units")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, _ in C.units_in(batches):
            t = _Tokens(u)
            train = ~t.held[t.doc]
            yield _blobs(u.id, "word", lg, *_counted(t.token, train))
            yield _blobs(u.id, "pair", lg, *_counted(t.pair, train))

    def count(table: pa.Table) -> pa.Table:
        return _count_part(table, bits)

    sums = C.written(C.mapped(units, send, "kind string, part int, unit long, body binary").groupBy("kind", "part").applyInArrow(count, _SUMS), f"{home}/sums")
    n, v = sums.where("kind = 'word' AND unit IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    floor = n + 0.5 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, r in C.units_in(batches):
            t = _Tokens(u)
            keys, back = np.unique(t.token, return_inverse=True)
            distinct, again = np.unique(t.pair, return_inverse=True)
            exact, level = np.zeros(len(keys), np.int64), {"word": np.zeros(len(keys), np.uint8), "pair": np.zeros(len(distinct), np.uint8)}
            at = {"word": C.cut(keys, lg), "pair": C.cut(distinct, lg)}
            for reply in r["replies"] or ():
                lo, hi = at[reply["kind"]][reply["part"] : reply["part"] + 2]
                level[reply["kind"]][lo:hi] = np.frombuffer(reply["levels"], np.uint8)
                if reply["kind"] == "word":
                    exact[lo:hi] = np.frombuffer(reply["exact"], np.int64)
            docs = len(u.ids)
            c = exact[back]
            base = np.bincount(t.doc, np.log10((exact + 0.5) / floor)[back], docs)
            rough = _middle(level["word"])
            ahead = np.searchsorted(keys, t.before)
            cv = rough[ahead]
            cvw = _middle(level["pair"])[again]
            a = cv / (cv + PRIOR)
            p = a * np.minimum(1.0, cvw / np.maximum(cv, 1.0)) + (1 - a) * ((rough + 0.5) / (floor + 1.0))[back]
            yield pa.RecordBatch.from_pydict({
                "doc_id": C.ids_out(u.ids), "held_out": pa.array(t.held), "n_tokens": pa.array(np.diff(t.bounds), pa.int64()),
                "n_known": pa.array(np.bincount(t.doc[c > 0], minlength=docs), pa.int64()), "train_tokens": pa.array(np.full(docs, n), pa.int64()),
                "base_score": pa.array(base), "score": pa.array(np.bincount(t.doc, np.log10(p), docs)),
            })

    told = sums.where("unit IS NOT NULL").groupBy("unit").agg(F.collect_list(F.struct("kind", "part", "exact", "levels")).alias("replies"))
    return C.mapped(units.join(told, "unit", "left"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


