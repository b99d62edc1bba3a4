"""Best-fit packing of token sequences by exact-complement hashing.

Texts become token ids (word by word through a memo, which gives the same ids as the whole text because the tokenizer never
looks across ASCII white space), documents longer than a sequence are cut, and only the histogram of piece lengths goes to the
driver: as many numbers as a sequence has tokens, whatever the corpus. There, single, pair and triple sums that fill the gap of
the longest open length exactly are consumed in bulk under the counts; what is left is packed best fit, in bulk too. A single
complement is read from the histogram; pairs are looked up in an index of how many pairs of lengths have each sum, kept up to date
as lengths run out, and triples are a second length, any that is there, with a pair from the index. The result
is a short list of patterns with multiplicities; pieces find their place by their rank among those of their length, which is
counted per task and then offset, so no task orders a common length alone.

Defined cases: null and empty texts are the end token alone; rows with one doc_id are separate documents; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common as C

CAPACITY, END = 4096, 1
#: What a worker process may keep of words and their ids (and as much again of parts of words), and what an entry takes beside both.
MEMO_BYTES, ENTRY_BYTES = 160 << 20, 190

#: Stands between the ids of words.
_BETWEEN = 0xFFFFFFFF
#: Words with other signs than plain ones, among them white space, combining signs and letters whose lower case depends on their neighbours; and words that may hold a special token.
_ODD = re.compile("[^!-~\xa1-\u012f\u0131-\u017f]|<\\|").search


def _of_category(letter: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(33, 0x180)) if unicodedata.category(c)[0] == letter)


# The tokenizer's pattern of parts, said for plain signs.
_CUT = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_of_category('L')}]+|[{_of_category('N')}]|[^\\s{_of_category('L')}{_of_category('N')}]+").findall
# The steps of a tokenizer before its merges that _encoded() repeats.
KNOWN_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"]
# Byte-level vocabularies spell printable bytes as themselves and the others as characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _steps(spec: dict) -> list[str | None]:
    """Names of a tokenizer's steps, its pattern of parts, and how its parts end."""
    every = [s for key, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for s in (spec[key] or {}).get(of, ())]
    return [s["type"] for s in every] + [s["pattern"]["Regex"] for s in every if s["type"] == "Split"] + [spec["model"].get("end_of_word_suffix")]


class _Memo(dict):
    """Ids of strings in two generations. A string that neither has gets an empty bytearray, to be filled with the others of new."""

    def __init__(self, most: int):
        self.most, self.size, self.old, self.new, self.held = most, 0, {}, [], []

    def __missing__(self, s: str) -> bytes | bytearray:
        v = self.old.get(s)
        if v is None:
            v = bytearray()
            self.new.append(s)
            self.held.append(v)
        else:
            self.size += ENTRY_BYTES + len(s) + len(v)
        self[s] = v
        return v

    def fill(self, ids: list[bytes]) -> None:
        """The ids of all of new, in order."""
        deque(map(bytearray.extend, self.held, ids), 0)
        self.update(zip(self.new, ids, strict=True))
        self.size += ENTRY_BYTES * len(ids) + sum(map(len, self.new)) + sum(map(len, ids))
        self.new, self.held = [], []
        if self.size > self.most // 2:  # strings of the last generation that come up again move over
            self.old, self.size = dict(self), 0
            self.clear()


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers. Words of plain letters and signs that no memo has are cut as the tokenizer cuts them, and all their parts go to its merges in one string; other words go to the tokenizer whole."""

    kept: ClassVar[dict[str, Encoder]] = C.KEPT

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._words, self._parts = _Memo(MEMO_BYTES), _Memo(MEMO_BYTES)
        spec = json.loads(self._whole.to_str())
        if _steps(spec) == KNOWN_STEPS:
            self._merges = Tokenizer(self._whole.model)
            self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = spec["model"]["vocab"]
            self._last = np.zeros(max(vocabulary.values()) + 1, bool)
            self._last[[i for w, i in vocabulary.items() if w.endswith(spec["model"]["end_of_word_suffix"])]] = True
        else:
            self._merges = None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process, which keeps its memo from task to task until one reads units."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __call__(self, texts: list[str]) -> list[bytes]:
        get = self._words.__getitem__
        found = [list(map(get, t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "))) for t in texts]
        if new := self._words.new:
            odd = [w for w in new if self._merges is None or _ODD(w)]
            if not odd:
                self._words.fill(self._encoded(new))
            else:
                known = dict(zip(odd, self._by_tokenizer(odd), strict=True))
                rest = iter(self._encoded([w for w in new if w not in known]))
                self._words.fill([known[w] if w in known else next(rest) for w in new])
        return [b"".join(ids) for ids in found]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Plain words, all at once; an id that no token has follows each."""
        if not words:
            return []
        after = np.array([_BETWEEN], "<u4").tobytes()
        self._parts["\n"] = after
        found = list(map(self._parts.__getitem__, _CUT("\n".join(words).lower())))
        if new := self._parts.new:
            self._parts.fill(self._merged(new))
        found.append(after)
        flat = b"".join(found)
        ends = np.flatnonzero(np.frombuffer(flat, "<u4") == _BETWEEN) * 4
        return [flat[lo:hi] for lo, hi in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Each part alone through the merges: its ids end with one that ends a part."""
        spelled = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_SIGNS) for p in parts]
        asked = [" ".join(spelled[k : k + 4096]) for k in range(0, len(spelled), 4096)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self._merges.encode_batch_fast(asked, add_special_tokens=False)])
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            raise ValueError("the tokenizer's merges leave a part without an end")
        flat, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [flat[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]

    def _by_tokenizer(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 4096):
            for e in self._whole.encode_batch_fast(words[at : at + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): pieces of all documents; nth counts those of one length within the task that made them. Write the result before it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, task, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for b in C.batches_of(batches, 1 << 20):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for doc, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for name, v in (("doc_id", doc), ("piece", k), ("start", at // 4), ("length", n), ("ids_crc32", zlib.crc32(part)), ("nth", int(seen[n])), ("ids", part)):
                        out[name].append(v)
                    seen[n] += 1
            cols = {k: pa.array(out[k], pa.int32() if k == "piece" else pa.int64()) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols |= {"task": pa.array(np.full(len(out["nth"]), task, np.int32)), "nth": pa.array(out["nth"], pa.int64())}
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(out["ids"], pa.binary())} if keep_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * keep_ids
    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence in order, how many such sequences)] that hold exactly counts[length] pieces of each length."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    # sums[s]: pairs of lengths with this sum, of which there is a piece each (two of a length that pairs with itself).
    sums = np.zeros(2 * capacity + 1, np.int64)
    some = np.flatnonzero(have)
    for k, x in enumerate(some):
        sums[x + some[k + 1 :]] += 1
    sums[2 * np.flatnonzero(have > 1)] += 1

    def used(x: int, n: int) -> None:
        before = have[x]
        have[x] -= n
        if before > 1 >= have[x]:
            sums[2 * x] -= 1
        if not have[x]:
            sums[x + np.flatnonzero(have)] -= 1

    def take(lengths: tuple[int, ...]) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(have[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                used(x, n * k)
            out.append((lengths, n))
        return n > 0

    def pair(gap: int, *beside: int) -> tuple[int, int] | None:
        """The pair that fills gap with the largest longer part, both available beside others."""
        if not sums[gap]:
            return None
        low = np.arange(1, gap // 2 + 1)
        ok = (have[low] > 0) & (have[gap - low] > 0)
        for x in low[ok]:
            y = gap - int(x)
            need: dict[int, int] = {}
            for v in (int(x), y, *beside):
                need[v] = need.get(v, 0) + 1
            if all(have[v] >= k for v, k in need.items()):
                return y, int(x)
        return None

    take((capacity,)) if have[capacity] else None
    for a in range(capacity - 1, 0, -1):
        while have[a]:
            gap = capacity - a
            if have[gap] and take((a, gap) if gap != a else (a, a)):
                continue
            if gap > 1 and (p := pair(gap, a)) and take((a, *p)):
                continue
            done = False
            second = np.arange(min(gap - 1, a), 0, -1)  # triples: the largest part first
            for b in second[(have[second] > 0) & (sums[gap - second] > 0)]:
                b = int(b)
                if (p := pair(gap - b, a, b)) and take((a, b, *p)):
                    done = True
                    break
            if not done:
                break
    # Residuals, longest first, into the open bins with the smallest gap that holds them.
    gaps: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((lengths, n))

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                lengths, n = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
                each = min(gap // length, left)
                full = min(n, left // each)
                put(lengths + (length,) * each, full)
                if n > full:
                    put(lengths, n - full)
                left -= full * each
            else:
                each = min(capacity // length, left)
                full = left // each
                put((length,) * each, full)
                left -= full * each
    return out + [x for b in bins.values() for x in b]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length in turn, ranges of ranks and where they go: sorted arrays length, rank, sequence, offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of each piece."""
    spark = docs.sparkSession
    made = C.written(pieces(docs, tokenizer, capacity, end, keep_ids), C.shared_dir(spark))
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    table = slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(table["rank"].max(initial=0)) + 1  # below 2**50, so keys fit 63 bits
        keys = table["length"] * step + table["rank"]
        for b in batches:
            length, rank = (b[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * step + np.minimum(rank, step - 1), "right") - 1
            cols = {c: b[c] for c in b.schema.names if c != "rank"}
            cols |= {"sequence_id": pa.array(table["sequence"][at] + rank - table["rank"][at]), "offset": pa.array(table["offset"][at])}
            yield pa.RecordBatch.from_pydict(cols)

    extra = ["ids"] if keep_ids else []
    ranked = made.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *extra, (F.col("nth") + F.col("before")).alias("rank"))
    return C.mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long")
