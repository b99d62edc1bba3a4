"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

An item of L words leaks into a document where some run of the document's words lies within k = floor(RATE L) word edits of it
(none below SMALL words). Words are runs of letters, digits and non-ASCII characters, A-Z as a-z.

1. Where windows start: an edit touches at most SEED_WORDS of an item's grams of so many words, so an occurrence shares at least
   L - SEED_WORDS + 1 - SEED_WORDS k of them with the item, all shifted by nearly the same amount. Grams are looked up at each
   position of a text; shifts that gather enough hits give the starts an item's window can have. This loses nothing.
2. Agreement of walks falls with the number of edits, so windows of items over LSH_WORDS words, of which the grams leave few, all
   go to step 3. Each window of a shorter item is embedded by a random walk that turns edit distance into Hamming distance (repeat or advance,
   by a random bit of step and word); SAMPLED coordinates of the walk are the bucket, and the window meets the item where they
   agree in one of as many repetitions as RECALL asks for at an agreement of AGREE a coordinate.
3. Candidates are verified by the exact edit distance of the item to any run of words around the window.

The benchmark goes to the executors in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, one pass over the documents a
block; documents stream through, nothing is shuffled.

Defined cases: null and empty texts and items match nothing; equal items match each for themselves; a document that holds an item
several times gives one row with its best place; null ids are returned as null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common as C

RATE, SMALL, SEED_WORDS = 0.2, 10, 3
SAMPLED, AGREE, RECALL = 3, 0.5, 0.995
#: Longest item that buckets decide on; in simulations at the edit limit they found all copies up to here, 0.96 to 0.99 of them at 75 and 100 words.
LSH_WORDS = 50
BLOCK_ITEMS, BLOCK_WORDS = 4096, 1 << 19
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, bounds of the documents)."""
    starts, ends, bounds = C.word_bounds(data, offsets, _SEPARATOR)
    return C.word_hashes(data, starts, ends, True), bounds


def edits_allowed(length: int) -> int:
    return int(RATE * length + 1e-9) if length >= SMALL else 0


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of region's words that is nearest to item."""
    m = len(region)
    steps = np.arange(m + 1)
    cost, start = np.zeros(m + 1, np.int64), steps.copy()
    for i, w in enumerate(item, 1):
        swap, drop = cost[:-1] + (region != w), cost + 1
        new = drop.copy()
        from_ = start.copy()
        better = swap < new[1:]
        new[1:][better], from_[1:][better] = swap[better], start[:-1][better]
        # Insertions run along the row: the least of cost - place up to here, plus place.
        slope = new - steps
        low = np.minimum.accumulate(slope)
        at = np.maximum.accumulate(np.where(slope == low, steps, 0))
        cost, start = low + steps, from_[at]
        cost[0], start[0] = i, 0
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def _sample(length: int) -> np.ndarray:
    """Sampled steps of each repetition, of walks of 2 L steps; a fixed rule."""
    r = C.mix(np.arange(REPEATS * SAMPLED, dtype=C.U64) + C.U64(977))
    return ((r >> C.U64(11)) % C.U64(max(1, 2 * length))).astype(np.int64).reshape(REPEATS, SAMPLED)


def buckets(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CGK walks over windows of lengths words that start at starts (those at ends and beyond are padding), bit-sampled: a bucket for each window and repetition. All walks advance together."""
    kinds, kind = np.unique(lengths, return_inverse=True)
    sampled = np.stack([_sample(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, REPEATS, SAMPLED), np.int64)
    out = np.zeros((len(starts), REPEATS), C.U64)
    at = np.broadcast_to(starts[:, None], out.shape).copy()
    end = np.minimum(starts + lengths, ends)[:, None]
    seed = (np.arange(REPEATS, dtype=C.U64) << C.U64(20))[None, :]
    pad = np.concatenate((words, np.zeros(1, C.U64)))
    with np.errstate(over="ignore"):
        for step in range(int(sampled.max(initial=-1)) + 1):
            w = np.where(at < end, pad[np.minimum(at, len(words))], C.U64(0))
            for k in range(SAMPLED):
                now = sampled[:, :, k] == step
                if now.any():
                    here = now[kind]
                    out[here] = C.mix(out[here] * C.U64(0x9E3779B97F4A7C15) + w[here])
            at += (C.mix(w + seed + C.U64(step)) >> C.U64(63)).astype(np.int64)
    return out


class Items:
    """A block of benchmark items, ready for lookups."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        data = [(t or "").encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
        w, bounds = words_of(np.frombuffer(b"".join(data), np.uint8), offsets)
        self.ids = [i for i, n in zip(ids, np.diff(bounds), strict=True) if n]
        self.words = [w[bounds[k] : bounds[k + 1]] for k in range(len(ids)) if bounds[k + 1] > bounds[k]]
        self.edits = [edits_allowed(len(x)) for x in self.words]
        sizes = np.array([len(x) for x in self.words], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        whole = np.concatenate(self.words) if self.words else np.zeros(0, C.U64)
        self.sizes, self.most = sizes, np.array(self.edits, np.int64)
        self.hashed = sizes <= LSH_WORDS
        self.buckets = np.zeros((len(sizes), REPEATS), C.U64)
        self.buckets[self.hashed] = buckets(whole, bounds[:-1][self.hashed], bounds[1:][self.hashed], sizes[self.hashed])
        grams = np.minimum(SEED_WORDS, sizes)
        self.needed = np.maximum(1, sizes - grams + 1 - grams * self.most)
        self.seeds = {}
        for q in np.unique(grams).tolist():
            rows = [(h, k, at) for k in np.flatnonzero(grams == q).tolist() for at, h in enumerate(C.gram_hashes(self.words[k], q).tolist())]
            rows.sort()
            keys = np.array([r[0] for r in rows], C.U64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys >> C.U64(44)).astype(np.int64)] = True
            self.seeds[q] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), maybe)

    def shifts(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, shift) wherever enough of an item's grams stand at this shift or up to twice its edits beyond; shifts are places of the item's first word, perhaps before the document."""
        found = []
        for q, (keys, item, inside, maybe) in self.seeds.items():
            h = C.gram_hashes(words, q)
            some = np.flatnonzero(maybe[(h >> C.U64(44)).astype(np.int64)])
            some = some[doc[some] == doc[some + q - 1]]
            lo, hi = np.searchsorted(keys, h[some]), np.searchsorted(keys, h[some], "right")
            n = hi - lo
            row = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            place = np.repeat(some, n)
            found.append((doc[place], item[row], place - inside[row]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        d, k, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((s, k, d))
        d, k, s = d[order], k[order], s[order]
        span = len(words) + int(self.sizes.max()) * 4 + 4
        key = (d * len(self.sizes) + k) * span + s + int(self.sizes.max())
        enough = np.searchsorted(key, key + 2 * self.most[k], "right") - np.arange(len(key)) >= self.needed[k]
        return d[enough], k[enough], s[enough]

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, words) of each leak, starts from the document's first word."""
        if not self.words or not len(words):
            return
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        d, k, s = self.shifts(words, doc)
        if not len(d):
            return
        e = self.most[k]
        n = 2 * e + 1
        start = np.repeat(s - e, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d, k = np.repeat(d, n), np.repeat(k, n)
        start = np.clip(start, bounds[d], np.maximum(bounds[d], bounds[d + 1] - 1))
        windows = np.unique(np.stack((d, k, start), 1), axis=0)
        d, k, start = windows.T
        near = ~self.hashed[k]
        short = np.flatnonzero(~near)
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            near[part] = (buckets(words, start[part], bounds[d[part] + 1], self.sizes[k[part]]) == self.buckets[k[part]]).any(axis=1)
        pair, best, covered = None, None, -1
        for x, y, z in zip(d[near].tolist(), k[near].tolist(), start[near].tolist(), strict=True):
            if (x, y) != pair:
                if best:
                    yield *pair, *best
                pair, best, covered = (x, y), None, -1
            if z <= covered:  # the last region verified holds this window's runs
                continue
            e, size = int(self.most[y]), int(self.sizes[y])
            lo, hi = max(int(bounds[x]), z - 2 * e), min(int(bounds[x + 1]), z + size + 4 * e)
            cost, a, b = edit_distance(self.words[y], words[lo:hi])
            covered = z + e
            if cost <= e and (best is None or cost < best[0]):
                best = (cost, lo + a - int(bounds[x]), b - a)
        if best:
            yield *pair, *best


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of a bounded size, read by the driver one after another."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") // 4
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


SCHEMA = "doc_id long, item_id long, edits int, start_word long, n_words long"


def _matched(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in C.batches_of(batches, 2 << 20):
            ids = C.column_ids(b.column(0))
            words, bounds = words_of(*C.column_bytes(b.column(1)))
            rows = list(block.matches(words, bounds))
            if rows:
                d, k, e, s, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": C.ids_out(ids[list(d)]), "item_id": pa.array([block.ids[x] for x in k], pa.int64()), "edits": pa.array(e, pa.int32()), "start_word": pa.array(s, pa.int64()), "n_words": pa.array(n, pa.int64())})

    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start_word, n_words): a row for each document and each item that leaks into it."""
    found = [_matched(docs, block) for block in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows into which no item leaks, whatever their ids."""
    home = C.shared_dir(docs.sparkSession)
    rows = C.with_row_keys(docs, f"{home}/rows")
    hit = leaks(rows.select(F.col(C.ROW).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(C.ROW)).distinct()
    return rows.join(C.written(hit, f"{home}/hit"), C.ROW, "left_anti").select(*docs.columns)
