"""Exact removal of repeated passages by fixed-block anchors.

A window is WINDOW consecutive words of one document; every window whose word sequence also starts earlier goes, by document id
and then by place. The words of a document are cut into blocks of WINDOW / 2: each occurrence of a repeated window holds a whole
block of its own document. So:

1. Blocks are indexed and probed with every rolling window of a block's length over all documents; what is hit twice is an anchor.
2. Hits extend to all windows that hold an anchor. Their 96-bit fingerprints meet again, a unit sending each only once with its
   first place; the unit with the earliest place owns the sequence, and the others are told so, a bit for each.
3. Marked windows are merged to maximal runs and cut from the text.

Documents that repeat a whole earlier one word by word are settled by their fingerprint alone and take no part in step 2.
Between units travel 4 bytes a rolling window, then 20 a candidate; a sequence that stands in a third of all documents costs
one entry a unit. Anything that hash collisions of 32 bits let through in step 1 is only a candidate.

Defined cases: null or empty texts have no words and lose none; null ids sort before all others; of rows with one id the one that
was packed earlier counts as earlier; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common as C

WINDOW = 20


def _sequences(unit: C.Unit, words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, at, first): fingerprints of documents of at least a window's words, their places, and the place of the first document of the unit with the same words."""
    at = np.flatnonzero(np.diff(bounds) >= window)
    a, b = (C.doc_hashes(words, bounds, s)[at] for s in (1, 2))
    order = np.lexsort((at, b, a))
    new = np.ones(len(at), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.empty(len(at), np.int64)
    first[order] = at[order][new][np.cumsum(new) - 1] if len(at) else at
    return a, b, at, first


def _copies(units: DataFrame, window: int) -> DataFrame:
    """(unit, copies): per unit the places of documents that are word by word one of an earlier unit. A unit sends each sequence once, so one that stands in a third of all documents is a row a unit; copies within a unit it finds itself."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, _ in C.units_in(batches):
            w, _, _, bounds = u.words(False)
            a, b, at, first = _sequences(u, w, bounds, window)
            own = at == first
            yield pa.RecordBatch.from_pydict({"a": a[own].view(np.int64), "b": b[own].view(np.int64), "doc_id": u.ids[at[own]], "unit": np.full(own.sum(), u.id, np.int64), "at": at[own].astype(np.int32)})

    d = C.mapped(units, digests, "a long, b long, doc_id long, unit long, at int")
    first = d.groupBy("a", "b").agg(F.min(F.struct("doc_id", "unit", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = d.join(first, ["a", "b"]).where(F.struct("doc_id", "unit", "at") != F.col("f"))
    return later.groupBy("unit").agg(F.collect_list("at").alias("copies"))


class _Windows:
    """A unit's words, blocks and windows; every stage computes them anew from the text, always alike."""

    def __init__(self, unit: C.Unit, window: int):
        self.unit, self.window, self.block = unit, window, window // 2
        self.hash, self.starts, self.ends, self.bounds = unit.words(False)
        self.doc = np.repeat(np.arange(len(unit.ids)), np.diff(self.bounds))

    def copies(self, told: list | None) -> np.ndarray:
        """Places of documents that are word by word an earlier one, of this unit or (those told) of another."""
        _, _, at, first = _sequences(self.unit, self.hash, self.bounds, self.window)
        return at[(at != first) | np.isin(first, told or [])]

    def inside(self, n: int) -> np.ndarray:
        """Places at which n words of one document start."""
        m = len(self.hash) - n + 1
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all rolling blocks, places of the fixed blocks, their hashes)."""
        at = self.inside(self.block)
        h = C.gram_hashes(self.hash, self.block, 1)[at] if len(at) else np.zeros(0, C.U64)
        fixed = (at - self.bounds[self.doc[at]]) % self.block == 0
        return h, at[fixed], h[fixed]

    def candidates(self, lg: int, replies: list | None, copies: np.ndarray) -> np.ndarray:
        """Places of windows that hold an anchor, outside of copied documents."""
        at, h = self.blocks()[1:]
        distinct, back = np.unique(h, return_inverse=True)
        hit = at[C.answered(distinct, lg, replies)[back]] if len(at) else at
        m = max(0, len(self.hash) - self.window + 1)
        line = np.zeros(m + 1, np.int64)
        lo = np.minimum(np.maximum(hit - self.block, self.bounds[self.doc[hit]]), m)
        hi = np.minimum(hit + 1, m)
        np.add.at(line, lo, 1)
        np.add.at(line, np.maximum(hi, lo), -1)
        ok = np.cumsum(line)[:m] > 0
        ok &= self.doc[:m] == self.doc[self.window - 1 :] if m else ok
        return np.flatnonzero(ok & ~np.isin(self.doc[:m], copies))

    def sequences(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, rest, first, group): distinct sequences of the windows in order of their key, the first window of each, and each window's number among them."""
        if not len(at):
            z = np.zeros(0, C.U64)
            return z, z.astype(np.uint32), at, at
        a, b = C.gram_hashes(self.hash, self.window, 1, at), (C.gram_hashes(self.hash, self.window, 2, at) >> C.U64(32)).astype(np.uint32)
        order = np.lexsort((at, b, a))
        a, b = a[order], b[order]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        return a[new], b[new], at[order][new], group


_SEQ = np.dtype([("a", "<u8"), ("b", "<u4")])


def _owners(table: pa.Table) -> pa.Table:
    """Bit 1: the sequence also starts in a unit that has an earlier place."""
    keys = [np.frombuffer(x, _SEQ) for x in table["keys"].to_pylist()]
    docs = [np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()]
    units = table["unit"].to_numpy()
    sizes = np.array([len(k) for k in keys])
    k, d, u = np.concatenate(keys), np.concatenate(docs), np.repeat(units, sizes)
    order = np.lexsort((u, d, k["b"], k["a"]))
    s = k[order]
    later = np.zeros(len(s), bool)
    later[1:] = (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])
    bit = np.zeros(len(s), bool)
    bit[order] = later
    ends = np.cumsum(sizes)
    rows = [bit[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    keep = pa.array([i for i, b in enumerate(rows) if b.any()], pa.int64())
    return pa.table({"unit": table["unit"].take(keep), "part": table["part"].take(keep), "bits": pa.array([np.packbits(rows[i]).tobytes() for i in keep.to_pylist()], pa.binary())})


def dedup(docs: DataFrame, window: int = WINDOW, unit_bytes: int = C.UNIT_BYTES, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each document without its repeated windows. docs: doc_id long, text string."""
    spark = docs.sparkSession
    home = C.shared_dir(spark)
    words = C.text_bytes(docs) / 5
    lg, lg2 = C.parts_for(words), C.parts_for(words / 2)
    units = C.written(C.pack(docs, unit_bytes), f"{home}/units")

    def send_blocks(batches):
        for u, _ in C.units_in(batches):
            h, _, fixed = _Windows(u, window).blocks()
            if (rows := C.key_rows(u.id, h, np.unique(fixed), lg)) is not None:
                yield rows

    copies = _copies(units, window)
    anchors = C.per_unit(C.repeated_keys(C.mapped(units, send_blocks, C.KEYS_SCHEMA)), "anchors")
    told = C.written(anchors.join(copies, "unit", "full_outer"), f"{home}/anchors")

    def send_sequences(batches):
        for u, r in C.units_in(batches):
            w = _Windows(u, window)
            a, b, first, _ = w.sequences(w.candidates(lg, r["anchors"], w.copies(r["copies"])))
            at = C.cut(a, lg2)
            both = np.empty(len(a), _SEQ)
            both["a"], both["b"] = a, b
            doc = u.ids[w.doc[first]] if len(first) else np.zeros(0, np.int64)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                yield pa.RecordBatch.from_pydict({"part": pa.array(full.astype(np.int32)), "unit": pa.array(np.full(len(full), u.id, np.int64)), "keys": pa.array([both[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()), "docs": pa.array([doc[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())})

    sent = C.mapped(units.join(told, "unit"), send_sequences, "part int, unit long, keys binary, docs binary")
    owners = C.per_unit(sent.groupBy("part").applyInArrow(_owners, C.REPLY_SCHEMA), "owners")
    told = C.written(told.join(owners, "unit", "left"), f"{home}/owners")

    def cut_out(batches):
        for u, r in C.units_in(batches):
            w = _Windows(u, window)
            n_words = np.diff(w.bounds)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            copies = w.copies(r["copies"])
            at = w.candidates(lg, r["anchors"], copies)
            if len(at):
                a, _, first, group = w.sequences(at)
                repeat = at[(first[group] != at) | C.answered(a, lg2, r["owners"])[group]]
                np.add.at(gone, repeat, 1)
                np.add.at(gone, repeat + window, -1)
            out = np.cumsum(gone)[:-1] > 0
            out |= np.isin(w.doc, copies)
            removed = np.bincount(w.doc[out], minlength=len(n_words))
            raw, texts = u.data.tobytes(), []
            for i in range(len(n_words)):
                lo, hi = w.bounds[i], w.bounds[i + 1]
                if removed[i] == 0:
                    texts.append(b" ".join(raw[u.offsets[i] : u.offsets[i + 1]].split()))
                elif removed[i] == hi - lo:
                    texts.append(b"")
                else:
                    left = np.flatnonzero(~out[lo:hi]) + lo
                    texts.append(b" ".join([raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)]))
            cols = {"doc_id": C.ids_out(u.ids), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
            yield pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(texts, pa.binary()).cast(pa.string())} if keep_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return C.mapped(units.join(told, "unit", "left"), cut_out, schema)
