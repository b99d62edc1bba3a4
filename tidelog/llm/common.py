"""What the operators share: the folder for intermediate tables, vectorised words and window hashes, and units.

A unit is a few megabytes of whole documents that travel as one row. Writing units once makes the grouping of documents
stable, so a later stage can answer a unit with a bit for each key the unit has sent, in the order in which it sent them.
A key that stands in a third of all documents then costs one entry a unit, not one a document.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Documents of one unit: bytes of text, and their number.
UNIT_BYTES, UNIT_DOCS = 4 << 20, 1 << 15
#: Bytes of one Arrow batch between Spark and a worker.
BATCH_BYTES = 2 << 20
#: Bytes of text that a bucket of units holds on average, and the most buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, 1 << 15
#: Keys that one part of a key exchange holds in memory.
PART_KEYS = 1 << 21
#: Stands for a null id inside units; sorts first, is returned as null.
NULL_ID = -(1 << 63)
#: Large objects that a worker process keeps for later tasks of one operator. Tasks that read units need the room and empty it.
KEPT: dict[str, object] = {}

U64 = np.uint64
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- folders
def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only where that is unset and Spark is local, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Writes a table and reads it again: cuts the lineage, and later stages see the same rows whatever is lost."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not by else df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, path: str, by: str, buckets: int) -> DataFrame:
    """As written, in buckets of a column: a join on it shuffles the other side only. The table stands in the session's catalog until unlisted() is called with its path."""
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(_listed(path))
    return df.sparkSession.table(_listed(path))


def _listed(path: str) -> str:
    return re.sub(r"\W", "_", "_".join(path.rsplit("/", 2)[1:]))


def unlisted(spark: SparkSession, path: str) -> None:
    """Takes a table that bucketed() wrote out of the catalog and deletes it."""
    spark.sql(f"DROP TABLE IF EXISTS {_listed(path)}")
    dropped(spark, path)


#: Column of row keys.
ROW = "_tidelog_row"


def with_row_keys(docs: DataFrame, path: str) -> DataFrame:
    """The rows with a key of their own in ROW, written, so each keeps it: ids may be null or stand in several rows."""
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray | np.uint64) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_R1, _R2 = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTES_FOLDED = _BYTES[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(r: int, n: int) -> np.ndarray:
    """r**0 .. r**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(r)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), r, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[r] = np.multiply.accumulate(p)
    return have[:n]


def inverse(r: int) -> int:
    return pow(r, -1, 1 << 64)


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than those between words, ASCII white space if not said) of documents that lie behind one another, and the number of words before each document and after the last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, span: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words; fold: with A-Z as a-z. Runs over about span bytes at a time."""
    table, inv = (_BYTES_FOLDED if fold else _BYTES), inverse(_R1)
    out = np.empty(len(starts), U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + span, "right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(table[data[lo:hi]] * powers(_R1, hi - lo), out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = mix((sums[e] - sums[s]) * powers(inv, hi - lo)[s] + (e - s).astype(U64))
            at = to
    return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 1, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words that start at each position (or those of at); positions less than n before the end are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    r = _R1 if seed % 2 else _R2
    with np.errstate(over="ignore"):
        w = mix(words + U64(seed * 0x632BE59BD9B4E019 & _MASK))
        if n <= 4:
            h = np.zeros(m, U64)
            for k in range(n):
                h = h * U64(r) + w[k : k + m]
            h = h if at is None else h[at]
        else:
            sums = np.zeros(len(words) + 1, U64)
            np.cumsum(w * powers(r, len(words)), out=sums[1:])
            at = np.arange(m) if at is None else at
            h = (sums[at + n] - sums[at]) * powers(inverse(r), len(words))[at]
        return mix(h + U64(n))


def doc_hashes(words: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the whole word sequence of each document."""
    r = _R1 if seed % 2 else _R2
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(mix(words + U64(seed * 0x632BE59BD9B4E019 & _MASK)) * powers(r, len(words)), out=sums[1:])
        inv = powers(inverse(r), len(words) + 1)
        return mix((sums[bounds[1:]] - sums[bounds[:-1]]) * inv[bounds[:-1]] + np.diff(bounds).astype(U64))


# ---------------------------------------------------------------- Arrow
def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Data and int64 offsets of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def column_ids(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def trim() -> None:
    """Gives freed memory back to the system. Workers stay alive between tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES at most instead of a number of rows (a longer row is a batch), so neither the JVM nor the worker holds thousands of long texts at once."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key) != f"{BATCH_BYTES}b":
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about most bytes each, to bound what vectorised code holds."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    trim()


# ---------------------------------------------------------------- units
UNIT_SCHEMA = "unit long, ids binary, lens binary, text binary"


class Unit:
    """Documents of a unit in order of id: ids, data and offsets of their texts."""

    __slots__ = ("data", "id", "ids", "offsets")

    def __init__(self, unit: int, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.id, self.ids, self.data, self.offsets = unit, ids, data, offsets

    def only(self, at: np.ndarray) -> Unit:
        """Some of the documents, by place."""
        data = np.concatenate([self.data[self.offsets[k] : self.offsets[k + 1]] for k in at]) if len(at) else self.data[:0]
        lens = np.diff(self.offsets)[at]
        return Unit(self.id, self.ids[at], data, np.concatenate(([0], np.cumsum(lens))))

    def words(self, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends, bounds)."""
        starts, ends, bounds = word_bounds(self.data, self.offsets)
        return word_hashes(self.data, starts, ends, fold), starts, ends, bounds


def pack(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(unit, ids, lens, text): the columns doc_id and text of all rows, dealt into units as they are read, without a shuffle. Write the result before it is used: numbers come from the reading task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, seq = zstandard.ZstdCompressor(3), 0
        base = TaskContext.get().partitionId() << 20

        def row(ids: list, data: list, lens: list) -> pa.RecordBatch:
            i, n = np.concatenate(ids), np.concatenate(lens)
            offsets = np.concatenate(([0], np.cumsum(n)))
            order = np.argsort(i, kind="stable")
            if (np.diff(order) < 0).any():
                whole = b"".join(data)
                text = b"".join([whole[offsets[k] : offsets[k + 1]] for k in order])
            else:
                text = b"".join(data)
            return pa.RecordBatch.from_pydict({"unit": pa.array([base + seq], pa.int64()), "ids": pa.array([i[order].tobytes()]), "lens": pa.array([n[order].tobytes()]), "text": pa.array([squeeze.compress(text)])})

        ids, data, lens, size, count = [], [], [], 0, 0
        for b in batches_of(batches, unit_bytes):
            d, o = column_bytes(b.column(1))
            ids.append(column_ids(b.column(0)))
            data.append(d.tobytes())
            lens.append(np.diff(o))
            size, count = size + len(d), count + b.num_rows
            if size >= unit_bytes * 3 // 4 or count >= UNIT_DOCS:
                yield row(ids, data, lens)
                ids, data, lens, size, count, seq = [], [], [], 0, 0, seq + 1
        if ids:
            yield row(ids, data, lens)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, UNIT_SCHEMA)


def units_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Unit, dict]]:
    """Units one at a time, each with the other columns of its row."""
    if KEPT:
        KEPT.clear()
        trim()
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        rest = [c for c in b.schema.names if c not in ("unit", "ids", "lens", "text")]
        for k in range(b.num_rows):
            ids = np.frombuffer(b["ids"][k].as_py(), np.int64)
            lens = np.frombuffer(b["lens"][k].as_py(), np.int64)
            data = np.frombuffer(open_.decompress(b["text"][k].as_py()), np.uint8)
            yield Unit(b["unit"][k].as_py(), ids, data, np.concatenate(([0], np.cumsum(lens)))), {c: b[c][k].as_py() for c in rest}
            del ids, lens, data
    trim()


def parts_for(keys: float, part_keys: int = PART_KEYS) -> int:
    """log2 of the number of parts for so many keys."""
    return max(3, int(np.ceil(np.log2(max(1.0, keys / part_keys)))))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def cut(sorted_hashes: np.ndarray, lg: int) -> np.ndarray:
    """Where each part begins in sorted hashes, and their end."""
    return np.searchsorted(sorted_hashes >> U64(64 - lg), np.arange((1 << lg) + 1, dtype=U64))


def short(hashes: np.ndarray, lg: int) -> np.ndarray:
    """The 32 bits after those that name the part. Growing data has more parts, so the chance that two keys look alike stays the same."""
    return ((hashes << U64(lg)) >> U64(32)).astype(np.uint32)


KEYS_SCHEMA = "part int, unit long, probes binary, twice binary, anchors binary"
REPLY_SCHEMA = "unit long, part int, bits binary"


def key_rows(unit: int, probes: np.ndarray, anchors: np.ndarray | None, lg: int) -> pa.RecordBatch | None:
    """One row for each part that gets keys of the unit. probes: all keys; anchors: sorted distinct keys that want an answer; None: all do, and are sent once."""
    probes = np.sort(probes)
    new = np.ones(len(probes), bool)
    new[1:] = probes[1:] != probes[:-1]
    twice = probes[1:][~new[1:]]
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))] if len(twice) else twice
    probes = probes[new]
    own = probes[:0] if anchors is None else anchors
    p, t, a = cut(probes, lg), cut(twice, lg), cut(own, lg)
    ps, ts, as_ = short(probes, lg), short(twice, lg), short(own, lg)
    full = np.flatnonzero(np.diff(p) + np.diff(a))
    if not len(full):
        return None
    take = lambda x, at: pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())
    return pa.RecordBatch.from_pydict({"part": pa.array(full.astype(np.int32)), "unit": pa.array(np.full(len(full), unit, np.int64)), "probes": take(ps, p), "twice": take(ts, t), "anchors": pa.nulls(len(full), pa.binary()) if anchors is None else take(as_, a)})


def _repeated(table: pa.Table) -> pa.Table:
    """Indexes the anchors of a part, probes them with all keys, and answers which occur at two places or more."""
    u32 = lambda c: [None if x is None else np.frombuffer(x, np.uint32) for x in table[c].to_pylist()]
    sent = u32("probes")
    anchors = [p if a is None else a for a, p in zip(u32("anchors"), sent, strict=True)]
    index = np.unique(np.concatenate(anchors)) if anchors else np.zeros(0, np.uint32)
    seen = np.zeros(len(index) + 1, np.int32)
    if len(index):
        for probes in (*sent, *u32("twice")):
            at = np.searchsorted(index, probes)
            at[at == len(index)] = 0
            np.add.at(seen, at[index[at] == probes], 1) if len(probes) < 64 else seen.__iadd__(np.bincount(at[index[at] == probes], minlength=len(seen)).astype(np.int32))
    often = seen[: len(index)] > 1
    bits = [often[np.searchsorted(index, a)] for a in anchors]
    keep = pa.array([k for k, b in enumerate(bits) if b.any()], pa.int64())
    del sent, anchors, index, seen
    trim()
    return pa.table({"unit": table["unit"].take(keep), "part": table["part"].take(keep), "bits": pa.array([np.packbits(bits[k]).tobytes() for k in keep.to_pylist()], pa.binary())})


def repeated_keys(rows: DataFrame) -> DataFrame:
    """Answers to rows of KEYS_SCHEMA: REPLY_SCHEMA, a bit for each anchor; parts without a hit are left out."""
    return rows.groupBy("part").applyInArrow(_repeated, REPLY_SCHEMA)


def per_unit(replies: DataFrame, name: str, field: str = "bits") -> DataFrame:
    """(unit, name): a unit's answers as one array."""
    return replies.groupBy("unit").agg(F.collect_list(F.struct("part", field)).alias(name))


def answered(anchors: np.ndarray, lg: int, replies: list[dict] | None) -> np.ndarray:
    """The bit of each of a unit's sorted anchors."""
    out = np.zeros(len(anchors), bool)
    at = cut(anchors, lg)
    for r in replies or ():
        lo, hi = at[r["part"]], at[r["part"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
    return out
