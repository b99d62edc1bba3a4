"""WARC archives: written as monolithic gzip streams, then normalised so that each record is a gzip member of its own.

write() packs records into archive files of a bounded size, each one gzip stream over the whole file. normalise() inflates such a
stream once, from front to back, rewrites each record as its own member, and writes a sidecar index of offsets; read() uses the
index to open single members. Files live under spark.checkpoint.dir (or another shared folder) and get names of their own for each
attempt; a manifest table names those that count, so a lost executor leaves at most files that nobody reads.

Payloads of MIN_BYTES or more that are equal are stored once: the record with the largest page_id is the response, the others
revisit it. Which that is comes from a map-side combined aggregate joined by digest; Spark splits the partition of a digest that
holds a third of all pages.

Defined cases: null html is an empty payload; null page ids are written and read back as null, never own a payload that a page with
an id shares, and refer to nothing when all of a group are null; of equal payloads with the same largest id each is a response.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common as C

MIN_BYTES, ARCHIVE_BYTES, LEVEL = 1000, 8 << 20, 3
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


class Folder:
    """Reads and writes whole files of a shared folder, by path or by URI. Hadoop's names of stores become those of Arrow's file systems: s3a and s3n are s3, dbfs:/ is its mount at /dbfs."""

    def __init__(self, root: str):
        root = re.sub(r"^dbfs:/+", "/dbfs/", re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:(?://)?", "", root)))
        if "://" in root:
            from pyarrow import fs

            self._fs, self.root = fs.FileSystem.from_uri(root)
        else:
            self._fs, self.root = None, root
            os.makedirs(root, exist_ok=True)

    def write(self, name: str, data: bytes) -> None:
        if self._fs:
            self._fs.create_dir(self.root, recursive=True)
            with self._fs.open_output_stream(f"{self.root}/{name}") as f:
                f.write(data)
            return
        with open(f"{self.root}/.{name}", "wb") as f:
            f.write(data)
        os.replace(f"{self.root}/.{name}", f"{self.root}/{name}")

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        if self._fs:
            with self._fs.open_input_file(f"{self.root}/{name}") as f:
                f.seek(at)
                return f.read(size) if size is not None else f.read()
        with open(f"{self.root}/{name}", "rb") as f:
            f.seek(at)
            return f.read() if size is None else f.read(size)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    block = _HTTP if revisit else _HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{owner}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return head + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """(headers, record start, block start, record end) of records that lie behind one another."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in data[at : body - 4].decode().split("\r\n")[1:])
        end = body + int(head["Content-Length"]) + 4
        if data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, at, body, end
        at = end


def _page(urn: str) -> int | None:
    v = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if v in ("null", "None") else int(v)


def inflate(data: bytes) -> bytes:
    """The content of a gzip file, whether one member or many."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out += [z.decompress(data), z.flush()]
        data = z.unused_data
    return b"".join(out)


def resolved(pages: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, owner, revisit)."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "big": F.octet_length("payload") >= least})
    shared = p.where("big").groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = p.join(shared, "digest", "left")
    return j.select("page_id", "url", "payload", "digest", "owner", F.coalesce(F.col("big") & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.lit(False)).alias("revisit"))


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes resolved rows as monolithic archives; returns their manifest (name, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Folder(folder)

        def save(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            data = gzip.compress(b"".join(records), LEVEL, mtime=0)
            to.write(name, data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)], "bytes": [len(data)]})

        held, size = [], 0
        for b in C.batches_of(batches, archive_bytes):
            for r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "owner", "revisit")), strict=True):
                held.append(record(*r))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield save(held)
                    held, size = [], 0
        if held:
            yield save(held)

    return C.mapped(rows, run, "name string, records long, bytes long")


def normalise(manifest: DataFrame, folder: str, to_folder: str) -> DataFrame:
    """Rewrites each monolithic archive as one member a record beside a sidecar (a JSON line of offset, length, type and id for each); returns the manifest (name, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, to = Folder(folder), Folder(to_folder)
        for b in batches:
            for name in b["name"].to_pylist():
                data = inflate(src.read(name))
                members, index, at = [], [], 0
                for head, lo, _, hi in parse(data):
                    m = gzip.compress(data[lo:hi], LEVEL, mtime=0)
                    members.append(m)
                    index.append(json.dumps({"offset": at, "length": len(m), "type": head["WARC-Type"], "id": head["WARC-Record-ID"]}))
                    at += len(m)
                new = uuid.uuid4().hex
                to.write(f"{new}.warc.gz", b"".join(members))
                to.write(f"{new}.idx", "\n".join(index).encode())
                yield pa.RecordBatch.from_pydict({"name": [f"{new}.warc.gz"], "index": [f"{new}.idx"], "records": [len(index)]})

    return C.mapped(manifest, run, "name string, index string, records long")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of all records of normalised archives, each member opened by its offset. A response's length and digest are computed from its payload, a revisit's come from its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        src = Folder(folder)
        for b in batches:
            for name, index in zip(b["name"].to_pylist(), b["index"].to_pylist(), strict=True):
                archive = src.read(name)
                rows = []
                for line in src.read(index).decode().split("\n"):
                    at = json.loads(line)
                    data = gzip.decompress(archive[at["offset"] : at["offset"] + at["length"]])
                    head, _, body, end = next(parse(data))
                    if head["WARC-Type"] == "revisit":
                        n, digest, owner = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), _page(head["WARC-Refers-To"])
                    else:
                        payload = data[body + len(_HTTP) : end - 4]
                        n, digest, owner = len(payload), hashlib.sha1(payload).hexdigest(), None
                    rows.append((_page(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], owner, head["WARC-Target-URI"]))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for k, c, t in zip(names, cols, types, strict=True)})

    return C.mapped(manifest, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, normalises them, and reads them back."""
    home = folder or C.shared_dir(pages.sparkSession)
    spread = lambda m: m.repartition(max(1, m.count()), "name")  # noqa: E731  a task for a few archives; manifests are a row an archive
    raw = C.written(write(resolved(pages), f"{home}/raw"), f"{home}/raw-manifest")
    done = C.written(normalise(spread(raw), f"{home}/raw", f"{home}/warc"), f"{home}/warc-manifest")
    return read(spread(done), f"{home}/warc")
