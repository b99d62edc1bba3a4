"""Backup streams: a length-framed binary form of the live rows, and a reader for it (an extension)."""

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S


def export(view: DataFrame) -> DataFrame:
    """What a backup holds: live rows in key order, without counters."""
    return view.select("key", "value", "user_meta").orderBy("key")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def frame(key: bytes, value: bytes, user_meta: int) -> bytes:
    """u64 little-endian length, then fields 1 key, 2 value and 3 user meta (a byte) in protobuf wire form."""
    if not 0 <= user_meta <= S.MAX_USER_META:
        raise S.InvalidRequest("a user meta is a byte")
    body = b"".join(bytes([tag]) + varint(len(part)) + part for tag, part in ((10, key), (18, value), (26, bytes([user_meta]))) if part)
    return struct.pack("<Q", len(body)) + body


def varint_at(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it)."""
    n = shift = 0
    while True:
        b, at = data[at], at + 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _fields(body: bytes) -> dict[int, bytes]:
    at, found = 0, {}
    while at < len(body):
        n, start = varint_at(body, at + 1)
        found[body[at] >> 3], at = body[start : start + n], start + n
    return found


def unframe(data: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        f = _fields(data[at + 8 : at + 8 + n])
        at += 8 + n
        yield f.get(1, b""), f.get(2, b""), f.get(3, b"\0")[0]


def write_framed(view: DataFrame, path: str) -> None:
    """Range-partitioned frames as a table of chunks (part, chunk, bytes): concatenated in order, they are the stream."""

    def pack(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for chunk, pdf in enumerate(batches):
            data = b"".join(frame(bytes(k), bytes(v or b""), int(m)) for k, v, m in zip(pdf["key"], pdf["value"], pdf["user_meta"], strict=True))
            yield pd.DataFrame({"part": [part], "chunk": [chunk], "bytes": [data]})

    rows = view.select(F.col("key").cast("binary"), F.col("value").cast("binary"), "user_meta").repartitionByRange("key").sortWithinPartitions("key")
    rows.mapInPandas(pack, "part int, chunk int, bytes binary").write.mode("overwrite").parquet(path)


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["bytes"]:
                yield pd.DataFrame(list(unframe(bytes(data))), columns=["key", "value", "user_meta"])

    return spark.read.parquet(path).mapInPandas(unpack, "key binary, value binary, user_meta int")
