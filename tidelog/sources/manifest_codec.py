"""Change sets in protobuf wire form, each framed by its length and checksum: for exchange with stores that keep them so."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from tidelog import schema as S
from tidelog.sources.backup import varint, varint_at

# The magic and version that open a manifest, operations, and the tags of a change (id 1, op 2, level 3).
MAGIC, VERSION = b"TLMF", 1
OPS = ("CREATE", "DELETE")


def encode_set(changes: list[tuple[int, str, int]]) -> bytes:
    """(id, op, level) rows as one message: field 1, repeated, a change each; fields that are 0 are left out."""
    out = b""
    for table, op, level in changes:
        body = b"".join(bytes([tag]) + varint(v) for tag, v in ((8, table), (16, OPS.index(op)), (24, level)) if v)
        out += b"\x0a" + varint(len(body)) + body
    return out


def decode_set(data: bytes) -> list[tuple[int, str, int]]:
    out, at = [], 0
    while at < len(data):
        if data[at] != 10:
            raise S.BadManifest(f"unknown field {data[at] >> 3}")
        n, at = varint_at(data, at + 1)
        end, found = at + n, {1: 0, 2: 0, 3: 0}
        while at < end:
            tag = data[at] >> 3
            found[tag], at = varint_at(data, at + 1)
        out.append((found[1], OPS[found[2]], found[3]))
    return out


def write(sets: list[list[tuple[int, str, int]]]) -> bytes:
    """Magic, version, then for each set its length, its CRC-32 (both big-endian) and its message."""
    bodies = [encode_set(s) for s in sets]
    return MAGIC + struct.pack(">I", VERSION) + b"".join(struct.pack(">II", len(b), zlib.crc32(b)) + b for b in bodies)


def read(data: bytes) -> Iterator[tuple[int, list[tuple[int, str, int]]]]:
    """(offset after the set, set) of all sets before the first that is cut off or whose checksum is wrong."""
    if data[:4] != MAGIC or data[4:8] != struct.pack(">I", VERSION):
        raise S.BadManifest("not a manifest, or of another version")
    at = 8
    while at + 8 <= len(data):
        n, crc = struct.unpack_from(">II", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(body) != crc:
            return
        at += 8 + n
        yield at, decode_set(body)
