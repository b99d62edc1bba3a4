"""Entries of a value log in binary form, for exchange: a header, the key, the value, and a CRC-32 of all three."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from tidelog import schema as S

#: Key length, value length, meta, user meta, counter, counter to compare; big-endian, padded to 32 bytes. With the checksum an entry takes S.ENTRY_OVERHEAD bytes beside key and value.
HEADER = struct.Struct(">IIBBQQ6x")


def encode(key: bytes, value: bytes, meta: int, user_meta: int, cas: int, cas_check: int = 0) -> bytes:
    body = HEADER.pack(len(key), len(value), meta, user_meta, cas, cas_check) + key + value
    return body + struct.pack(">I", zlib.crc32(body))


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int, int]]:
    """(offset, key, value, meta, user_meta, cas, cas_check) of all entries before the first that is cut off or damaged."""
    at = 0
    while at + HEADER.size <= len(data):
        k, v, meta, user_meta, cas, check = HEADER.unpack_from(data, at)
        end = at + HEADER.size + k + v
        if end + 4 > len(data) or struct.unpack_from(">I", data, end)[0] != zlib.crc32(data[at:end]):
            return
        key = at + HEADER.size
        yield at, data[key : key + k], data[key + k : end], meta, user_meta, cas, check
        at = end + 4


assert HEADER.size + 4 == S.ENTRY_OVERHEAD
