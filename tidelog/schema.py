"""Record schemas, flag bits, statuses and limits."""

from pyspark.sql import types as T

# Flag bits of the meta column.
DELETE, POINTER, UNUSED, SET_IF_ABSENT = 1, 2, 4, 8

# Per-operation statuses.
OK, NOT_FOUND, CAS_MISMATCH, KEY_EXISTS = "OK", "NOT_FOUND", "CAS_MISMATCH", "KEY_EXISTS"
KEY_TOO_BIG, VALUE_TOO_BIG, INVALID = "KEY_TOO_BIG", "VALUE_TOO_BIG", "INVALID_REQUEST"

# Fixed limits and planner constants.
MAX_KEY, MAX_VALUE = 1 << 20, 1 << 30
VALUE_THRESHOLD = 20
MAX_USER_META = 255
LOG_FILE, TABLE_SIZE = 1 << 30, 64 << 20
LEVELS, LEVEL_ONE, LEVEL_FACTOR, L0_TABLES = 7, 256 << 20, 10, 5
ROW_HEADER, ENTRY_OVERHEAD = 10, 36
MANIFEST_DELETES, MANIFEST_RATIO = 10_000, 10
GC_MIN_BYTES = 10 << 20
RESERVED = "~tidelog/"

#: One version of a key; OPS adds what a conditional write asks for.
ROW = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("cas", T.LongType(), False),
        T.StructField("meta", T.IntegerType(), False),
        T.StructField("user_meta", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: A version as tables keep it: large values stand in the value log, at (fid, offset).
STORED = T.StructType([*ROW.fields, *(T.StructField(c, T.LongType(), True) for c in ("fid", "offset", "len"))])
#: An entry of the value log.
ENTRY = T.StructType([T.StructField(c, T.LongType()) for c in ("fid", "offset", "len")] + [*ROW.fields])
OPS = T.StructType([*ROW.fields, T.StructField("cas_check", T.LongType(), False)])
CHANGE = T.StructType(
    [T.StructField("change_set", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("op", T.StringType()), T.StructField("level", T.IntegerType())]
)


class StoreError(Exception):
    """A call failed as a whole."""


class Locked(StoreError):
    """Another handle holds the store."""


class Rejected(StoreError):
    """A maintenance job of this kind already runs."""


class NoRewrite(StoreError):
    """Garbage collection found nothing worth rewriting."""


class InvalidRequest(StoreError):
    """An argument is out of range."""


class BadManifest(StoreError):
    """A manifest holds an impossible change or the wrong format."""


class MissingFiles(StoreError):
    """The manifest names files that are not there."""
