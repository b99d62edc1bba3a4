"""Column builders: everything here stays inside Catalyst."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size_of(c: Column | str) -> Column:
    """Bytes, 0 for null."""
    return F.coalesce(F.octet_length(col(c)), F.lit(0)).cast("long")


def deleted(meta: Column | str = "meta") -> Column:
    return col(meta).bitwiseAND(S.DELETE) != 0


def live(meta: Column | str = "meta") -> Column:
    return ~deleted(meta)


def exists(meta: Column | str = "meta", value: Column | str = "value") -> Column:
    """Live, and not an empty plain value."""
    return live(meta) & ~((col(meta) == 0) & (size_of(value) == 0))


def user_key(key: Column | str = "key") -> Column:
    """False for keys under the reserved prefix."""
    return F.substring(col(key).cast("string"), 1, len(S.RESERVED)) != S.RESERVED


def successor(prefix: bytes) -> bytes | None:
    """Smallest byte string above all that start with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column | str, prefix: bytes | str) -> Column:
    """A predicate that reaches the Parquet scan: startswith for strings, a range for bytes."""
    if isinstance(prefix, str):
        return col(key).startswith(prefix)
    end = successor(prefix)
    low = col(key) >= F.lit(prefix)
    return low if end is None else low & (col(key) < F.lit(end))


def placement(value: Column | str = "value", threshold: int = S.VALUE_THRESHOLD) -> Column:
    """'inline' below the threshold, else 'log'."""
    return F.when(size_of(value) < threshold, F.lit("inline")).otherwise(F.lit("log"))


def write_size(key: Column | str = "key", value: Column | str = "value", threshold: int = S.VALUE_THRESHOLD) -> Column:
    """Estimated bytes that a write adds to a run."""
    return F.when(size_of(value) < threshold, size_of(key) + size_of(value)).otherwise(size_of(key) + S.ROW_HEADER)


def item_size(key: Column | str = "key", value: Column | str = "value", meta: Column | str = "meta", threshold: int = S.VALUE_THRESHOLD) -> Column:
    """Estimated bytes of an item: 0 if dead, the log entry's length if the value is in the log."""
    inline = size_of(value) < threshold
    return F.when(deleted(meta), F.lit(0).cast("long")).when(inline, size_of(key) + size_of(value)).otherwise(entry_size(key, value))


def entry_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of a log entry."""
    return size_of(key) + size_of(value) + S.ENTRY_OVERHEAD


def validation(key: Column | str = "key", value: Column | str = "value", max_value: int = S.MAX_VALUE, max_key: int = S.MAX_KEY) -> Column:
    return F.when(size_of(key) > max_key, F.lit(S.KEY_TOO_BIG)).when(size_of(value) > max_value, F.lit(S.VALUE_TOO_BIG)).otherwise(F.lit(S.OK))


def overlaps(left_a: Column, right_a: Column, left_b: Column, right_b: Column, inf: Column | None = None) -> Column:
    """Closed intervals share a point, or one of them is unbounded."""
    both = (left_a <= right_b) & (left_b <= right_a)
    return both if inf is None else inf | both


def _zeros_after() -> list[int]:
    """What a CRC-32 is multiplied by, modulo its polynomial (bits reversed), when 1, 2, 4 ... 2**39 zero bytes follow."""
    out = [1 << 23]
    for _ in range(39):
        a, square = out[-1], 0
        for i in range(32):
            square, a = square ^ (a if out[-1] >> (31 - i) & 1 else 0), a >> 1 ^ (CRC_POLY if a & 1 else 0)
        out.append(square)
    return out


CRC_POLY = 0xEDB88320
ZEROS_AFTER = _zeros_after()


def crc32_join(a: Column, b: Column, b_bytes: Column) -> Column:
    """CRC-32 of two byte strings in a row, from that of each and the length of the second."""

    def times(crc: Column, factor: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            taken = F.when(F.getbit(factor, 31 - i) == 1, s["a"].bitwiseXOR(s["p"])).otherwise(s["p"])
            half = F.shiftright(s["a"], 1)
            return F.struct(taken.alias("p"), F.when(s["a"].bitwiseAND(1) == 1, half.bitwiseXOR(F.lit(CRC_POLY))).otherwise(half).alias("a"))

        start = F.struct(F.lit(0).cast("long").alias("p"), crc.alias("a"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, step, lambda s: s["p"])

    powers = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bytes"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(ZEROS_AFTER)))
    needed = F.filter(powers, lambda x: x["bytes"].bitwiseAND(b_bytes) != 0)
    return F.aggregate(needed, a.cast("long"), lambda crc, x: times(crc, x["m"])).bitwiseXOR(b)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings or byte strings, by bisection: keys have at most 2**20 bytes."""
    low, high = F.lit(0), F.least(F.length(a), F.length(b))

    def halve(s: Column, _: Column) -> Column:
        middle = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(middle - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(high + 2)).cast("int"))
    return F.aggregate(steps, F.struct(low.alias("lo"), high.cast("int").alias("hi")), lambda s, i: F.when(s["lo"] < s["hi"], halve(s, i)).otherwise(s), lambda s: s["lo"])


def same_range(left_a: Column, right_a: Column, left_b: Column, right_b: Column, inf_a: Column | None = None, inf_b: Column | None = None) -> Column:
    """Two ranges have the same ends, nulls included, and are bounded alike."""
    same = left_a.eqNullSafe(left_b) & right_a.eqNullSafe(right_b)
    return same if inf_a is None else same & inf_a.eqNullSafe(inf_b)


def display(c: Column | str, otherwise: str = "<not UTF-8>") -> Column:
    """A byte string as text; a fixed text where it isn't UTF-8."""
    b = col(c).cast("binary")
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).when(b.isNotNull(), F.lit(otherwise))
