"""Ordered reads: get, exists, prefix, range, seek, nearest."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import expr


def get(view: DataFrame, key) -> DataFrame:
    return view.where(F.col("key") == F.lit(key))


def multi_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of view for the keys asked for, each once."""
    return view.join(keys.select("key").distinct(), "key", "left_semi")


def exists(view: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found) for each key asked for."""
    there = view.where(expr.exists()).select("key", F.lit(True).alias("_f")) if "meta" in view.columns else view.select("key", F.lit(True).alias("_f"))
    return keys.select("key").distinct().join(there, "key", "left").select("key", F.coalesce("_f", F.lit(False)).alias("found"))


def missing(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys asked for that view lacks."""
    return keys.select("key").distinct().join(view, "key", "left_anti")


def scan(view: DataFrame, start=None, end=None, prefix=None, reverse: bool = False, limit: int | None = None, keys_only: bool = False, seek=None) -> DataFrame:
    """Rows in key order. start is inclusive and end exclusive; seek is the first key in scan direction, itself included; keys_only prunes the rest from the Parquet scan."""
    k = F.col("key")
    for test in (
        None if start is None else k >= F.lit(start),
        None if end is None else k < F.lit(end),
        None if prefix is None else expr.has_prefix("key", prefix),
        None if seek is None else (k <= F.lit(seek) if reverse else k >= F.lit(seek)),
    ):
        view = view if test is None else view.where(test)
    out = (view.select("key") if keys_only else view).orderBy(k.desc() if reverse else k.asc())
    return out if limit is None else out.limit(max(0, limit))


def first_last(view: DataFrame) -> DataFrame:
    return view.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


#: Keys that one bucket of neighbours() and nearest() should hold, and how many buckets there may be (their ends go through one task).
BUCKET_ROWS, BUCKETS, WIDEST = 1 << 18, 1 << 20, 8


def bucket_of(keys: DataFrame, key: str = "key") -> tuple[int, int]:
    """(characters that all keys share at their start, characters after those that name a bucket), from two aggregates over the keys: the fewest that leave buckets of BUCKET_ROWS keys on average."""
    lo, hi, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or lo == hi:
        return 0, 1
    head = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
    parts = keys.agg(*(F.approx_count_distinct(F.substring(key, head + 1, w)) for w in range(1, WIDEST + 1))).first()
    width = next((w for w, d in enumerate(parts, 1) if n <= BUCKET_ROWS * d), WIDEST)
    while width > 1 and parts[width - 1] > BUCKETS:
        width -= 1
    return head, width


def _bucket(column: str, view: DataFrame, bucket: int | None):
    """The start of a key that names its bucket, in key order. bucket: its length; worked out from the keys if not said."""
    if bucket is not None:
        return F.substring(column, 1, bucket)
    head, width = bucket_of(view)
    return F.substring(column, 1, head + width)


def neighbours(view: DataFrame, bucket: int | None = None) -> DataFrame:
    """(key, prev_key, next_key). Windows run inside buckets of one key prefix; the ends of neighbouring buckets are joined in, so no task sorts the whole key space."""
    rows = view.select("key", _bucket("key", view, bucket).alias("_b"))
    ends = rows.groupBy("_b").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    w = Window.orderBy("_b")
    ends = ends.select("_b", F.lag("_hi").over(w).alias("_before"), F.lead("_lo").over(w).alias("_after"))
    i = Window.partitionBy("_b").orderBy("key")
    rows = rows.select("_b", "key", F.lag("key").over(i).alias("_p"), F.lead("key").over(i).alias("_n"))
    return rows.join(ends, "_b").select("key", F.coalesce("_p", "_before").alias("prev_key"), F.coalesce("_n", "_after").alias("next_key"))


def nearest(view: DataFrame, probes: DataFrame, at_most: bool = True, strict: bool = False, bucket: int | None = None) -> DataFrame:
    """(probe, key): for each probe the largest key <= it (at_most) or the smallest key >= it; strict leaves out equality; null if there is none.

    Keys and probes meet in buckets of one key prefix; what lies beyond a bucket comes from the ends of the next non-empty one.
    """
    # 0 sorts before 1: whether a probe stands before or after an equal key decides if it sees it.
    probe_first = strict if at_most else not strict
    p = probes.select(F.col("probe").alias("_k"), F.lit(0 if probe_first else 1).alias("_o"), F.lit(None).cast("string").alias("_key"), F.lit(True).alias("_is")).distinct()
    k = view.select(F.col("key").alias("_k"), F.lit(1 if probe_first else 0).alias("_o"), F.col("key").alias("_key"), F.lit(False).alias("_is"))
    both = p.unionByName(k).withColumn("_b", _bucket("_k", view, bucket))
    order = [F.col("_k"), F.col("_o")] if at_most else [F.col("_k").desc(), F.col("_o").desc()]
    w = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_near", F.last("_key", ignorenulls=True).over(w)).where("_is")
    ends = both.groupBy("_b").agg((F.max if at_most else F.min)("_key").alias("_e"))
    e = Window.orderBy(F.col("_b").asc() if at_most else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_b", F.last("_e", ignorenulls=True).over(e).alias("_beyond"))
    return inside.join(ends, "_b").select(F.col("_k").alias("probe"), F.coalesce("_near", "_beyond").alias("key"))
