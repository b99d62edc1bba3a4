"""Running sums that no single task has to carry.

A window without PARTITION BY, or one over a hot key, sends its rows to one task. Here the order column is cut into
chunks: each chunk is summed alone, the few chunk totals are summed in turn, and both are added. A task holds a chunk
with all its columns, large values too, so without keys chunks are small; with keys they are large, as most keys have few rows in any.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, KEYED_CHUNK = 1 << 12, 1 << 20
#: The chunk of rows with a null order: below all others.
NO_ORDER = -(1 << 63)


def running_sum(df: DataFrame, amount: Column, order: str, out: str, keys: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """Adds out: the sum of amount over the rows of the same keys up to this one by the integer column order (unique within keys). Null keys are a key of their own; rows with a null order come first, in any order."""
    chunk = chunk or (KEYED_CHUNK if keys else CHUNK)
    df = df.withColumns({"_c": F.coalesce(F.floor(F.col(order) / chunk), F.lit(NO_ORDER)), "_a": amount})
    totals = df.groupBy(*keys, "_c").agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    again = [F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_c"))]
    totals = totals.select(*again, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Plain equality of the chunks, which are never null: without keys the join takes the rows as the window has dealt them.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_c") == F.col(f"_k{len(keys)}"))
    both = df.withColumn("_s", F.sum("_a").over(inside)).join(totals, same)
    return both.withColumn(out, F.col("_s") + F.col("_b")).drop("_c", "_a", "_s", "_b", *(f"_k{i}" for i in range(len(keys) + 1)))


def dense_rank_by_chunks(df: DataFrame, order: str, out: str, base: int = 0, chunk: int | None = None) -> DataFrame:
    """Adds out: base + 1, base + 2 ... in the order of an integer column without ties."""
    return running_sum(df, F.lit(1).cast("long"), order, out, chunk=chunk).withColumn(out, F.col(out) + F.lit(base))
