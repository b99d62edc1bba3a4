"""Size and count reductions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import expr


# The series that metrics() reports. No write waits, nothing is held in memory tables and Parquet builds its own
# Bloom filters, so pending_writes, num_blocked_puts, num_mem_tables_gets and block_hash_calc_cost stay 0; num_lsm_bloom_hits counts
# tables skipped by their key range.
SERIES = (
    "lsm_size", "vlog_size", "pending_writes", "num_reads", "num_writes", "num_bytes_read", "num_bytes_written", "num_lsm_gets", "num_lsm_bloom_hits", "num_gets", "num_puts", "num_blocked_puts",
    "num_mem_tables_gets", "block_hash_calc_cost",
)


def series(rows: DataFrame) -> DataFrame:
    """(label, value) out of one row of counters, a label a column; series it lacks are 0."""
    known = [F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) if c in rows.columns else F.struct(F.lit(c).alias("label"), F.lit(0).cast("long").alias("value")) for c in SERIES]
    return rows.select(F.explode(F.array(*known)).alias("m")).select("m.*")


def write_metrics(ops: DataFrame, status: DataFrame, threshold: int = S.VALUE_THRESHOLD) -> DataFrame:
    """The series that a batch of ops (key, cas, meta, value) with their statuses moves."""
    done = ops.join(status.select("cas", "status"), "cas").withColumn("_ok", F.col("status") == S.OK)
    logged = F.col("_ok") & expr.live() & (expr.size_of("value") >= threshold)
    return series(done.agg(
        F.count("*").alias("num_puts"), F.count_if("_ok").alias("num_writes"),
        F.sum(F.when(F.col("_ok"), expr.write_size(threshold=threshold))).alias("lsm_size"),
        F.sum(F.when(logged, expr.entry_size())).alias("vlog_size"),
        F.sum(F.when(F.col("_ok"), expr.write_size(threshold=threshold) + F.when(logged, expr.entry_size()).otherwise(0))).alias("num_bytes_written"),
    ))


def request_counts(ops: DataFrame, request: str = "request") -> DataFrame:
    """(request, entries, bytes) of each request of a group commit."""
    return ops.groupBy(request).agg(F.count("*").alias("entries"), F.sum(expr.entry_size()).alias("bytes"))


def size_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"),
        F.sum(expr.size_of("key")).alias("key_bytes"),
        F.sum(expr.size_of("value")).alias("value_bytes"),
        F.sum(expr.size_of("key") + expr.size_of("value") + S.ROW_HEADER).alias("memory_bytes"),
    )


def placement_stats(rows: DataFrame, threshold: int = S.VALUE_THRESHOLD) -> DataFrame:
    return rows.groupBy(expr.placement(threshold=threshold).alias("placement")).agg(F.count("*").alias("rows"), F.sum(expr.write_size(threshold=threshold)).alias("bytes"))


def prefix_blocks(rows: DataFrame, block: int = 100, bucket: int = 7) -> DataFrame:
    """(key, base_key, shared, suffix): keys cut into blocks of a bucket's keys, each stored as the rest after what it shares with its block's first key."""
    from pyspark.sql import Window

    w = Window.partitionBy("_b").orderBy("key")
    rows = rows.select("key", F.substring("key", 1, bucket).alias("_b"))
    rows = rows.withColumn("_n", F.floor((F.row_number().over(w) - 1) / block))
    rows = rows.withColumn("base_key", F.min("key").over(Window.partitionBy("_b", "_n")))
    shared = expr.common_prefix(F.col("base_key"), F.col("key"))
    return rows.select("key", "base_key", shared.alias("shared"), F.substring(F.col("key"), shared + 1, F.lit(1 << 20)).alias("suffix"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes by suffix; files: (path, length)."""
    return files.groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("suffix")).agg(F.sum("length").alias("bytes"))
