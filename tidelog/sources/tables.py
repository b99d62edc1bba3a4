"""Derived key-value inputs over the sample tables; the SQL twins stand beside each."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str, compares: Column | None = None) -> DataFrame:
    """Operations out of events: errors delete, sign-ups insert if absent, even-numbered clicks compare (or the events said)."""
    e = table(spark, sf_dir, "events")
    before = F.lag(F.col("event_id") + 1).over(Window.partitionBy("user_id").orderBy("event_id"))
    compares = (F.col("event_type") == "click") & (F.col("event_id") % 2 == 0) if compares is None else compares
    return e.select(
        F.format_string("u%06d", "user_id").alias("key"),
        (F.col("event_id") + 1).alias("cas"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 8).otherwise(0).alias("meta"),
        (F.col("event_id") % 256).cast("int").alias("user_meta"),
        F.coalesce(F.when(compares, before), F.lit(0)).cast("long").alias("cas_check"),
        F.col("props").alias("value"),
    )


OPLOG = """oplog AS (SELECT printf('u%06d', user_id) AS key, event_id + 1 AS cas,
  CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 8 ELSE 0 END AS meta, CAST(event_id % 256 AS INTEGER) AS user_meta,
  coalesce(CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN lag(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id) END, 0) AS cas_check,
  props AS value FROM events)"""


def plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log without its lag column: no window in the way of a plain read."""
    return table(spark, sf_dir, "events").select(
        F.format_string("u%06d", "user_id").alias("key"),
        (F.col("event_id") + 1).alias("cas"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 8).otherwise(0).alias("meta"),
        (F.col("event_id") % 256).cast("int").alias("user_meta"),
        F.col("props").alias("value"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven ranked runs out of lineitem, a value for each key of each run."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("rank"), F.format_string("o%09d", "l_orderkey").alias("key")).agg(F.max("l_partkey").alias("value"))


RUNS = "runs AS (SELECT l_linenumber AS rank, printf('o%09d', l_orderkey) AS key, max(l_partkey) AS value FROM lineitem GROUP BY ALL)"


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.format_string("o%09d", "o_orderkey").alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value"))


KV = "kv AS (SELECT printf('o%09d', o_orderkey) AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders)"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("d%09d", "doc_id").alias("key"), (F.col("doc_id") + 1).alias("cas"), F.lit(0).alias("meta"), F.lit(0).alias("user_meta"), F.col("text").alias("value"))


BLOBS = "blobs AS (SELECT printf('d%09d', doc_id) AS key, doc_id + 1 AS cas, text AS value, strlen(printf('d%09d', doc_id)) + coalesce(strlen(text), 0) + 36 AS len FROM documents)"


def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order creates a table; finished ones delete it again."""
    o = table(spark, sf_dir, "orders")
    level = (F.col("o_orderkey") % 7).cast("int").alias("level")
    made = o.select(F.lit(0).cast("long").alias("change_set"), F.lit(0).alias("seq"), F.col("o_orderkey").alias("id"), F.lit("CREATE").alias("op"), level)
    gone = o.where("o_orderstatus = 'F'").select(F.lit(1).cast("long").alias("change_set"), F.lit(0).alias("seq"), F.col("o_orderkey").alias("id"), F.lit("DELETE").alias("op"), level)
    return made.unionByName(gone)


MANIFEST = """log AS (SELECT 0 AS change_set, o_orderkey AS id, 'CREATE' AS op, CAST(o_orderkey % 7 AS INTEGER) AS level FROM orders
  UNION ALL SELECT 1, o_orderkey, 'DELETE', CAST(o_orderkey % 7 AS INTEGER) FROM orders WHERE o_orderstatus = 'F')"""


def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table statistics: customers as tables of ten orders' keys, dealt over three levels."""
    c = table(spark, sf_dir, "customer")
    at = F.col("c_custkey")
    return c.select(
        at.alias("id"), (at % 3).cast("int").alias("level"), F.format_string("o%09d", at * 10).alias("smallest"),
        F.format_string("o%09d", at * 10 + F.when(at % 7 == 0, 35).otherwise(9)).alias("biggest"), (at % 97 + 1).alias("size"),
    )


TABLES = """tables AS (SELECT c_custkey AS id, CAST(c_custkey % 3 AS INTEGER) AS level, printf('o%09d', c_custkey * 10) AS smallest,
  printf('o%09d', c_custkey * 10 + CASE WHEN c_custkey % 7 = 0 THEN 35 ELSE 9 END) AS biggest, c_custkey % 97 + 1 AS size FROM customer)"""
