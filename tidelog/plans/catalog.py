"""The query catalogue: each operator over the sample tables, with its SQL twin."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import expr
from tidelog.operators import apply, compact, manifest, merge, prefix, scan, stats, valuelog
from tidelog.sources import backup
from tidelog.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LATEST = "latest AS (SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY key ORDER BY cas DESC) = 1)"
LIVE = f"WITH {T.OPLOG}, {LATEST}, live AS (SELECT key, cas, meta, user_meta, value FROM latest WHERE meta & 1 = 0)"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.live_view(T.plain_log(spark, sf_dir))


@query(f"{LIVE} SELECT key, cas, meta, user_meta, value FROM live")
def kv_latest_live(spark, sf_dir):
    return _live(spark, sf_dir).select("key", "cas", "meta", "user_meta", "value").orderBy("key")


@query(f"WITH {T.OPLOG}, {LATEST} SELECT key, cas, meta FROM latest")
def kv_upsert(spark, sf_dir):
    return apply.upsert_only(T.plain_log(spark, sf_dir)).select("key", "cas", "meta")


@query(f"WITH {T.RUNS} SELECT key, rank, value FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank) = 1")
def kv_merge_runs(spark, sf_dir):
    r = T.runs(spark, sf_dir)
    return merge.latest_wins(r, by="rank", newest_is_max=False).select("key", "rank", "value")


@query(f"WITH {T.RUNS} SELECT key, value FROM runs WHERE rank IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank) = 1")
def kv_merge_list(spark, sf_dir):
    r = T.runs(spark, sf_dir)
    return merge.merge_runs([r.where(F.col("rank") == i).select("key", "value") for i in (1, 2, 3)]).select("key", "value")


@query(f"WITH {T.RUNS} SELECT count(*) AS versions FROM runs")
def kv_count_versions(spark, sf_dir):
    r = T.runs(spark, sf_dir)
    return merge.count_versions([r.where("rank <= 3"), r.where("rank > 3")])


@query(f"WITH {T.KV} SELECT key, value FROM kv WHERE key = 'o000000007'")
def kv_point_get(spark, sf_dir):
    return scan.get(T.kv_orders(spark, sf_dir), "o000000007")


@query(f"WITH {T.KV} SELECT key, value FROM kv WHERE key IN (SELECT printf('o%09d', c_custkey * 7) FROM customer)")
def kv_multi_get(spark, sf_dir):
    keys = T.table(spark, sf_dir, "customer").select(F.format_string("o%09d", F.col("c_custkey") * 7).alias("key"))
    return scan.multi_get(T.kv_orders(spark, sf_dir), keys)


@query(f"{LIVE} SELECT DISTINCT k.key, EXISTS (SELECT 1 FROM live l WHERE l.key = k.key AND NOT (l.meta = 0 AND coalesce(strlen(l.value), 0) = 0)) AS found FROM (SELECT printf('u%06d', c_custkey) AS key FROM customer) k")
def kv_exists(spark, sf_dir):
    keys = T.table(spark, sf_dir, "customer").select(F.format_string("u%06d", "c_custkey").alias("key"))
    return scan.exists(_live(spark, sf_dir), keys)


@query(f"{LIVE} SELECT DISTINCT printf('u%06d', c_custkey) AS key FROM customer WHERE printf('u%06d', c_custkey) NOT IN (SELECT key FROM live)")
def kv_missing(spark, sf_dir):
    keys = T.table(spark, sf_dir, "customer").select(F.format_string("u%06d", "c_custkey").alias("key"))
    return scan.missing(_live(spark, sf_dir), keys)


@query(f"WITH {T.KV} SELECT key, value FROM kv WHERE starts_with(key, 'o0000001')")
def kv_prefix_scan(spark, sf_dir):
    return scan.scan(T.kv_orders(spark, sf_dir), prefix="o0000001")


@query(f"WITH {T.KV} SELECT count(*) AS n FROM kv WHERE key >= 'o00000' AND key < 'o00001'")
def kv_binary_prefix(spark, sf_dir):
    view = T.kv_orders(spark, sf_dir).withColumn("key", F.col("key").cast("binary"))
    return view.where(expr.has_prefix("key", b"o00000")).agg(F.count("*").alias("n"))


@query(f"WITH {T.KV} SELECT key, value FROM kv WHERE key >= 'o000000100' AND key < 'o000000900'")
def kv_range_scan(spark, sf_dir):
    return scan.scan(T.kv_orders(spark, sf_dir), start="o000000100", end="o000000900")


@query(f"WITH {T.KV} SELECT key, value FROM kv WHERE key <= 'o000000900' ORDER BY key DESC LIMIT 100")
def kv_reverse_scan(spark, sf_dir):
    return scan.scan(T.kv_orders(spark, sf_dir), seek="o000000900", reverse=True, limit=100)


@query(f"WITH {T.KV} SELECT key, value FROM kv WHERE key >= 'o000000503' ORDER BY key LIMIT 100")
def kv_seek_limit(spark, sf_dir):
    return scan.scan(T.kv_orders(spark, sf_dir), seek="o000000503", limit=100)


@query(f"WITH {T.KV} SELECT key FROM kv")
def kv_keys_only(spark, sf_dir):
    return scan.scan(T.kv_orders(spark, sf_dir), keys_only=True)


def _nearest_sql(at_most: bool, strict: bool) -> str:
    op = ("<" if at_most else ">") + ("" if strict else "=")
    pick = "max" if at_most else "min"
    return f"""WITH {T.KV}, p AS (SELECT DISTINCT printf('o%09d', c_custkey * 11 - 40) || suffix AS probe FROM customer, (VALUES (''), ('x')) AS s(suffix))
      SELECT probe, {pick}(key) AS key FROM p LEFT JOIN kv ON kv.key {op} p.probe GROUP BY probe"""


def _nearest(at_most: bool, strict: bool):
    def run(spark, sf_dir):
        # Probes stand on keys, between two of them, and beyond both ends.
        at = F.format_string("o%09d", F.col("c_custkey") * 11 - 40)
        probes = T.table(spark, sf_dir, "customer").select(F.explode(F.array(at, F.concat(at, F.lit("x")))).alias("probe"))
        return scan.nearest(T.kv_orders(spark, sf_dir).select("key"), probes, at_most, strict)

    run.__name__ = f"kv_nearest_{'l' if at_most else 'g'}{'t' if strict else 'e'}"
    return query(_nearest_sql(at_most, strict))(run)


for _a in (True, False):
    for _s in (True, False):
        _nearest(_a, _s)


@query(f"WITH {T.KV} SELECT min(key) AS first_key, max(key) AS last_key FROM kv")
def kv_first_last(spark, sf_dir):
    return scan.first_last(T.kv_orders(spark, sf_dir))


@query(f"WITH {T.KV} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM kv")
def kv_prev_next(spark, sf_dir):
    return scan.neighbours(T.kv_orders(spark, sf_dir))


@query(f"""{LIVE} SELECT key, CASE WHEN meta & 1 = 1 THEN 0 WHEN coalesce(strlen(value), 0) < 20 THEN strlen(key) + coalesce(strlen(value), 0)
  ELSE strlen(key) + strlen(value) + 36 END AS size FROM live""")
def kv_item_sizes(spark, sf_dir):
    return _live(spark, sf_dir).select("key", expr.item_size().alias("size"))


_STATUS = """CASE WHEN o.cas_check <> 0 AND f.meta & 1 = 1 THEN 'NOT_FOUND' WHEN o.cas_check <> 0 AND f.cas <> o.cas_check THEN 'CAS_MISMATCH'
  WHEN o.meta = 8 AND f.meta & 1 = 0 AND NOT (f.meta = 0 AND coalesce(strlen(f.value), 0) = 0) THEN 'KEY_EXISTS' ELSE 'OK' END"""
_FOLD = f"""WITH RECURSIVE {T.OPLOG}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cas) AS rn FROM oplog),
 f AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS op, CAST(0 AS BIGINT) AS cas, 1 AS meta, 0 AS user_meta, CAST(NULL AS VARCHAR) AS value, 'OK' AS status FROM (SELECT DISTINCT key FROM oplog)
  UNION ALL SELECT key, rn, op, CASE WHEN s = 'OK' THEN op ELSE cas END, CASE WHEN s = 'OK' THEN om ELSE meta END, CASE WHEN s = 'OK' THEN ou ELSE user_meta END, CASE WHEN s = 'OK' THEN ov ELSE value END, s
  FROM (SELECT o.key, o.rn, o.cas AS op, o.meta AS om, o.user_meta AS ou, o.value AS ov, f.cas, f.meta, f.user_meta, f.value, {_STATUS} AS s FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1))"""


@query(f"{_FOLD} SELECT key, cas, meta, user_meta, value FROM f WHERE cas > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1")
def kv_apply_ops(spark, sf_dir):
    return apply.apply_ops(T.oplog(spark, sf_dir))


@query(f"{_FOLD} SELECT key, op AS cas, status FROM f WHERE rn > 0")
def kv_apply_status(spark, sf_dir):
    return apply.apply_status(T.oplog(spark, sf_dir))


@query("SELECT o_orderkey AS ordinal, 1000 + row_number() OVER (ORDER BY o_orderkey) AS cas FROM orders")
def kv_cas_counters(spark, sf_dir):
    batch = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"))
    return apply.allocate_cas(batch, base=1000).select("ordinal", "cas")


@query(f"WITH {T.BLOBS} SELECT key, CASE WHEN strlen(key) > 1048576 THEN 'KEY_TOO_BIG' WHEN coalesce(strlen(value), 0) > 4000 THEN 'VALUE_TOO_BIG' ELSE 'OK' END AS status FROM blobs")
def kv_validate_batch(spark, sf_dir):
    return T.blobs(spark, sf_dir).select("key", expr.validation(max_value=4000).alias("status"))


@query(f"{LIVE} SELECT CASE WHEN coalesce(strlen(value), 0) < 20 THEN 'inline' ELSE 'log' END AS placement, count(*) AS rows, sum(CASE WHEN coalesce(strlen(value), 0) < 20 THEN strlen(key) + coalesce(strlen(value), 0) ELSE strlen(key) + 10 END)::BIGINT AS bytes FROM live GROUP BY 1")
def kv_value_placement(spark, sf_dir):
    return stats.placement_stats(_live(spark, sf_dir))


_OFFSETS = f"{T.BLOBS}, vlog AS (SELECT key, cas, value, len, fid, ends - len - fid * 65536 AS \"offset\" FROM (SELECT *, (ends - len) // 65536 AS fid FROM (SELECT *, sum(len) OVER (ORDER BY cas)::BIGINT AS ends FROM blobs)))"


def _vlog(spark, sf_dir):
    return valuelog.offsets(T.blobs(spark, sf_dir), file_size=65536)


@query(f'WITH {_OFFSETS} SELECT key, len, fid::BIGINT AS fid, "offset"::BIGINT AS "offset" FROM vlog')
def kv_vlog_offsets(spark, sf_dir):
    return _vlog(spark, sf_dir).select("key", "len", "fid", "offset")


@query(f"WITH {T.BLOBS} SELECT key, cas, md5(value) AS digest FROM blobs")
def kv_deref(spark, sf_dir):
    rows, blobs = valuelog.separate(T.blobs(spark, sf_dir), file_size=65536)
    return valuelog.dereference(rows, blobs).select("key", "cas", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(f'WITH {_OFFSETS} SELECT key, fid::BIGINT AS fid, "offset"::BIGINT AS "offset" FROM vlog WHERE fid > 3 OR (fid = 3 AND "offset" > 1000)')
def kv_replay_from(spark, sf_dir):
    return valuelog.replay(_vlog(spark, sf_dir), 3, 1000).select("key", "fid", "offset")


@query(f'WITH {_OFFSETS} SELECT fid::BIGINT AS fid, "offset"::BIGINT AS "offset", len FROM vlog ORDER BY fid DESC, "offset" DESC LIMIT 1')
def kv_last_pointer(spark, sf_dir):
    return valuelog.last_pointer(_vlog(spark, sf_dir))


_GC = f"""{T.OPLOG}, v AS (SELECT *, strlen(key) + coalesce(strlen(value), 0) + 36 AS len FROM oplog),
  p AS (SELECT *, (ends - len) // 8192 AS fid FROM (SELECT *, sum(len) OVER (ORDER BY cas)::BIGINT AS ends FROM v)),
  cur AS (SELECT key, cas, meta FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY cas DESC) = 1),
  c AS (SELECT p.key, p.cas, p.fid::BIGINT AS fid, p.len, p.cas = cur.cas AND cur.meta & 1 = 0 AS keep FROM p JOIN cur ON p.key = cur.key),
  st AS (SELECT fid, count(*) AS entries, sum(len)::BIGINT AS total_bytes, sum(CASE WHEN keep THEN 0 ELSE len END)::BIGINT AS discard_bytes FROM c GROUP BY fid)"""


def _gc(spark, sf_dir):
    log = valuelog.offsets(T.plain_log(spark, sf_dir), file_size=8192)
    return log, merge.latest_wins(log)


@query(f"WITH {_GC} SELECT * FROM st")
def kv_gc_stats(spark, sf_dir):
    return valuelog.gc_stats(*_gc(spark, sf_dir))


@query(f"WITH {_GC} SELECT * FROM st WHERE fid < (SELECT max(fid) FROM st) AND total_bytes >= 1000 AND discard_bytes >= 0.5 * total_bytes")
def kv_gc_candidates(spark, sf_dir):
    return valuelog.gc_candidates(valuelog.gc_stats(*_gc(spark, sf_dir)), 0.5, least=1000)


@query(f"WITH {_GC} SELECT key, cas, cas AS cas_check FROM c WHERE keep AND fid = (SELECT max(fid) FROM c WHERE keep)")
def kv_gc_rewrite(spark, sf_dir):
    """The newest file that holds live entries."""
    log, current = _gc(spark, sf_dir)
    newest = valuelog.gc_stats(log, current).where("discard_bytes < total_bytes").agg(F.max("fid")).first()[0]
    return valuelog.gc_rewrite(log, current, newest).select("key", "cas", "cas_check")


@query(f"WITH {_GC} SELECT arg_min(fid, struct_pack(r := -discard_bytes / total_bytes, fid := fid)) AS fid FROM st WHERE fid < (SELECT max(fid) FROM st) AND total_bytes >= 1000 AND discard_bytes >= 0.5 * total_bytes")
def kv_gc_pick(spark, sf_dir):
    return spark.createDataFrame([(valuelog.gc_pick(valuelog.gc_stats(*_gc(spark, sf_dir)), 0.5, least=1000),)], "fid long")


@query(f"""WITH {_GC}, live AS (SELECT p.key, p.value, p.user_meta FROM p JOIN cur ON p.key = cur.key AND p.cas = cur.cas WHERE p.meta & 1 = 0) SELECT key, md5(value) AS digest, user_meta FROM live""")
def kv_gc_apply(spark, sf_dir):
    """The live view after the newest file with live entries has been rewritten: entries change their counters, not their values."""
    log, current = _gc(spark, sf_dir)
    newest = valuelog.gc_stats(log, current).where("discard_bytes < total_bytes").agg(F.max("fid")).first()[0]
    ops = valuelog.gc_rewrite(log, current, newest).withColumn("cas", F.col("cas") + F.lit(1 << 40))
    after = apply.apply_ops(ops, current).unionByName(current.select("key", "cas", "meta", "user_meta", "value"))
    return merge.live_view(after).select("key", F.md5(F.col("value").cast("binary")).alias("digest"), "user_meta")


@query(f"WITH {_GC} SELECT DISTINCT fid FROM c WHERE fid NOT IN (SELECT fid FROM st WHERE discard_bytes > 0)")
def kv_log_clean_files(spark, sf_dir):
    log, current = _gc(spark, sf_dir)
    return valuelog.clean_files(log, valuelog.gc_stats(log, current).where("discard_bytes > 0"))


@query(f"WITH {_OFFSETS} SELECT key, fid::BIGINT AS fid, \"offset\"::BIGINT AS \"offset\" FROM vlog WHERE fid = 2 AND \"offset\" >= 100 ORDER BY \"offset\" LIMIT 5")
def kv_vlog_read(spark, sf_dir):
    return valuelog.read_entries(_vlog(spark, sf_dir), 2, 100, 5).select("key", "fid", "offset")


@query(f"WITH {_OFFSETS}, f AS (SELECT * FROM vlog WHERE fid = 1) SELECT key, \"offset\"::BIGINT AS \"offset\" FROM f WHERE \"offset\" <= (SELECT min(\"offset\") FROM f WHERE len > 3000) OR NOT EXISTS (SELECT 1 FROM f WHERE len > 3000)")
def kv_vlog_iterate(spark, sf_dir):
    """A file read up to its first entry over 3,000 bytes."""
    return valuelog.iterate(_vlog(spark, sf_dir), 1, until=F.col("len") > 3000).select("key", "offset")


@query(f"WITH {_GC}, r AS (SELECT * FROM p WHERE fid > 0 OR ends - len - fid * 8192 > 5000) SELECT key, cas, meta, user_meta, md5(value) AS digest FROM r WHERE meta <> 8 QUALIFY row_number() OVER (PARTITION BY key ORDER BY cas DESC) = 1")
def kv_recover(spark, sf_dir):
    """The state that replaying the log after a pointer gives."""
    log = valuelog.offsets(T.plain_log(spark, sf_dir).where("meta <> 8"), file_size=1 << 62)
    whole = valuelog.offsets(T.plain_log(spark, sf_dir), file_size=8192).select("cas", "fid", "offset")
    rest = log.drop("fid", "offset").join(whole, "cas")
    return valuelog.recover(rest, 0, 5000).select("key", "cas", "meta", "user_meta", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 1")
def kv_vlog_ids(spark, sf_dir):
    """Ids out of the names of log files, beside other files."""
    names = T.table(spark, sf_dir, "orders").select(F.format_string("%06d.", "o_orderkey").alias("n"), (F.col("o_orderkey") % 3).alias("k"))
    return manifest.file_ids(names.select(F.concat(F.lit("vlog/"), "n", F.when(F.col("k") == 1, F.lit("vlog")).otherwise(F.lit("run"))).alias("name")), "vlog")


_STATE = f"{T.MANIFEST}, state AS (SELECT id, level FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY change_set DESC) = 1) WHERE op = 'CREATE')"


@query(f"WITH {_STATE} SELECT id, level FROM state")
def kv_manifest_replay(spark, sf_dir):
    return manifest.replay(T.manifest_log(spark, sf_dir))


_DOUBLED = "doubled AS (SELECT * FROM log UNION ALL SELECT 2, id, 'DELETE', level FROM log WHERE op = 'CREATE' AND id % 5 = 0)"


@query(f"WITH {T.MANIFEST}, {_DOUBLED} SELECT id, change_set::BIGINT AS change_set, op FROM (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY change_set) AS b FROM doubled) WHERE (op = 'CREATE' AND b = 'CREATE') OR (op = 'DELETE' AND (b IS NULL OR b = 'DELETE'))")
def kv_manifest_invalid(spark, sf_dir):
    log = T.manifest_log(spark, sf_dir)
    again = log.where("op = 'CREATE' AND id % 5 = 0").withColumns({"change_set": F.lit(2).cast("long"), "op": F.lit("DELETE")})
    return manifest.invalid(log.unionByName(again)).select("id", "change_set", "op")


@query(f"WITH {T.MANIFEST}, c AS (SELECT count(*) FILTER (op = 'CREATE') AS creations, count(*) FILTER (op = 'DELETE') AS deletions FROM log) SELECT creations, deletions, deletions > 100 AND deletions > 0.5 * (creations - deletions) AS rewrite FROM c")
def kv_manifest_counts(spark, sf_dir):
    return manifest.counts(T.manifest_log(spark, sf_dir), 100, 0.5)


@query(f"WITH {_STATE}, seen AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 > 0) SELECT id, 'missing' AS problem FROM state WHERE id NOT IN (SELECT id FROM seen) UNION ALL SELECT id, 'orphan' FROM seen WHERE id NOT IN (SELECT id FROM state)")
def kv_reconcile(spark, sf_dir):
    seen = T.table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0")
    files = manifest.file_ids(seen.select(F.format_string("runs/%06d.run", "o_orderkey").alias("name")))
    return manifest.reconcile(manifest.replay(T.manifest_log(spark, sf_dir)), files)


_LEVELS = f"{T.TABLES}, ls AS (SELECT level, count(*) AS tables, sum(size)::BIGINT AS bytes, min(smallest) AS smallest, max(biggest) AS biggest FROM tables GROUP BY level)"


@query(f"WITH {_LEVELS} SELECT * FROM ls")
def kv_level_stats(spark, sf_dir):
    return compact.level_stats(T.run_tables(spark, sf_dir))


@query(f"WITH {_LEVELS} SELECT level, CASE WHEN level = 0 THEN tables / 5.0 ELSE bytes / (1000.0 * pow(10.0, level - 1)) END AS score FROM ls WHERE level < 6 AND CASE WHEN level = 0 THEN tables / 5.0 ELSE bytes / (1000.0 * pow(10.0, level - 1)) END >= 1")
def kv_pick_levels(spark, sf_dir):
    return compact.pick_levels(compact.level_stats(T.run_tables(spark, sf_dir)), level_one=1000)


@query(f"WITH {T.TABLES} SELECT n_nationkey AS range_id, id FROM nation JOIN tables ON smallest <= printf('o%09d', n_nationkey * 50 + 20) AND printf('o%09d', n_nationkey * 50) <= biggest")
def kv_overlapping_tables(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    at = F.col("n_nationkey") * 50
    ranges = n.select(F.col("n_nationkey").alias("range_id"), F.format_string("o%09d", at).alias("left"), F.format_string("o%09d", at + 20).alias("right"))
    return compact.overlapping(T.run_tables(spark, sf_dir), ranges)


@query(f"WITH {T.TABLES} SELECT level, id FROM (SELECT *, max(biggest) OVER (PARTITION BY level ORDER BY smallest, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tables WHERE level > 0) WHERE before >= smallest")
def kv_level_validate(spark, sf_dir):
    return compact.violations(T.run_tables(spark, sf_dir))


@query(f"""WITH {T.TABLES}, top AS (SELECT * FROM tables WHERE level = 1 ORDER BY size DESC, id LIMIT 1)
  SELECT id, 'top' AS side FROM top UNION ALL SELECT t.id, 'bottom' FROM tables t, top WHERE t.level = 2 AND t.smallest <= top.biggest AND top.smallest <= t.biggest""")
def kv_choose_inputs(spark, sf_dir):
    return compact.choose_inputs(T.run_tables(spark, sf_dir), 1)


@query(f"""WITH {T.TABLES}, top AS (SELECT * FROM tables WHERE level = 0), span AS (SELECT min(smallest) AS lo, max(biggest) AS hi FROM top)
  SELECT id, 'top' AS side FROM top UNION ALL SELECT t.id, 'bottom' FROM tables t, span WHERE t.level = 1 AND t.smallest <= hi AND lo <= t.biggest""")
def kv_level0_inputs(spark, sf_dir):
    return compact.choose_inputs(T.run_tables(spark, sf_dir), 0)


_BUSY = "busy AS (SELECT n_nationkey AS range_id, printf('o%09d', n_nationkey * 40) AS lo, printf('o%09d', n_nationkey * 40 + 15) AS hi FROM nation)"


def _busy(spark, sf_dir):
    at = F.col("n_nationkey") * 40
    return T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("range_id"), F.format_string("o%09d", at).alias("left"), F.format_string("o%09d", at + 15).alias("right"))


@query(f"""WITH {T.TABLES}, {_BUSY}, top AS (SELECT * FROM tables t WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM busy b WHERE t.smallest <= b.hi AND b.lo <= t.biggest) ORDER BY size DESC, id LIMIT 1)
  SELECT id, 'top' AS side FROM top UNION ALL SELECT t.id, 'bottom' FROM tables t, top WHERE t.level = 2 AND t.smallest <= top.biggest AND top.smallest <= t.biggest""")
def kv_busy_inputs(spark, sf_dir):
    return compact.choose_inputs(T.run_tables(spark, sf_dir), 1, _busy(spark, sf_dir))


@query(f"""WITH {_LEVELS}, b AS (SELECT level, count(*) AS tables, sum(size)::BIGINT AS bytes FROM tables WHERE id % 4 = 0 GROUP BY level),
  left_ AS (SELECT level, CASE WHEN level = 0 AND coalesce(b.tables, 0) > 0 THEN 0 ELSE ls.tables END AS tables, ls.bytes - coalesce(b.bytes, 0) AS bytes FROM ls LEFT JOIN b USING (level)),
  s AS (SELECT level, CASE WHEN level = 0 THEN tables / 5.0 ELSE bytes / (100.0 * pow(10.0, level - 1)) END AS score FROM left_) SELECT level, score FROM s WHERE level < 6 AND score >= 1""")
def kv_pick_levels_busy(spark, sf_dir):
    """Every fourth table is being compacted."""
    tables = T.run_tables(spark, sf_dir)
    return compact.pick_levels(compact.level_stats(tables), level_one=100, busy=compact.level_stats(tables.where("id % 4 = 0")))


_FREE = f"{T.TABLES}, free AS (SELECT id FROM tables t WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM tables u WHERE u.level = 2 AND u.smallest <= t.biggest AND t.smallest <= u.biggest))"


@query(f"WITH {_FREE} SELECT id, 'DELETE' AS op, 1 AS level FROM free UNION ALL SELECT id, 'CREATE', 2 FROM free")
def kv_trivial_move(spark, sf_dir):
    return compact.trivial_moves(T.run_tables(spark, sf_dir), 1)


@query(f"WITH {_FREE} SELECT id, CASE WHEN id IN (SELECT id FROM free) THEN 2 ELSE level END AS level FROM tables")
def kv_replace_tables(spark, sf_dir):
    tables = T.run_tables(spark, sf_dir)
    return compact.replaced(tables, compact.trivial_moves(tables, 1))


@query(f"""WITH {T.TABLES}, top AS (SELECT * FROM tables WHERE level = 1 ORDER BY size DESC, id LIMIT 1)
  SELECT id, 'DELETE' AS op, 1 AS level FROM top UNION ALL SELECT t.id, 'DELETE', 2 FROM tables t, top WHERE t.level = 2 AND t.smallest <= top.biggest AND top.smallest <= t.biggest
  UNION ALL SELECT 1000000 + n_nationkey, 'CREATE', 2 FROM nation""")
def kv_change_set(spark, sf_dir):
    made = T.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000000).alias("id"))
    return compact.change_set(compact.choose_inputs(T.run_tables(spark, sf_dir), 1), made, 1)


@query("""WITH r AS (SELECT o_orderkey AS k, 30 + o_orderkey % 50 AS size, sum(30 + o_orderkey % 50) OVER (ORDER BY o_orderkey) AS e FROM orders)
  SELECT ((e - size) // 4000)::BIGINT AS part, count(*) AS rows, sum(size)::BIGINT AS bytes, min(k) AS first, max(k) AS last FROM r GROUP BY 1""")
def kv_split_tables(spark, sf_dir):
    """Rows cut into tables of about 4,000 bytes."""
    return compact.split_by_size(T.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 30 + F.col("o_orderkey") % 50, 4000)


@query(f"WITH {T.TABLES}, first AS (SELECT id FROM tables WHERE level = 0) SELECT level, count(*) AS tables, list_sort(list(id)) AS ids FROM tables GROUP BY level")
def kv_table_ids(spark, sf_dir):
    return compact.table_ids(T.run_tables(spark, sf_dir))


@query(f"WITH {T.TABLES} SELECT id FROM tables WHERE level = 2 ORDER BY size DESC, id LIMIT 10")
def kv_tables_by_size(spark, sf_dir):
    return compact.in_order(T.run_tables(spark, sf_dir).where("level = 2"), "size").limit(10).select("id")


@query(f"WITH {T.TABLES}, r AS (SELECT c_custkey AS range_id, printf('o%09d', c_custkey * 10) AS lo, CASE WHEN c_custkey % 2 = 0 THEN printf('o%09d', c_custkey * 10 + 9) END AS hi FROM customer) SELECT id FROM tables JOIN r ON id = range_id AND smallest = lo AND biggest IS NOT DISTINCT FROM hi")
def kv_range_equality(spark, sf_dir):
    at = F.col("c_custkey") * 10
    other = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string("o%09d", at).alias("lo"), F.when(F.col("c_custkey") % 2 == 0, F.format_string("o%09d", at + 9)).alias("hi"))
    return T.run_tables(spark, sf_dir).join(other, "id").where(expr.same_range(F.col("smallest"), F.col("biggest"), F.col("lo"), F.col("hi"))).select("id")


@query(f"WITH {T.TABLES}, r AS (SELECT n_nationkey AS range_id, CASE WHEN n_nationkey > 0 THEN printf('o%09d', n_nationkey * 50) END AS lo, CASE WHEN n_nationkey > 0 THEN printf('o%09d', n_nationkey * 50 + 20) END AS hi FROM nation) SELECT range_id, id FROM r JOIN tables ON lo IS NULL OR (smallest <= hi AND lo <= biggest)")
def kv_overlap_endless(spark, sf_dir):
    """One of the ranges has no ends."""
    at = F.col("n_nationkey") * 50
    some = F.col("n_nationkey") > 0
    ranges = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("range_id"), F.when(some, F.format_string("o%09d", at)).alias("left"), F.when(some, F.format_string("o%09d", at + 20)).alias("right"))
    return compact.overlapping(T.run_tables(spark, sf_dir), ranges)


@query(f"WITH {_STATE} SELECT 0::BIGINT AS change_set, row_number() OVER (ORDER BY level, id)::INTEGER AS seq, id, 'CREATE' AS op, level FROM state")
def kv_manifest_snapshot(spark, sf_dir):
    return manifest.as_changes(manifest.replay(T.manifest_log(spark, sf_dir)))


@query(f"WITH {T.MANIFEST} SELECT id, 0::BIGINT AS change_set, op FROM log WHERE change_set = 0")
def kv_manifest_valid_prefix(spark, sf_dir):
    """The second change set's stored checksum is wrong."""
    log = T.manifest_log(spark, sf_dir)
    made = manifest.checksums(log)
    stored = made.select("change_set", (F.col("crc") + F.when(F.col("change_set") == 1, 1).otherwise(0)).alias("stored"))
    checked = made.join(stored, "change_set").withColumn("crc_ok", F.col("crc") == F.col("stored"))
    return manifest.valid_prefix(log, sets=checked).select("id", "change_set", "op")


@query("SELECT split_part(path, '.', 2) AS suffix, sum(length)::BIGINT AS bytes FROM (SELECT printf('%06d', o_orderkey) || CASE WHEN o_orderkey % 3 = 0 THEN '.run' ELSE '.vlog' END AS path, o_orderkey % 1000 AS length FROM orders) GROUP BY 1")
def kv_folder_sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    return stats.folder_sizes(T.table(spark, sf_dir, "orders").select(F.concat(F.format_string("%06d", k), F.when(k % 3 == 0, ".run").otherwise(".vlog")).alias("path"), (k % 1000).alias("length")))


@query(f"""{_FOLD}, d AS (SELECT op, om, key, ov, s FROM (SELECT f.key, f.rn, f.op, f.status AS s, o.meta AS om, o.value AS ov FROM f JOIN o ON o.key = f.key AND o.rn = f.rn WHERE f.rn > 0)),
  w AS (SELECT count(*) AS num_puts, count(*) FILTER (s = 'OK') AS num_writes, sum(CASE WHEN s = 'OK' THEN strlen(key) + CASE WHEN coalesce(strlen(ov), 0) < 20 THEN coalesce(strlen(ov), 0) ELSE 10 END ELSE 0 END) AS lsm,
    sum(CASE WHEN s = 'OK' AND om & 1 = 0 AND coalesce(strlen(ov), 0) >= 20 THEN strlen(key) + strlen(ov) + 36 ELSE 0 END) AS vlog FROM d)
  SELECT label, CASE label WHEN 'num_puts' THEN num_puts WHEN 'num_writes' THEN num_writes WHEN 'lsm_size' THEN lsm WHEN 'vlog_size' THEN vlog WHEN 'num_bytes_written' THEN lsm + vlog ELSE 0 END::BIGINT AS value
  FROM w, (SELECT unnest(['lsm_size', 'vlog_size', 'pending_writes', 'num_reads', 'num_writes', 'num_bytes_read', 'num_bytes_written', 'num_lsm_gets', 'num_lsm_bloom_hits', 'num_gets', 'num_puts', 'num_blocked_puts', 'num_mem_tables_gets', 'block_hash_calc_cost']) AS label)""")
def kv_metrics(spark, sf_dir):
    ops = T.oplog(spark, sf_dir)
    return stats.write_metrics(ops, apply.apply_status(ops))


@query(f"WITH {T.OPLOG} SELECT cas // 100 AS request, count(*) AS entries, sum(strlen(key) + coalesce(strlen(value), 0) + 36)::BIGINT AS bytes FROM oplog GROUP BY 1")
def kv_request_counts(spark, sf_dir):
    return stats.request_counts(T.plain_log(spark, sf_dir).withColumn("request", F.floor(F.col("cas") / 100)))


@query(f"""WITH {T.OPLOG}, marked AS (SELECT CASE WHEN cas % 5 = 0 THEN '~tidelog/' || key ELSE key END AS key, cas, meta FROM oplog),
  latest AS (SELECT * FROM marked WHERE NOT starts_with(key, '~tidelog/') QUALIFY row_number() OVER (PARTITION BY key ORDER BY cas DESC) = 1) SELECT key, cas FROM latest WHERE meta & 1 = 0""")
def kv_internal_keys(spark, sf_dir):
    """A fifth of the versions stand under reserved keys, which readers don't see."""
    key = F.when(F.col("cas") % 5 == 0, F.concat(F.lit("~tidelog/"), "key")).otherwise(F.col("key"))
    return merge.live_view(T.plain_log(spark, sf_dir).withColumn("key", key)).select("key", "cas")


_GUARD = T.OPLOG.replace("event_type = 'click' AND event_id % 2 = 0", "event_type IN ('click', 'error')")


@query(_FOLD.replace(T.OPLOG, _GUARD) + " SELECT key, op AS cas, status FROM f WHERE rn > 0")
def kv_guarded_deletes(spark, sf_dir):
    """Deletes compare counters too."""
    return apply.apply_status(T.oplog(spark, sf_dir, F.col("event_type").isin("click", "error")))


@query(f"WITH {T.BLOBS}, b AS (SELECT CASE WHEN cas % 9 = 0 THEN repeat(key, 20) ELSE key END AS key, value FROM blobs) SELECT key, CASE WHEN strlen(key) > 100 THEN 'KEY_TOO_BIG' WHEN coalesce(strlen(value), 0) > 2000 THEN 'VALUE_TOO_BIG' ELSE 'OK' END AS status FROM b")
def kv_validate_keys(spark, sf_dir):
    rows = T.blobs(spark, sf_dir).withColumn("key", F.when(F.col("cas") % 9 == 0, F.repeat("key", 20)).otherwise(F.col("key")))
    return rows.select("key", expr.validation(max_value=2000, max_key=100).alias("status"))


@query("SELECT e AS id, CASE WHEN e % 3 = 0 THEN '<not UTF-8>' ELSE 'é' || e END AS text FROM (SELECT event_id AS e FROM events)")
def kv_display(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    raw = F.when(F.col("id") % 3 == 0, F.lit(bytearray(b"\xff\xfe"))).otherwise(F.concat(F.lit("é"), F.col("id").cast("string")).cast("binary"))
    return e.select("id", expr.display(raw).alias("text"))


@query(f"WITH {T.OPLOG}, {LATEST} SELECT key, cas, meta, user_meta, value FROM latest")
def kv_compact(spark, sf_dir):
    return compact.compact(T.plain_log(spark, sf_dir))


@query(f"""WITH {T.KV}, b AS (SELECT key, substr(key, 1, 7) AS p, (row_number() OVER (PARTITION BY substr(key, 1, 7) ORDER BY key) - 1) // 100 AS n FROM kv),
  w AS (SELECT key, min(key) OVER (PARTITION BY p, n) AS base_key FROM b),
  s AS (SELECT key, base_key, CASE WHEN key = base_key THEN length(key) ELSE (SELECT max(i) FROM range(0, 11) t(i) WHERE substr(key, 1, i) = substr(base_key, 1, i)) END AS shared FROM w)
  SELECT key, base_key, shared::INTEGER AS shared, substr(key, shared::INTEGER + 1) AS suffix FROM s""")
def kv_prefix_encode(spark, sf_dir):
    return stats.prefix_blocks(T.kv_orders(spark, sf_dir))


@query(f"WITH {T.KV} SELECT key, md5(value) AS digest FROM kv")
def kv_digest(spark, sf_dir):
    return T.kv_orders(spark, sf_dir).select("key", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(f"""WITH {T.KV} SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(value, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM kv""")
def kv_checksum(spark, sf_dir):
    return T.kv_orders(spark, sf_dir).select("key", F.crc32(F.col("value").cast("binary")).alias("crc"))


@query(f"{LIVE} SELECT key, value, user_meta FROM live")
def kv_backup(spark, sf_dir):
    return backup.export(_live(spark, sf_dir))


@query(f"WITH {T.BLOBS} SELECT count(*) AS rows, sum(strlen(key))::BIGINT AS key_bytes, sum(coalesce(strlen(value), 0))::BIGINT AS value_bytes, sum(strlen(key) + coalesce(strlen(value), 0) + 10)::BIGINT AS memory_bytes FROM blobs")
def kv_size_stats(spark, sf_dir):
    return stats.size_stats(T.blobs(spark, sf_dir))


@query(f"WITH {T.BLOBS} SELECT key, sum(strlen(key) + coalesce(strlen(value), 0)) OVER (ORDER BY cas)::BIGINT AS upto FROM blobs")
def kv_running_bytes(spark, sf_dir):
    return prefix.running_sum(T.blobs(spark, sf_dir), expr.size_of("key") + expr.size_of("value"), "cas", "upto").select("key", "upto")


