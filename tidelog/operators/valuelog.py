"""Separating large values into a blob log, reading them back, and collecting its garbage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import expr
from tidelog.operators.apply import apply_ops
from tidelog.operators.prefix import running_sum


def offsets(log: DataFrame, file_size: int = 1 << 30, first_fid: int = 0) -> DataFrame:
    """Adds len, fid and offset: entries in order of cas, rotated to a new file each file_size bytes of the log."""
    out = running_sum(log.withColumn("len", expr.entry_size()), F.col("len"), "cas", "_end")
    at = F.col("_end") - F.col("len")
    return out.withColumns({"fid": (F.floor(at / file_size) + first_fid).cast("long"), "offset": (at % file_size).cast("long")}).drop("_end")


def separate(rows: DataFrame, threshold: int = S.VALUE_THRESHOLD, file_size: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """(rows with small values inline and (fid, offset, len) for the others, blobs)."""
    big = (expr.size_of("value") >= threshold) & expr.live()
    blobs = offsets(rows.where(big), file_size)
    kept = rows.where(~big).select("key", "cas", "meta", "user_meta", "value", *(F.lit(None).cast("long").alias(c) for c in ("fid", "offset", "len")))
    out = blobs.select("key", "cas", F.col("meta").bitwiseOR(S.POINTER).alias("meta"), "user_meta", F.lit(None).cast(rows.schema["value"].dataType).alias("value"), "fid", "offset", "len")
    return kept.unionByName(out), blobs.select("fid", "offset", "len", "key", "cas", "value")


def dereference(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Fills in the values that stand in the log; AQE broadcasts blobs only when they turn out small. Rows with an inline value have no place: they are dealt by numbers below those of all files, not to one task."""
    b = blobs.select(F.col("fid").alias("_f"), F.col("offset").alias("_o"), F.col("value").alias("_v"))
    file = F.coalesce("fid", -1 - F.pmod(F.xxhash64("key", "cas"), F.lit(1 << 20)))
    out = rows.withColumn("_file", file).join(b, (F.col("_file") == F.col("_f")) & (F.col("offset") == F.col("_o")), "left")
    out = out.withColumn("value", F.coalesce("value", "_v"))
    return out.withColumn("meta", F.col("meta").bitwiseAND(~S.POINTER)).select("key", "cas", "meta", "user_meta", "value")


def read_entries(blobs: DataFrame, fid: int, offset: int, n: int) -> DataFrame:
    """n entries of a file from an offset on."""
    return blobs.where((F.col("fid") == fid) & (F.col("offset") >= offset)).orderBy("offset").limit(n)


def iterate(log: DataFrame, fid: int, until_bytes: int | None = None, until: Column | None = None) -> DataFrame:
    """Entries of a file in order, up to the one with which until_bytes are read, or to the first for which until holds, that one included."""
    rows = log.where(F.col("fid") == fid)
    if until_bytes is not None:
        rows = rows.where(F.col("offset") < until_bytes)
    if until is not None:
        stop = rows.where(until).agg(F.min("offset").alias("_stop"))
        rows = rows.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("offset") <= F.col("_stop"))).drop("_stop")
    return rows.orderBy("offset")


def replay(log: DataFrame, fid: int, offset: int) -> DataFrame:
    """Entries after a pointer, in log order."""
    return log.where((F.col("fid") > fid) | ((F.col("fid") == fid) & (F.col("offset") > offset)))


def recover(log: DataFrame, fid: int, offset: int, view: DataFrame | None = None) -> DataFrame:
    """State of each key that the entries after a pointer touch: they are applied once more, in order of their counters, to the view as it was at the pointer."""
    rest = replay(log, fid, offset)
    return apply_ops(rest if "cas_check" in rest.columns else rest.withColumn("cas_check", F.lit(0).cast("long")), view)


def clean_files(all_ids: DataFrame, dirty: DataFrame) -> DataFrame:
    """Ids of log files without the dirty ones, in order."""
    return all_ids.select("fid").distinct().join(dirty.select("fid").distinct(), "fid", "left_anti").orderBy("fid")


def last_pointer(log: DataFrame) -> DataFrame:
    return log.agg(F.max(F.struct("fid", "offset", "len")).alias("_p")).select("_p.*")


def classify(log: DataFrame, current: DataFrame) -> DataFrame:
    """Adds keep: the key's newest version is this very entry. Deleted, inline or later-placed keys make an entry garbage."""
    now = current.select("key", F.col("fid").alias("_fid"), F.col("offset").alias("_off"), F.col("meta").alias("_m"))
    same = (F.col("_fid") == F.col("fid")) & (F.col("_off") == F.col("offset")) & (F.col("_m").bitwiseAND(S.DELETE) == 0)
    return log.join(now, "key", "left").withColumn("keep", F.coalesce(same, F.lit(False))).drop("_fid", "_off", "_m")


def gc_stats(log: DataFrame, current: DataFrame) -> DataFrame:
    """Per file: bytes and entries, in all and discarded."""
    return classify(log, current).groupBy("fid").agg(
        F.count("*").alias("entries"),
        F.sum("len").alias("total_bytes"),
        F.sum(F.when(~F.col("keep"), F.col("len")).otherwise(0)).alias("discard_bytes"),
    )


def gc_candidates(stats: DataFrame, ratio: float, least: int = S.GC_MIN_BYTES) -> DataFrame:
    """Files worth rewriting, most garbage first; never the newest."""
    if not 0 < ratio < 1:
        raise S.InvalidRequest("the discard ratio lies between 0 and 1, both excluded")
    newest = stats.agg(F.max("fid").alias("_n"))
    worth = (F.col("total_bytes") >= least) & (F.col("discard_bytes") >= F.lit(ratio) * F.col("total_bytes"))
    return stats.join(F.broadcast(newest), F.col("fid") < F.col("_n")).where(worth).drop("_n").orderBy((F.col("discard_bytes") / F.col("total_bytes")).desc(), "fid")


def gc_pick(stats: DataFrame, ratio: float, least: int = S.GC_MIN_BYTES) -> int:
    """The file to rewrite; NoRewrite if none is worth it. Statistics are a row a file."""
    found = gc_candidates(stats, ratio, least).first()
    if found is None:
        raise S.NoRewrite(f"no file but the newest has {least} bytes of which {ratio:.0%} are garbage")
    return found["fid"]


def gc_rewrite(log: DataFrame, current: DataFrame, fid: int) -> DataFrame:
    """The entries of a file that stay, as ops guarded by their own counter."""
    kept = classify(log.where(F.col("fid") == fid), current).where("keep")
    return kept.withColumns({"cas_check": F.col("cas"), "meta": F.col("meta").bitwiseAND(~S.SET_IF_ABSENT)}) if "meta" in kept.columns else kept.withColumn("cas_check", F.col("cas"))
