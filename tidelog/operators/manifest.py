"""Replaying, checking and reconciling the list of tables."""

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import expr


def replay(changes: DataFrame) -> DataFrame:
    """(id, level) of the tables that exist after all changes."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("op", "level"), F.struct("change_set", "seq")).alias("_c"))
    return last.where(F.col("_c.op") == "CREATE").select("id", F.col("_c.level").alias("level"))


def invalid(changes: DataFrame) -> DataFrame:
    """Changes that create a table that exists or delete one that doesn't."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("change_set", "seq"))
    bad = F.when(F.col("op") == "CREATE", before == "CREATE").otherwise(before.isNull() | (before == "DELETE"))
    return changes.withColumn("_bad", F.coalesce(bad, F.lit(False))).where("_bad").drop("_bad")


def counts(changes: DataFrame, threshold: int = S.MANIFEST_DELETES, ratio: int = S.MANIFEST_RATIO) -> DataFrame:
    """Creations, deletions, and whether a snapshot should replace the log."""
    c = changes.agg(F.count_if(F.col("op") == "CREATE").alias("creations"), F.count_if(F.col("op") == "DELETE").alias("deletions"))
    return c.withColumn("rewrite", (F.col("deletions") > threshold) & (F.col("deletions") > ratio * (F.col("creations") - F.col("deletions"))))


def as_changes(state: DataFrame) -> DataFrame:
    """The state as one change set, which a rewrite puts in place of the log; seq runs through all levels (a row a table, so one task numbers them)."""
    return state.select(F.lit(0).cast("long").alias("change_set"), F.row_number().over(Window.orderBy("level", "id")).alias("seq"), "id", F.lit("CREATE").alias("op"), "level")


#: Bits of seq and id that one step of checksums() puts together: a task holds 4,096 lines or parts at once where seqs and ids are dense.
PART = 12


def _in_a_row(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Parts of a text (crc, n bytes) joined by line breaks, in order, to one of each group of keys."""

    def after(s, x):
        line = expr.crc32_join(s["crc"], F.lit(zlib.crc32(b"\n")), F.lit(1))
        return F.struct(F.when(s["n"] < 0, x["crc"]).otherwise(expr.crc32_join(line, x["crc"], x["n"])).alias("crc"), (s["n"] + 1 + x["n"]).alias("n"))

    none = F.struct(F.lit(0).cast("long").alias("crc"), F.lit(-1).cast("long").alias("n"))
    all_of = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "crc", "n"))).alias("_p"))
    return all_of.select(*keys, F.aggregate("_p", none, after).alias("_c")).select(*keys, "_c.crc", "_c.n")


def checksums(changes: DataFrame) -> DataFrame:
    """(change_set, crc): CRC-32 over a set's changes, spelled 'op id level' in order of seq and id, a line each. A set may be large: parts of it are summed alone, and their sums are put together."""
    part = lambda c, bits: F.shiftright(F.col(c).cast("long"), bits)
    line = F.struct("seq", "id", F.concat_ws(" ", "op", "id", "level").alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").cast("binary")
    ids = changes.groupBy("change_set", "seq", part("id", PART).alias("_i")).agg(text.alias("_t")).select("change_set", "seq", "_i", F.crc32("_t").alias("crc"), F.length("_t").cast("long").alias("n"))
    wider = _in_a_row(ids.withColumn("_w", part("_i", PART)), ["change_set", "seq", "_w"], ["_i"])
    seqs = _in_a_row(wider.withColumn("_s", part("seq", PART)), ["change_set", "_s"], ["seq", "_w"])
    return _in_a_row(seqs, ["change_set"], ["_s"]).select("change_set", "crc")


def valid_prefix(changes: DataFrame, ok: str = "crc_ok", sets: DataFrame | None = None) -> DataFrame:
    """Change sets before the first whose checksum is wrong. sets: (change_set, ok), a row a set, if the changes don't carry ok themselves."""
    bad = (changes if sets is None else sets).where(~F.col(ok)).agg(F.min("change_set").alias("_bad"))
    return changes.join(F.broadcast(bad), F.col("_bad").isNull() | (F.col("change_set") < F.col("_bad"))).drop("_bad")


def reconcile(state: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem): 'missing' tables that the manifest has and the folder lacks, 'orphan' files the other way round."""
    s, f = state.select("id", F.lit(1).alias("_s")).distinct(), files.select("id", F.lit(1).alias("_f")).distinct()
    j = s.join(f, "id", "full_outer").where(F.col("_s").isNull() | F.col("_f").isNull())
    return j.select("id", F.when(F.col("_f").isNull(), F.lit("missing")).otherwise(F.lit("orphan")).alias("problem"))


def file_ids(names: DataFrame, suffix: str = "run") -> DataFrame:
    """Ids out of file names such as 000012.run."""
    return names.select(F.regexp_extract("name", rf"(?:^|/)(\d+)\.{suffix}$", 1).alias("_i")).where("_i <> ''").select(F.col("_i").cast("long").alias("id"))
