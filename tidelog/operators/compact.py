"""Levels: statistics, choice of inputs, trivial moves, busy ranges, the merge itself, and its change set."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import expr
from tidelog.operators.merge import latest_wins
from tidelog.operators.prefix import running_sum
from tidelog.operators.scan import bucket_of


def level_stats(tables: DataFrame) -> DataFrame:
    """Per level: tables, bytes and key range. tables: (id, level, smallest, biggest, size)."""
    return tables.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").alias("bytes"), F.min("smallest").alias("smallest"), F.max("biggest").alias("biggest"))


def table_ids(tables: DataFrame) -> DataFrame:
    """(level, tables, ids): the ids of each level in order, a row a level."""
    return tables.groupBy("level").agg(F.count("*").alias("tables"), F.sort_array(F.collect_set("id")).alias("ids"))


def level_budget(level, level_one: int = S.LEVEL_ONE, factor: int = S.LEVEL_FACTOR):
    return F.lit(level_one) * F.pow(F.lit(float(factor)), level - 1)


def pick_levels(stats: DataFrame, l0: int = S.L0_TABLES, level_one: int = S.LEVEL_ONE, factor: int = S.LEVEL_FACTOR, levels: int = S.LEVELS, busy: DataFrame | None = None) -> DataFrame:
    """(level, score) of levels to compact, highest score first; the last level has nowhere to go. busy: (level, tables, bytes) already being compacted, which don't count; level 0 waits as a whole while any of it is busy."""
    if busy is not None:
        b = busy.select("level", F.col("tables").alias("_tables"), F.col("bytes").alias("_bytes"))
        stats = stats.join(b, "level", "left").withColumns({"bytes": F.col("bytes") - F.coalesce("_bytes", F.lit(0)), "tables": F.when((F.col("level") == 0) & (F.col("_tables") > 0), 0).otherwise(F.col("tables"))})
    score = F.when(F.col("level") == 0, F.col("tables") / F.lit(float(l0))).otherwise(F.col("bytes") / level_budget(F.col("level"), level_one, factor))
    return stats.where(F.col("level") < levels - 1).select("level", score.alias("score")).where("score >= 1").orderBy(F.col("score").desc(), "level")


def overlapping(tables: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, id): tables that meet each range; a range without ends meets all. Only table statistics take part, a row a table; ranges are few."""
    t, r = tables.alias("t"), ranges.alias("r")
    endless = F.col("r.left").isNull() & F.col("r.right").isNull()
    return t.join(r, expr.overlaps(F.col("t.smallest"), F.col("t.biggest"), F.col("r.left"), F.col("r.right"), endless)).select(F.col("r.range_id").alias("range_id"), F.col("t.id").alias("id"))


def violations(tables: DataFrame) -> DataFrame:
    """Tables of levels above 0 whose range reaches into the next one's."""
    w = Window.partitionBy("level").orderBy("smallest", "id")
    return tables.where("level > 0").withColumn("before", F.max("biggest").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before >= smallest").select("level", "id")


def in_order(tables: DataFrame, by: str) -> DataFrame:
    """Tables in the order that a level keeps them in: by 'smallest', 'biggest', 'id', or 'size' (largest first); ties by id."""
    return tables.orderBy(F.col(by).desc() if by == "size" else F.col(by), "id")


def _span(tables: DataFrame) -> DataFrame:
    return tables.agg(F.lit(0).alias("range_id"), F.min("smallest").alias("left"), F.max("biggest").alias("right")).where("left IS NOT NULL")


def choose_inputs(tables: DataFrame, level: int, busy: DataFrame | None = None) -> DataFrame:
    """(id, side): for level 0 all its tables, else its largest one that meets no busy range, and the tables of the next level that they meet. busy: (range_id, left, right), of this level or the next."""
    top = tables.where(F.col("level") == level)
    if busy is not None:
        taken = overlapping(tables.where(F.col("level").isin(level, level + 1)), busy).select("id").distinct()
        top = top.join(taken, "id", "left_anti")
    top = top if level == 0 else in_order(top, "size").limit(1)
    below = overlapping(tables.where(F.col("level") == level + 1), _span(top))
    return top.select("id", F.lit("top").alias("side")).unionByName(below.select("id", F.lit("bottom").alias("side")))


def unmet(ranges: DataFrame, tables: DataFrame) -> DataFrame:
    """The (range_id, left, right) ranges that meet none of the tables, many of both; a range without ends meets any table.

    A range meets a table if the furthest end of those that start up to its right end reaches its left end. So it takes a running maximum in key order instead of pairs, inside buckets of one key prefix; what earlier buckets hold comes from their maxima.
    """
    t = tables.select(F.col("smallest").alias("_k"), F.lit(0).alias("_o"), F.col("biggest").alias("_far"), F.lit(False).alias("_is"))
    r = ranges.where("left IS NOT NULL AND right IS NOT NULL").select(F.col("right").alias("_k"), F.lit(1).alias("_o"), F.lit(True).alias("_is"), "range_id", "left", "right")
    both = r.unionByName(t.where("_k IS NOT NULL AND _far IS NOT NULL"), allowMissingColumns=True)
    head, width = bucket_of(both, "_k")
    both = both.withColumn("_b", F.substring("_k", 1, head + width))
    upto = Window.partitionBy("_b").orderBy("_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_reach", F.max("_far").over(upto)).where("_is")
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("_b").agg(F.max("_far").alias("_e")).select("_b", F.max("_e").over(earlier).alias("_before"))
    clear = inside.join(ends, "_b").where(~F.coalesce(F.greatest("_reach", "_before") >= F.col("left"), F.lit(False)))
    endless = F.col("left").isNull() & F.col("right").isNull()
    open_ended = ranges.where("left IS NULL OR right IS NULL").join(F.broadcast(tables.select(F.lit(True).alias("_any")).limit(1)), endless, "left_anti")
    return clear.select("range_id", "left", "right").unionByName(open_ended.select("range_id", "left", "right"))


def trivial_moves(tables: DataFrame, level: int) -> DataFrame:
    """Changes (id, op, level) that move the tables of a level which meet nothing in the next one, without touching their rows."""
    ranges = tables.where(F.col("level") == level).select(F.col("id").alias("range_id"), F.col("smallest").alias("left"), F.col("biggest").alias("right"))
    free = unmet(ranges, tables.where(F.col("level") == level + 1)).select(F.col("range_id").alias("id"))
    return free.select("id", F.lit("DELETE").alias("op"), F.lit(level).alias("level")).unionByName(free.select("id", F.lit("CREATE").alias("op"), F.lit(level + 1).alias("level")))


def split_by_size(rows: DataFrame, order: str, size, most: int) -> DataFrame:
    """(part, rows, bytes, first, last): rows in the order of an integer column cut into tables; a table ends with the row that fills it."""
    cut = running_sum(rows.withColumn("_size", size), F.col("_size"), order, "_end")
    part = F.floor((F.col("_end") - F.col("_size")) / most).cast("long")
    return cut.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes"), F.min(order).alias("first"), F.max(order).alias("last"))


def compact(versions: DataFrame, drop_tombstones: bool = False, by: str = "cas", partitions: int | None = None) -> DataFrame:
    """Merged, range-partitioned and sorted rows, ready to be written as one level's files. Range partitioning samples its input, so give rows that are cheap to read twice."""
    out = latest_wins(versions, by=by)
    out = out.where(expr.live()) if drop_tombstones else out
    ranged = out.repartitionByRange(partitions, "key") if partitions else out.repartitionByRange("key")
    return ranged.sortWithinPartitions("key")


def change_set(inputs: DataFrame, outputs: DataFrame, level: int) -> DataFrame:
    """(id, op, level): CREATE of the outputs in the next level, DELETE of the inputs (id, side) where they stand."""
    made = outputs.select("id", F.lit("CREATE").alias("op"), F.lit(level + 1).alias("level"))
    return made.unionByName(inputs.select("id", F.lit("DELETE").alias("op"), F.when(F.col("side") == "top", level).otherwise(level + 1).alias("level")))


def replaced(tables: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, level) of the tables after a change set (id, op, level): deleted ones go, created ones stand where the set puts them."""
    gone = changes.where("op = 'DELETE'").select("id", "level")
    return tables.select("id", "level").join(gone, ["id", "level"], "left_anti").unionByName(changes.where("op = 'CREATE'").select("id", "level"))


class Busy:
    """Key ranges that compactions of this process work on, by level; a range that meets one of them is refused."""

    def __init__(self):
        self._lock, self._held = threading.Lock(), []

    def add(self, level: int, left: bytes, right: bytes) -> bool:
        """Takes the range in its level and in the next, unless one of them is taken."""
        with self._lock:
            if any(abs(level - n) <= 1 and left <= b and a <= right for n, a, b in self._held):
                return False
            self._held.append((level, left, right))
            return True

    def remove(self, level: int, left: bytes, right: bytes) -> None:
        with self._lock:
            self._held.remove((level, left, right))

    def ranges(self, level: int) -> list[tuple[bytes, bytes]]:
        """What is taken at a level, by compactions out of it or into it."""
        with self._lock:
            return [(a, b) for n, a, b in self._held if n in (level, level - 1)]
