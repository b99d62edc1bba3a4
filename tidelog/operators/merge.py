"""Latest-wins merging of versions and runs."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import expr


def latest_wins(log: DataFrame, keys: tuple[str, ...] = ("key",), by: str = "cas", newest_is_max: bool = True) -> DataFrame:
    """One row a key: the one with the largest (or smallest) value of by. Combines map-side, so a hot key costs one row a task."""
    rest = [c for c in log.columns if c not in keys]
    pick = F.max_by if newest_is_max else F.min_by
    return log.groupBy(*keys).agg(pick(F.struct(*rest), F.col(by)).alias("_r")).select(*keys, "_r.*")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """k-way merge: of equal keys the one from the first run in the list stays. Tombstones stay."""
    ranked = [r.withColumn("rank", F.lit(i)) for i, r in enumerate(runs)]
    return latest_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), by="rank", newest_is_max=False)


def live_view(log: DataFrame, by: str = "cas") -> DataFrame:
    """What a reader sees: the newest version of each key, without tombstones and reserved keys."""
    return latest_wins(log.where(expr.user_key()), by=by).where(expr.live())


def count_versions(runs: list[DataFrame]) -> DataFrame:
    """Versions over all runs, duplicates included."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs).agg(F.count("*").alias("versions"))
