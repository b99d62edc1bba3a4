"""Conditional writes: an ordered fold per key, cut where the state is forgotten.

An unconditional write always succeeds, whatever came before. So the history of a key splits at each of them into
segments that fold independently, over as many tasks as there are; within a task a segment streams, it is never held.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import expr
from tidelog.operators.prefix import running_sum


def allocate_cas(batch: DataFrame, ordinal: str = "ordinal", base: int = 0) -> DataFrame:
    """Adds cas = base + 1, base + 2 ... in the order of ordinal."""
    from tidelog.operators.prefix import dense_rank_by_chunks

    return dense_rank_by_chunks(batch, ordinal, "cas", base)


def validate(batch: DataFrame, max_value: int = S.MAX_VALUE) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with status). Keys and values over the limits, reserved or null keys and user metas outside of a byte are rejected and take no counter."""
    odd = ~F.coalesce(F.col("user_meta").between(0, S.MAX_USER_META), F.lit(False)) if "user_meta" in batch.columns else F.lit(False)
    bad = F.when(F.col("key").isNull() | ~expr.user_key() | odd, F.lit(S.INVALID)).otherwise(expr.validation(max_value=max_value))
    checked = batch.withColumn("status", bad)
    return checked.where(F.col("status") == S.OK).drop("status"), checked.where(F.col("status") != S.OK)


def _segments(ops: DataFrame) -> DataFrame:
    free = (F.col("cas_check") == 0) & (F.col("meta") != S.SET_IF_ABSENT)
    return running_sum(ops, free.cast("long"), "cas", "_seg", keys=("key",))


def fold(state: tuple[int, int, bool], cas: int, check: int, meta: int, empty: bool) -> tuple[str, tuple[int, int, bool]]:
    """(status, new state) of an op on the state (cas, meta, whether the value is empty) of its key."""
    now, flags, blank = state
    gone = flags & S.DELETE
    if check and gone:
        return S.NOT_FOUND, state
    if check and now != check:
        return S.CAS_MISMATCH, state
    if meta == S.SET_IF_ABSENT and not gone and not (flags == 0 and blank):
        return S.KEY_EXISTS, state
    return S.OK, (cas, meta, empty)


#: The state of a key that has never been written.
ABSENT = (0, S.DELETE, True)


def _folded(ops: DataFrame, view: DataFrame | None, carry: tuple[str, ...]) -> DataFrame:
    """(key, cas, status, *carry) of every op. Segments are dealt over tasks and stream through them in order of cas; what a task holds is a batch of rows and one state, however long a segment is. Values stay outside of Python but for carry."""
    rows = _segments(ops).select("key", "_seg", F.lit(True).alias("_op"), "cas", "cas_check", F.col("meta").alias("_meta"), (F.coalesce(F.octet_length("value"), F.lit(0)) == 0).alias("_empty"), *carry)
    if view is not None:
        was = view.join(ops.select("key").distinct(), "key", "left_semi")
        was = was.select("key", F.lit(0).cast("long").alias("_seg"), F.lit(False).alias("_op"), "cas", F.lit(0).cast("long").alias("cas_check"), F.col("meta").alias("_meta"), (F.coalesce(F.octet_length("value"), F.lit(0)) == 0).alias("_empty"), *(F.lit(None).cast(ops.schema[c].dataType).alias(c) for c in carry))
        rows = rows.unionByName(was)
    rows = rows.repartition("key", "_seg").sortWithinPartitions("key", "_seg", "_op", "cas")

    def run(batches):
        import pyarrow as pa

        segment, state = None, ABSENT
        for b in batches:
            status = []
            cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "_seg", "_op", "cas", "cas_check", "_meta", "_empty"))
            for key, seg, op, cas, check, meta, empty in zip(*cols, strict=True):
                if (key, seg) != segment:
                    segment, state = (key, seg), ABSENT
                if op:
                    s, state = fold(state, cas, check, meta, empty)
                    status.append(s)
                else:
                    state = (cas, meta, empty)
                    status.append(None)
            out = {c: b.column(b.schema.get_field_index(c)) for c in ("key", "cas", *carry)}
            yield pa.RecordBatch.from_pydict(out | {"status": pa.array(status, pa.string())})

    fields = [f"`{c}` {ops.schema[c].dataType.simpleString()}" for c in ("key", "cas", *carry)]
    return rows.mapInArrow(run, ", ".join([*fields, "status string"])).where("status IS NOT NULL")


def apply_ops(ops: DataFrame, view: DataFrame | None = None) -> DataFrame:
    """State of each key after the ops (key, cas, meta, user_meta, value), tombstones included: its last op that succeeded. Keys whose every op failed are left out."""
    done = _folded(ops, view, ("meta", "user_meta", "value"))
    last = done.where(F.col("status") == S.OK).groupBy("key").agg(F.max_by(F.struct("cas", "meta", "user_meta", "value"), "cas").alias("_e"))
    return last.select("key", "_e.*")


def apply_status(ops: DataFrame, view: DataFrame | None = None) -> DataFrame:
    """(key, cas, status) of every op."""
    return _folded(ops, view, ()).select("key", "cas", "status")


def upsert_only(ops: DataFrame) -> DataFrame:
    """Shortcut for batches without conditions: the newest op of a key is its state."""
    from tidelog.operators.merge import latest_wins

    return latest_wins(ops)
