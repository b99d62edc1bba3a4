"""Continuous ingest: micro-batches into a store, and a stateful operator for conditional writes."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog import schema as S
from tidelog.operators.merge import latest_wins


def into_store(ops: DataFrame, store, checkpoint: str, ordinal: str = "ordinal") -> StreamingQuery:
    """Group commit: each micro-batch is one put_batch, known by the checkpoint and its number, so a batch that is retried after its commit is not applied twice."""

    def commit(batch: DataFrame, number: int) -> None:
        store.put_batch(batch.withColumn("ordinal", F.col(ordinal)), checkpoint, number)

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(log: DataFrame) -> DataFrame:
    """Newest version of each key, kept up by the state store; for outputMode('complete') or ('update')."""
    return latest_wins(log)


def apply_stream(ops: DataFrame) -> DataFrame:
    """Status of each op of a stream (key, cas, status); the state is one version a key. Ops of a key must come in order of cas over micro-batches; inside one they are sorted."""
    value = ops.schema["value"].dataType.simpleString()

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        cas, meta, size = state.get if state.exists else (0, 1, 0)
        rows = pd.concat(list(frames)).sort_values("cas")
        out = []
        for o in rows.itertuples():
            gone = meta & S.DELETE
            if o.cas_check and gone:
                status = S.NOT_FOUND
            elif o.cas_check and cas != o.cas_check:
                status = S.CAS_MISMATCH
            elif o.meta == S.SET_IF_ABSENT and not gone and not (meta == 0 and size == 0):
                status = S.KEY_EXISTS
            else:
                status, cas, meta, size = S.OK, int(o.cas), int(o.meta), len(o.value.encode() if isinstance(o.value, str) else o.value or b"")
            out.append((key[0], int(o.cas), status))
        state.update((cas, meta, size))
        yield pd.DataFrame(out, columns=["key", "cas", "status"])

    assert value in ("string", "binary")
    key = ops.schema["key"].dataType.simpleString()
    return ops.groupBy("key").applyInPandasWithState(step, f"key {key}, cas bigint, status string", "cas bigint, meta int, size int", "append", GroupStateTimeout.NoTimeout)
