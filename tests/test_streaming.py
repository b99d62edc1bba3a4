from pyspark.sql import functions as F

from tidelog import Store
from tidelog.operators import apply
from tidelog.sources import tables
from tidelog.streaming import ingest


def test_stream_equals_batch(spark, sf, tmp_path):
    ops = tables.oplog(spark, sf)
    ops.coalesce(1).write.parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/ops")
    q = ingest.apply_stream(stream).writeStream.format("memory").queryName("st").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = apply.apply_status(ops)
    assert sorted(map(tuple, spark.table("st").collect())) == sorted(map(tuple, want.collect()))


def test_group_commit(spark, sf, tmp_path):
    ops = tables.oplog(spark, sf).where("cas_check = 0").select(F.col("cas").alias("ordinal"), "key", "value", "meta", "user_meta", "cas_check")
    ops.coalesce(1).write.parquet(f"{tmp_path}/ops")
    with Store(spark, f"{tmp_path}/db") as db:
        q = ingest.into_store(spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/ops"), db, f"{tmp_path}/cp")
        q.awaitTermination(120)
        assert db.view().count() > 0 and db.manifest.last_cas == ops.count()
        again = db.put_batch(ops, f"{tmp_path}/cp", 0)  # the same batch once more: answered, not applied
        assert again.count() == ops.count() and db.manifest.last_cas == ops.count()
