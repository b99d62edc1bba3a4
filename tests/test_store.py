import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog import Store
from tidelog import schema as S
from tidelog.functions import expr
from tidelog.functions.expr import successor
from tidelog.operators import apply, compact, manifest, merge, prefix, scan, valuelog
from tidelog.sources import backup, log_codec, manifest_codec

OPS = "key string, cas bigint, meta int, user_meta int, cas_check bigint, value string"


def model(ops):
    state, status = {}, {}
    for key, cas, meta, um, check, value in sorted(ops, key=lambda o: o[1]):
        c, m, _, v = state.get(key, (0, 1, 0, None))
        if check and m & 1:
            s = S.NOT_FOUND
        elif check and c != check:
            s = S.CAS_MISMATCH
        elif meta == 8 and not m & 1 and not (m == 0 and not v):
            s = S.KEY_EXISTS
        else:
            s, state[key] = S.OK, (cas, meta, um, value)
        status[cas] = s
    return state, status


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_model(spark, seed):
    rng = random.Random(seed)
    ops = []
    for i in range(600):
        key = f"k{rng.choice([0, 0, 0, rng.randrange(20)])}"
        check = rng.choice([0, 0, 0, rng.randrange(1, i + 2)]) if rng.random() < 0.7 else max((o[1] for o in ops if o[0] == key), default=0)
        ops.append((key, i + 1, rng.choice([0, 0, 1, 8, 8]), i % 256, check, rng.choice(["", None, f"v{i}"])))
    df = spark.createDataFrame(ops, OPS)
    state, status = model(ops)
    assert {r.cas: r.status for r in apply.apply_status(df).collect()} == status
    assert {r.key: (r.cas, r.meta, r.user_meta, r.value) for r in apply.apply_ops(df).collect()} == state


def test_store_protocol(spark, tmp_path):
    with Store(spark, f"{tmp_path}/db") as db:
        assert db.view().count() == 0 and db.get(b"a") is None
        assert db.set(b"a", b"1", 10) == S.OK
        assert db.get(b"a")["user_meta"] == 10 and db.get(b"a")["cas"] == 1
        assert db.set_if_absent(b"a", b"2") == S.KEY_EXISTS
        assert db.compare_and_set(b"a", b"3", 99) == S.CAS_MISMATCH
        assert db.compare_and_set(b"a", b"3", 1) == S.OK
        assert db.get(b"a")["cas"] == 4  # failed ops take a counter too
        with pytest.raises(S.Locked):
            Store(spark, f"{tmp_path}/db")
        rows = [(i, bytearray(f"k{i:03}".encode()), bytearray(b"x" * 30), 0, 0, 0) for i in range(50)]
        batch = spark.createDataFrame([*rows, (50, bytearray(b"k"), bytearray(b"y" * 200), 0, 0, 0)], "ordinal long, key binary, value binary, meta int, user_meta int, cas_check long")
        db.max_value = 100
        out = {r.ordinal: r.status for r in db.put_batch(batch).collect()}
        assert out[50] == S.VALUE_TOO_BIG and out[0] == S.OK
        assert db.delete(b"a") == S.OK and db.get(b"a") is None
        assert [bytes(r.key) for r in db.scan(prefix=b"k00", reverse=True, limit=2).collect()] == [b"k009", b"k008"]
        db.compact()
        db.vacuum()
        assert db.view().count() == 50
        assert db.compare_and_delete(b"k001", db.get(b"k001")["cas"]) == S.OK
        db.backup(f"{tmp_path}/bak")
        assert backup.read_framed(spark, f"{tmp_path}/bak").count() == 49
    with Store(spark, f"{tmp_path}/db") as db:
        assert db.view().count() == 49 and db.get(b"k002")["value"] == b"x" * 30
        rows, blobs = db.separate()
        assert blobs.count() == 49 and valuelog.dereference(rows, blobs).where("meta & 1 = 0").count() == 49


def test_merge_precedence(spark):
    a, b, none = (spark.createDataFrame(r, "key string, value string") for r in ([("k1", "a1"), ("k2", "a2")], [("k1", "b1"), ("k3", "b3")], []))
    got = {r.key: r.value for r in merge.merge_runs([a, none, b]).collect()}
    assert got == {"k1": "a1", "k2": "a2", "k3": "b3"}


def test_small_pieces(spark):
    assert successor(b"a\xff") == b"b" and successor(b"\xff") is None
    framed = backup.frame(b"k" * 300, b"", 7)
    assert list(backup.unframe(framed + framed)) == [(b"k" * 300, b"", 7)] * 2
    with pytest.raises(S.InvalidRequest):
        valuelog.gc_candidates(None, 1.0)
    changes = spark.createDataFrame([(i, 0, i % 3, "CREATE", 1, i < 2) for i in range(3)], "change_set long, seq int, id long, op string, level int, crc_ok boolean")
    assert manifest.valid_prefix(changes).count() == 2
    assert manifest.as_changes(manifest.replay(changes)).count() == 3


def check(db, model):
    assert {bytes(r.key): bytes(r.value) for r in db.view().collect()} == model
    assert compact.violations(db.table_stats()).count() == 0


def test_levels(spark, tmp_path):
    """Flushes, moves, merges and reopening against a dict; tombstones go only at the bottom."""
    rng, model = random.Random(4), {}
    small = {"table_size": 500, "level_one": 1000, "l0_tables": 2, "value_threshold": 60, "manifest_deletes": 3, "manifest_ratio": 0}
    with Store(spark, f"{tmp_path}/db", **small) as db:
        for turn in range(4):
            rows = []
            for i in range(70):
                key, gone = f"k{rng.randrange(100):03}".encode(), rng.random() < 0.2
                value = f"{turn}-{i}".encode() * rng.choice((1, 5, 20))
                rows.append((i, bytearray(key), None if gone else bytearray(value), int(gone), 0, 0))
                model.pop(key, None) if gone else model.update({key: value})
            db.put_batch(spark.createDataFrame(rows, "ordinal long, key binary, value binary, meta int, user_meta int, cas_check long")).count()
            steps = db.compact_due()
            check(db, model)
        assert steps and {s for _, s in steps} <= {"merged", "moved"}
        assert len(db.manifest.of("table")) > 2 and any(e["level"] > 0 for e in db.manifest.of("table"))
        assert any(n.endswith(".snap") for n in db._files.names("manifest"))
        top = next(e for e in db.manifest.of("table") if e["level"] > 0)
        moved = Store.compact_level(db, top["level"])
        assert moved in ("merged", "moved")
        assert db.busy.add(0, b"a", b"z") and not db.busy.add(1, b"b", b"c") and db.compact_level(0) in ("busy", "nothing")
        db.busy.remove(0, b"a", b"z")
        tables = {e["path"] for e in db.manifest.of("table")}
        some = next(iter(model))
        assert db.get(some)["value"] == model[some] and db.get(b"k") is None
        series = {r.label: r.value for r in db.metrics().collect()}
        assert len(series) == 14 and series["num_puts"] == 280 and series["num_gets"] == 2 and series["lsm_size"] > 0 and series["vlog_size"] > 0
    with Store(spark, f"{tmp_path}/db", **small) as db:
        assert {e["path"] for e in db.manifest.of("table")} == tables
        check(db, model)
        db.compact()
        assert {e["level"] for e in db.manifest.of("table")} == {S.LEVELS - 1} and db.versions().count() == len(model)
        check(db, model)


def test_gc(spark, tmp_path):
    schema = "ordinal long, key binary, value binary, meta int, user_meta int, cas_check long"
    batch = lambda n, c: spark.createDataFrame([(i, bytearray(f"k{i:02}".encode()), bytearray(c * 100), 0, 0, 0) for i in range(n)], schema)
    with Store(spark, f"{tmp_path}/db") as db:
        db.put_batch(batch(10, b"a")).count()
        db.put_batch(batch(7, b"b")).count()
        before = {bytes(r.key): r.cas for r in db.view().collect()}
        with pytest.raises(S.InvalidRequest):
            db.gc(1.0)
        with pytest.raises(S.NoRewrite):
            db.gc(0.9, least=1)
        db._gc.acquire()
        with pytest.raises(S.Rejected):
            db.gc(0.5, least=1)
        db._gc.release()
        with db.reader() as view:
            assert db.gc(0.5, least=1) == 1
            db.vacuum()
            assert view.count() == 10  # its files are still there
        assert db.vacuum() > 0
        after = {bytes(r.key): (r.cas, bytes(r.value)) for r in db.view().collect()}
        assert {k: v for k, (_, v) in after.items()} == {f"k{i:02}".encode(): (b"b" if i < 7 else b"a") * 100 for i in range(10)}
        assert all(after[k][0] == before[k] if k < b"k07" else after[k][0] > before[k] for k in before)  # only what stood in the file has moved
        assert {e["id"] for e in db.manifest.of("log")} == {2, 3}
    with Store(spark, f"{tmp_path}/db") as db:
        assert db.view().count() == 10 and db.manifest.next_id("log") == 4


def test_manifest_files(spark, tmp_path):
    path = f"{tmp_path}/db"
    with Store(spark, path, value_threshold=1000) as db:
        for k in (b"a", b"b", b"c"):
            db.set(k, b"v")
        sets = sorted(n for n in db._files.names("manifest"))
        with pytest.raises(S.BadManifest):
            db.manifest._apply({"set": 9, "last_cas": 9, "applied": {}, "changes": [{"op": "DELETE", "kind": "table", "id": 77}]})
    last = f"{path}/manifest/{sets[-1]}"
    data = open(last, "rb").read()
    open(last, "wb").write(data.replace(b"CREATE", b"CREATF"))
    with Store(spark, path) as db:  # the damaged set never happened, its table goes
        assert db.manifest.truncated == sets[-1] and [bytes(r.key) for r in db.scan().collect()] == [b"a", b"b"]
        assert db.set(b"d", b"w") == S.OK and db.get(b"d")["cas"] == 3
        stale = db
        with Store(spark, path, takeover=True) as other:
            assert other.view().count() == 3
            with pytest.raises(S.StoreError):
                stale.set(b"e", b"x")
    with Store(spark, path) as db:
        files = db.manifest.of("table")
        db._files.delete(files[0]["path"])
    with pytest.raises(S.MissingFiles):
        Store(spark, path)
    with pytest.raises(S.MissingFiles):  # and it left no lock behind
        Store(spark, path)


def test_codecs():
    sets = [[(1, "CREATE", 0), (300, "DELETE", 2)], [(0, "CREATE", 6)]]
    data = manifest_codec.write(sets)
    assert [s for _, s in manifest_codec.read(data)] == sets
    cut = [at for at, _ in manifest_codec.read(data)]
    assert [s for _, s in manifest_codec.read(data[:-1])] == sets[:1] and cut[-1] == len(data)
    damaged = bytearray(data)
    damaged[cut[0] - 1] ^= 1
    assert list(manifest_codec.read(bytes(damaged))) == []
    with pytest.raises(S.BadManifest):
        list(manifest_codec.read(b"XXXX" + data[4:]))
    one, two = log_codec.encode(b"key", b"value", 1, 255, 9, 8), log_codec.encode(b"", b"", 0, 0, 1)
    assert list(log_codec.decode(one + two)) == [(0, b"key", b"value", 1, 255, 9, 8), (len(one), b"", b"", 0, 0, 1, 0)]
    assert len(one) == 8 + S.ENTRY_OVERHEAD and len(list(log_codec.decode(one + two[:-1]))) == 1
    with pytest.raises(S.InvalidRequest):
        backup.frame(b"k", b"v", 256)


def test_long_segment_and_odd_rows(spark):
    """A chain of comparing writes on one key is linear; null orders and keys keep their rows."""
    n = 20_000
    ops = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") + 1).alias("cas"), F.lit(0).alias("meta"), F.lit(0).alias("user_meta"), F.when(F.col("id") % 2 == 1, F.col("id")).otherwise(F.lit(0)).alias("cas_check"), F.lit("v").alias("value"))
    assert apply.apply_status(ops).where("status = 'OK'").count() == n
    rows = spark.createDataFrame([(None, 1), (5, 2), (7, 4)], "o long, v long")
    assert {(r.o, r.s) for r in prefix.running_sum(rows, F.col("v"), "o", "s").collect()} == {(None, 1), (5, 3), (7, 7)}
    heads = spark.createDataFrame([(f"https://example.org/{i:05}",) for i in range(300)], "key string")
    assert scan.bucket_of(heads)[0] == 22 and scan.bucket_of(heads.limit(0)) == (0, 1) and scan.bucket_of(heads.limit(1)) == (0, 1)
    got = {r.key: (r.prev_key, r.next_key) for r in scan.neighbours(heads).collect()}
    assert len(got) == 300 and got["https://example.org/00100"] == ("https://example.org/00099", "https://example.org/00101")
    keys = spark.createDataFrame([("x" * 100 + "a", "x" * 100 + "b"), ("", "a"), ("ab", "ab")], "a string, b string")
    assert [r.n for r in keys.select(expr.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [100, 0, 2]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_unmet_equals_pairs(spark, kind):
    """Many tables against many ranges, open and inverted ones too, without a join of all pairs."""
    rng = random.Random(5)
    key = lambda: None if rng.random() < 0.05 else (k := f"k{rng.choice(['', 'a', 'é', 'zz'])}{rng.randrange(400):03}") and (k if kind == "string" else bytearray(k.encode()))
    raw = lambda k: k if k is None or kind == "binary" else k.encode()
    some = lambda: sorted((key(), key()), key=lambda k: (raw(k) or b"", rng.random())) if rng.random() < 0.9 else [key(), key()]
    near = lambda: (p := some(), p if rng.random() < 0.2 or None in p else [p[0], p[0]])[1]
    for n in (0, 40):
        tables = [(i, 1 + (i >= 120), *near(), 1) for i in range(120 + n)] + [(998, 1, None, None, 1)]
        df = spark.createDataFrame(tables, f"id long, level int, smallest {kind}, biggest {kind}, size long")
        below = [(raw(a), raw(b)) for _, level, a, b, _ in tables if level == 2]
        meets = lambda lo, hi: any((lo is None and hi is None) or (None not in (lo, hi, a, b) and a <= hi and lo <= b) for a, b in below)  # noqa: E731, B023
        want = {i for i, level, lo, hi, _ in tables if level == 1 and not meets(raw(lo), raw(hi))}
        moved = compact.trivial_moves(df, 1)
        assert sorted((r.id, r.op, r.level) for r in moved.collect()) == sorted((i, op, level) for i in want for op, level in (("DELETE", 1), ("CREATE", 2)))
        assert (n == 0) == (len(want) == 121) and want
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin \w+, Inner", plan)


def test_wide_rows_are_dealt_over_tasks(spark):
    """Neither the log's running sum nor rows with inline values gather in one task."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in held}
    most = lambda df: max(r["count"] for r in df.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    value = F.concat(F.lit("v"), F.col("id").cast("string"))
    log = spark.range(50000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") + 1).alias("cas"), F.lit(0).alias("meta"), F.lit(0).alias("user_meta"), value.alias("value"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert most(valuelog.offsets(log)) < 30000
        rows, blobs = valuelog.separate(log, threshold=6)
        back = valuelog.dereference(rows, blobs)
        assert most(back) < 30000
        inline, _ = valuelog.separate(log, threshold=100)
        assert most(valuelog.dereference(inline, blobs)) < 30000
        assert back.exceptAll(log).count() == 0 and back.count() == 50000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_checksums_of_large_sets(spark):
    """The sums are those of the whole texts, and no list holds a whole set."""
    rng = random.Random(3)
    small = [(rng.randrange(4), rng.choice([0, 0, 5, 4095, 4096, 90000, None]), rng.choice([rng.randrange(60), rng.randrange(1 << 30), -7, None]), rng.choice(["CREATE", "DELETE"]), rng.choice([0, 3, None])) for _ in range(300)]
    large = [(9, 0, i, "CREATE", i % 7) for i in range(20000)]
    changes = spark.createDataFrame(small + large + [(8, i, i * 97, "DELETE", 1) for i in range(9000)] + [(7, 0, None, None, None)], "change_set long, seq int, id long, op string, level int").repartition(3)
    texts = {}
    first = lambda c: [(v is not None, v or 0) for v in c[1:3]]
    spell = lambda c: " ".join(str(v) for v in (c[3], c[2], c[4]) if v is not None)
    for c in sorted([tuple(r) for r in changes.collect()], key=lambda c: (first(c), spell(c))):
        texts.setdefault(c[0], []).append(spell(c))
    sums = manifest.checksums(changes)
    assert {r.change_set: r.crc for r in sums.collect()} == {k: zlib.crc32("\n".join(v).encode()) for k, v in texts.items()}
    # The lists of lines that the plan collects first are not those of whole sets.
    lines = sums._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[-1].split("]")[0]
    assert "change_set#" in lines and lines.count("#") == 3
