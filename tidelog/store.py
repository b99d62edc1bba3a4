"""The store: sorted tables on levels, a value log, and a manifest of numbered change sets, all in Parquet.

Files are written first, the change set that names them last, by the rename of a finished file; readers go by the sets. Each set
carries its checksum; opening replays them up to the first damaged one, puts a snapshot in their place when deletions prevail, and
compares the folder with what they say. Paths go through Spark's own file systems, so a store may live wherever Spark can write.
The driver holds table and log statistics only: a row a table.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import expr
from tidelog.operators import apply, compact, manifest, merge, scan, stats, valuelog
from tidelog.sources import backup

#: Parquet options of tables: point reads skip row groups by key, by range and by Bloom filter.
TABLE_OPTIONS = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.fpp#key": "0.01"}
#: Seconds after which a reader that never left no longer holds files back.
LEASE = 86_400


class _Files:
    """The few calls that Hadoop's file system has and DataFrames lack; driver only, metadata only."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def size(self, name: str) -> int:
        p = self._path(name)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def create(self, name: str, data: bytes) -> bool:
        """False if the file exists."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def read(self, name: str) -> bytes:
        """The whole file; nothing if the file system itself finds it damaged."""
        src = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(src))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "ChecksumException":
                raise
            return b""
        finally:
            src.close()

    def age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def rename(self, a: str, b: str) -> bool:
        return not self._fs.exists(self._path(b)) and self._fs.rename(self._path(a), self._path(b))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class _Manifest:
    """Change sets on disk: NNN.set holds {set, last_cas, applied, changes}, NNN.snap the net state; a line of CRC-32 follows."""

    FORMAT = 2

    def __init__(self, files: _Files, deletes: int, ratio: int):
        self._files, self.deletes, self.ratio = files, deletes, ratio
        self.entries: dict[tuple[str, int], dict] = {}
        self.number, self.last_cas, self.applied, self.truncated = 0, 0, {}, None
        self._created = self._deleted = 0
        names = files.names("manifest")
        snaps = [n for n in names if n.endswith(".snap")]
        start = int(snaps[-1].split(".")[0]) if snaps else 0
        for name in ([snaps[-1]] if snaps else []) + [n for n in names if n.endswith(".set") and int(n.split(".")[0]) > start]:
            found = self._checked(files.read(f"manifest/{name}"))
            if found is None or found["set"] != (start if name.endswith(".snap") else self.number + 1):
                self.truncated = name
                break
            if found.get("format") != self.FORMAT:
                raise S.BadManifest(name)
            self._apply(found)
        for name in names:  # what follows the first damaged set never happened
            if self.truncated and name.endswith(".set") and int(name.split(".")[0]) > self.number or name.startswith("tmp-"):
                files.delete(f"manifest/{name}")

    @staticmethod
    def _checked(data: bytes) -> dict | None:
        body, _, crc = data.rpartition(b"\n")
        return json.loads(body) if crc == f"{zlib.crc32(body):08x}".encode() else None

    def _apply(self, found: dict) -> None:
        for c in found["changes"]:
            at = (c["kind"], c["id"])
            if c["op"] == "CREATE":
                if at in self.entries:
                    raise S.BadManifest(f"{at} is created twice")
                self.entries[at] = c
                self._created += 1
            else:
                if self.entries.pop(at, None) is None:
                    raise S.BadManifest(f"{at} is deleted but doesn't exist")
                self._deleted += 1
        self.number, self.last_cas, self.applied = found["set"], found["last_cas"], found["applied"]

    def _write(self, name: str, found: dict) -> None:
        data = json.dumps(found).encode()
        temp = f"manifest/tmp-{uuid.uuid4().hex}"
        self._files.create(temp, data + f"\n{zlib.crc32(data):08x}".encode())
        if not self._files.rename(temp, f"manifest/{name}"):
            raise S.StoreError(f"{name} exists: another writer was here")

    def append(self, changes: list[dict], last_cas: int, applied: dict) -> None:
        found = {"format": self.FORMAT, "set": self.number + 1, "last_cas": last_cas, "applied": applied, "changes": changes}
        self._write(f"{found['set']:012d}.set", found)
        self._apply(found)
        if self._deleted > self.deletes and self._deleted > self.ratio * (self._created - self._deleted):
            self.rewrite()

    def rewrite(self) -> None:
        """A snapshot of the net state in place of all sets."""
        net = [e | {"op": "CREATE"} for _, e in sorted(self.entries.items())]
        self._write(f"{self.number:012d}.snap", {"format": self.FORMAT, "set": self.number, "last_cas": self.last_cas, "applied": self.applied, "changes": net})
        for name in self._files.names("manifest"):
            if not name.startswith("tmp-") and (int(name.split(".")[0]) < self.number or name == f"{self.number:012d}.set"):
                self._files.delete(f"manifest/{name}")
        self._created, self._deleted = len(net), 0

    def of(self, kind: str) -> list[dict]:
        return [e for (k, _), e in sorted(self.entries.items()) if k == kind]

    def next_id(self, kind: str) -> int:
        return max([e["id"] for e in self.of(kind)] + [self.applied.get(f"last_{kind}", 0)]) + 1


class Store:
    """Handle on a folder. One writing handle at a time (takeover=True replaces the lock of one that crashed; that one can't publish any more). DataFrames it returns read the files of the moment: keep them inside reader() while gc() and vacuum() run."""

    def __init__(
        self, spark: SparkSession, path: str, value_threshold: int = S.VALUE_THRESHOLD, max_value: int = S.MAX_VALUE, table_size: int = S.TABLE_SIZE, level_one: int = S.LEVEL_ONE,
        l0_tables: int = S.L0_TABLES, log_file: int = S.LOG_FILE, manifest_deletes: int = S.MANIFEST_DELETES, manifest_ratio: int = S.MANIFEST_RATIO, takeover: bool = False,
    ):
        self.spark, self.path, self.threshold, self.max_value = spark, path.rstrip("/"), value_threshold, max_value
        self.table_size, self.level_one, self.l0_tables, self.log_file = table_size, level_one, l0_tables, log_file
        self._files, self._token = _Files(spark, path), uuid.uuid4().hex.encode()
        if takeover:
            self._files.delete("LOCK")
        if not self._files.create("LOCK", self._token):
            raise S.Locked(path)
        self.busy, self._gc, self._publishing = compact.Busy(), threading.Lock(), threading.RLock()
        self.counters = dict.fromkeys(stats.SERIES, 0)
        try:
            self.manifest = _Manifest(self._files, manifest_deletes, manifest_ratio)
            self._reconcile()
        except Exception:
            self.close()
            raise

    # manifest
    def _reconcile(self) -> None:
        """Files the manifest names must be there; files it doesn't name go, unless a reader may use them."""
        known = {e["path"] for e in self.manifest.entries.values()}
        there = {f"{top}/{part}/{name}" for top in ("tables", "vlog") for part in self._files.names(top) for name in self._files.names(f"{top}/{part}") if "=" in name}
        if lost := sorted(known - there):
            raise S.MissingFiles(", ".join(lost[:5]))
        self.vacuum()

    def _publish(self, changes: list[dict], last_cas: int | None = None, **applied) -> None:
        with self._publishing:
            if self._files.read("LOCK") != self._token:
                raise S.StoreError("another handle has taken over")
            kept = self.manifest.applied | applied | {f"last_{k}": self.manifest.next_id(k) - 1 for k in ("table", "log")}
            made = [c for c in changes if c["op"] == "CREATE"]
            for k in ("table", "log"):
                kept[f"last_{k}"] = max([kept[f"last_{k}"], *(c["id"] for c in made if c["kind"] == k)])
            self.manifest.append(changes, self.manifest.last_cas if last_cas is None else last_cas, kept)

    def table_stats(self) -> DataFrame:
        """(id, level, smallest, biggest, size, rows) of the tables."""
        rows = [(e["id"], e["level"], bytearray.fromhex(e["smallest"]), bytearray.fromhex(e["biggest"]), e["size"], e["rows"]) for e in self.manifest.of("table")]
        return self.spark.createDataFrame(rows, "id long, level int, smallest binary, biggest binary, size long, rows long")

    # writing
    def _write_tables(self, rows: DataFrame, level: int) -> list[dict]:
        """Rows (S.STORED, read twice, so give what is on disk) as sorted tables of about table_size bytes; returns their creations."""
        size = expr.size_of("key") + expr.size_of("value") + S.ROW_HEADER
        total = rows.agg(F.sum(size)).first()[0]
        if not total:
            return []
        n, base, part = -(-total // self.table_size), self.manifest.next_id("table"), f"tables/{uuid.uuid4().hex}"
        cut = rows.repartitionByRange(n, "key").withColumn("id", F.spark_partition_id() + F.lit(base))
        cut.sortWithinPartitions("id", "key").write.partitionBy("id").options(**TABLE_OPTIONS).parquet(f"{self.path}/{part}")
        made = self.spark.read.parquet(f"{self.path}/{part}").groupBy("id").agg(F.count("*").alias("rows"), F.sum(size).alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        out = [{"op": "CREATE", "kind": "table", "id": r["id"], "level": level, "path": f"{part}/id={r['id']}", "rows": r["rows"], "size": r["size"], "smallest": bytes(r["lo"]).hex(), "biggest": bytes(r["hi"]).hex()} for r in made.collect()]
        self.counters["num_writes"] += len(out)
        self.counters["num_bytes_written"] += sum(e["size"] for e in out)
        return out

    def _write_log(self, entries: DataFrame) -> tuple[DataFrame, list[dict]]:
        """Appends entries (key, cas, meta, user_meta, value) to new files of the value log, rotated by size; returns them with their places, and the files' creations."""
        part = f"vlog/{uuid.uuid4().hex}"
        placed = valuelog.offsets(entries, self.log_file, self.manifest.next_id("log"))
        placed.write.partitionBy("fid").parquet(f"{self.path}/{part}")
        back = self.spark.read.schema(S.ENTRY).parquet(f"{self.path}/{part}")
        made = [{"op": "CREATE", "kind": "log", "id": r["fid"], "path": f"{part}/fid={r['fid']}", "rows": r["n"], "size": r["size"]} for r in back.groupBy("fid").agg(F.count("*").alias("n"), F.sum("len").alias("size")).collect()]
        self.counters["num_bytes_written"] += sum(e["size"] for e in made)
        return back, made

    def put_batch(self, batch: DataFrame, source: str | None = None, batch_id: int | None = None) -> DataFrame:
        """Applies rows (ordinal long, key, value binary, meta int, user_meta int, cas_check long) in the order of ordinal; returns (ordinal, cas, status), a row for each. A batch of a source with the batch_id applied last is not applied again; its answer is."""
        if source is not None and (last := self.manifest.applied.get(f"batch_{source}")) and last[0] == batch_id:
            return self.spark.read.parquet(f"{self.path}/{last[1]}/answer")
        batch = batch.select(F.col("ordinal").cast("long"), F.col("key").cast("binary"), F.col("value").cast("binary"), F.col("meta").cast("int"), F.col("user_meta").cast("int"), F.col("cas_check").cast("long"))
        good, bad = apply.validate(batch, self.max_value)
        return self._commit(good, bad, source, batch_id)

    def _commit(self, good: DataFrame, bad: DataFrame | None, source: str | None = None, batch_id: int | None = None, extra: list[dict] = ()) -> DataFrame:
        part = f"batch/{uuid.uuid4().hex}"
        read = lambda name: self.spark.read.parquet(f"{self.path}/{part}/{name}")
        apply.allocate_cas(good, base=self.manifest.last_cas).write.parquet(f"{self.path}/{part}/ops")
        ops = read("ops")
        lo, hi, last, puts = ops.agg(F.min("key"), F.max("key"), F.max("cas"), F.count("*")).first()
        touched = self.versions(None if lo is None else (bytes(lo), bytes(hi)), values=False).join(ops.select("key").distinct(), "key", "left_semi")
        apply.apply_status(ops, touched.withColumn("value", F.coalesce("value", F.when(F.col("fid").isNotNull(), F.lit(b"x"))))).write.parquet(f"{self.path}/{part}/status")
        status = read("status")
        answer = ops.join(status, ["key", "cas"]).select("ordinal", "cas", "status")
        answer = answer if bad is None else answer.unionByName(bad.select("ordinal", F.lit(None).cast("long").alias("cas"), "status"))
        answer.write.parquet(f"{self.path}/{part}/answer")
        won = ops.join(status.where(F.col("status") == S.OK).select("cas"), "cas", "left_semi")
        merge.latest_wins(won.select("key", "cas", "meta", "user_meta", "value")).write.parquet(f"{self.path}/{part}/rows")
        rows = read("rows")
        big = (expr.size_of("value") >= self.threshold) & expr.live()
        places, logs = self._write_log(rows.where(big))
        there = places.select("key", "cas", F.col("meta").bitwiseOR(S.POINTER).alias("meta"), "user_meta", F.lit(None).cast("binary").alias("value"), "fid", "offset", "len")
        kept = rows.where(~big).select("*", *(F.lit(None).cast("long").alias(c) for c in ("fid", "offset", "len")))
        tables = self._write_tables(kept.unionByName(there), 0)
        done = {f"batch_{source}": [batch_id, part]} if source is not None else {}
        self._publish([*tables, *logs, *extra], last or self.manifest.last_cas, **done)
        self.counters["num_puts"] += puts
        return read("answer")

    def _one(self, key: bytes, value: bytes | None, meta: int, user_meta: int = 0, check: int = 0) -> str:
        row = self.spark.createDataFrame([(1, bytearray(key), None if value is None else bytearray(value), meta, user_meta, check)], "ordinal long, key binary, value binary, meta int, user_meta int, cas_check long")
        return self.put_batch(row).first()["status"]

    def set(self, key: bytes, value: bytes, user_meta: int = 0) -> str:
        return self._one(key, value, 0, user_meta)

    def set_if_absent(self, key: bytes, value: bytes, user_meta: int = 0) -> str:
        return self._one(key, value, S.SET_IF_ABSENT, user_meta)

    def compare_and_set(self, key: bytes, value: bytes, cas: int) -> str:
        return self._one(key, value, 0, 0, cas)

    def delete(self, key: bytes) -> str:
        return self._one(key, None, S.DELETE)

    def compare_and_delete(self, key: bytes, cas: int) -> str:
        return self._one(key, None, S.DELETE, 0, cas)

    # reading
    def _read_tables(self, entries: list[dict]) -> DataFrame:
        self.counters["num_reads"] += len(entries)
        self.counters["num_bytes_read"] += sum(e["size"] for e in entries)
        if not entries:
            return self.spark.createDataFrame([], S.STORED)
        return self.spark.read.schema(S.STORED).parquet(*(f"{self.path}/{e['path']}" for e in entries))

    def log_entries(self) -> DataFrame:
        """All entries of the value log, garbage included (S.ENTRY)."""
        logs = self.manifest.of("log")
        if not logs:
            return self.spark.createDataFrame([], S.ENTRY)
        found = [self.spark.read.parquet(f"{self.path}/{e['path']}").withColumn("fid", F.lit(e["id"]).cast("long")).select(*S.ENTRY.names) for e in logs] if len(logs) <= 8 else None
        if found:
            out = found[0]
            for f in found[1:]:
                out = out.unionByName(f)
            return out
        parts = sorted({e["path"].rsplit("/", 1)[0] for e in logs})
        every = [self.spark.read.schema(S.ENTRY).option("basePath", f"{self.path}/{p}").parquet(*(f"{self.path}/{e['path']}" for e in logs if e["path"].startswith(p + "/"))) for p in parts]
        out = every[0]
        for f in every[1:]:
            out = out.unionByName(f)
        return out

    def versions(self, span: tuple[bytes, bytes] | None = None, values: bool = True) -> DataFrame:
        """The newest version of each key, tombstones included; of keys between both of span only tables that may hold them are read. values=False leaves values in the log where they are, with their places."""
        tables = self.manifest.of("table")
        if span:
            met = [e for e in tables if e["smallest"] <= span[1].hex() and span[0].hex() <= e["biggest"]]
            self.counters["num_lsm_bloom_hits"] += len(tables) - len(met)
            tables = met
        rows = self._read_tables(tables)
        if span:
            rows = rows.where((F.col("key") >= F.lit(bytearray(span[0]))) & (F.col("key") <= F.lit(bytearray(span[1]))))
        newest = merge.latest_wins(rows)
        if not values:
            return newest
        return valuelog.dereference(newest, self.log_entries()) if self.manifest.of("log") else newest.select(*S.ROW.names)

    def view(self, values: bool = True) -> DataFrame:
        return self.versions(values=values).where(expr.live() & expr.user_key())

    def get(self, key: bytes) -> dict | None:
        self.counters["num_gets"] += 1
        self.counters["num_lsm_gets"] += sum(e["smallest"] <= key.hex() <= e["biggest"] for e in self.manifest.of("table"))
        row = self.versions((key, key), values=False).where(expr.live() & expr.user_key()).first()
        if row is None:
            return None
        found = row.asDict()
        fid, offset, _ = (found.pop(c) for c in ("fid", "offset", "len"))
        if fid is not None:
            log = self.manifest.entries["log", fid]
            found["value"] = self.spark.read.parquet(f"{self.path}/{log['path']}").where(F.col("offset") == offset).select("value").first()["value"]
            found["meta"] &= ~S.POINTER
        return found

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return scan.multi_get(self.view(), keys)

    def exists(self, keys: DataFrame) -> DataFrame:
        """Values stay where they are: what is in the log isn't empty."""
        return scan.exists(self.view(values=False), keys)

    def scan(self, keys_only: bool = False, **how) -> DataFrame:
        return scan.scan(self.view(values=not keys_only), keys_only=keys_only, **how)

    @contextmanager
    def reader(self) -> Iterator[DataFrame]:
        """The view, whose files stay until the reader leaves."""
        name = f"readers/{uuid.uuid4().hex}"
        self._files.create(name, json.dumps(sorted(e["path"] for e in self.manifest.entries.values())).encode())
        try:
            yield self.view()
        finally:
            self._files.delete(name)

    # upkeep
    def _merge(self, top: list[dict], bottom: list[dict], level: int) -> None:
        """Merges tables into the next level. Tombstones go where nothing deeper can hold their keys."""
        inputs = top + bottom
        lo, hi = min(e["smallest"] for e in inputs), max(e["biggest"] for e in inputs)
        deeper = any(e["level"] > level + 1 and e["smallest"] <= hi and lo <= e["biggest"] for e in self.manifest.of("table"))
        part = f"merge/{uuid.uuid4().hex}"
        rows = merge.latest_wins(self._read_tables(inputs))
        (rows if deeper else rows.where(expr.live())).write.parquet(f"{self.path}/{part}")
        made = self._write_tables(self.spark.read.schema(S.STORED).parquet(f"{self.path}/{part}"), level + 1)
        self._publish([*({"op": "DELETE", "kind": "table", "id": e["id"]} for e in inputs), *made])
        self._files.delete(part)

    def compact_level(self, level: int) -> str:
        """One step: 'moved' if the chosen tables meet nothing below (only the manifest changes), 'merged', 'busy' if their range is being compacted, 'nothing' if the level is empty."""
        by_id = {e["id"]: e for e in self.manifest.of("table")}
        held = [(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(self.busy.ranges(level))]
        busy = self.spark.createDataFrame(held, "range_id int, left binary, right binary") if held else None
        chosen = compact.choose_inputs(self.table_stats(), level, busy).collect()
        top, bottom = ([by_id[r["id"]] for r in chosen if r["side"] == side] for side in ("top", "bottom"))
        if not top:
            return "busy" if busy else "nothing"
        span = tuple(bytes.fromhex(f(e[c] for e in top + bottom)) for f, c in ((min, "smallest"), (max, "biggest")))
        if not self.busy.add(level, *span):
            return "busy"
        try:
            if bottom or level == 0 and len(top) > 1:
                self._merge(top, bottom, level)
                return "merged"
            moved = top[0]
            self._publish([{"op": "DELETE", "kind": "table", "id": moved["id"]}, moved | {"level": level + 1}])
            return "moved"
        finally:
            self.busy.remove(level, *span)

    def compact_due(self) -> list[tuple[int, str]]:
        """Steps, by score, until no level is over its budget."""
        done = []
        while due := [r["level"] for r in compact.pick_levels(compact.level_stats(self.table_stats()), self.l0_tables, self.level_one).collect()]:
            step = self.compact_level(due[0])
            done.append((due[0], step))
            if step not in ("merged", "moved"):
                break
        return done

    def compact(self) -> None:
        """Merges all tables into the last level; old files stay until vacuum()."""
        if tables := self.manifest.of("table"):
            self._merge(tables, [], S.LEVELS - 2)

    def gc(self, ratio: float = 0.5, least: int = S.GC_MIN_BYTES) -> int:
        """Rewrites the log file with the most garbage and returns its id; NoRewrite if none is worth it, Rejected while another run is under way. Entries that are written anew compare the counter they had, so a write in between wins."""
        if not 0 < ratio < 1:
            raise S.InvalidRequest("the discard ratio lies between 0 and 1, both excluded")
        if not self._gc.acquire(blocking=False):
            raise S.Rejected("garbage collection is under way")
        try:
            log, current = self.log_entries(), self.versions(values=False)
            fid = valuelog.gc_pick(valuelog.gc_stats(log, current), ratio, least)
            kept = valuelog.gc_rewrite(log, current, fid)
            gone = [{"op": "DELETE", "kind": "log", "id": fid}]
            ops = kept.select(F.col("cas").alias("ordinal"), "key", "value", F.col("meta").bitwiseAND(~(S.POINTER | S.SET_IF_ABSENT)).alias("meta"), "user_meta", "cas_check")
            self._commit(ops, None, extra=gone)
            return fid
        finally:
            self._gc.release()

    def separate(self) -> tuple[DataFrame, DataFrame]:
        """(rows, blobs) of the newest versions, with values over the threshold apart."""
        return valuelog.separate(self.versions(), self.threshold)

    def vacuum(self) -> int:
        """Deletes what neither the manifest nor a reader needs; returns how many folders went."""
        kept = {e["path"] for e in self.manifest.entries.values()}
        for name in self._files.names("readers"):
            if self._files.age(f"readers/{name}") < LEASE:
                kept |= set(json.loads(self._files.read(f"readers/{name}")))
            else:
                self._files.delete(f"readers/{name}")
        answers = {v[1] for k, v in self.manifest.applied.items() if k.startswith("batch_")}
        gone = 0
        for top in ("tables", "vlog"):
            for part in self._files.names(top):
                inner = [f"{top}/{part}/{n}" for n in self._files.names(f"{top}/{part}") if "=" in n]
                for path in inner:
                    if path not in kept:
                        self._files.delete(path)
                        gone += 1
                if not set(inner) & kept:
                    self._files.delete(f"{top}/{part}")
        for top in ("batch", "merge"):
            for part in self._files.names(top):
                if f"{top}/{part}" not in answers:
                    self._files.delete(f"{top}/{part}")
                    gone += 1
        return gone

    def backup(self, path: str) -> None:
        backup.write_framed(self.view(), path)

    def stats(self) -> DataFrame:
        return stats.size_stats(self.versions())

    def metrics(self) -> DataFrame:
        """(label, value) of the counters since the store was opened and of the sizes now."""
        now = self.counters | {"lsm_size": sum(e["size"] for e in self.manifest.of("table")), "vlog_size": sum(e["size"] for e in self.manifest.of("log"))}
        return self.spark.createDataFrame(list(now.items()), "label string, value long")

    def folder_bytes(self) -> dict[str, int]:
        return {top: self._files.size(top) for top in ("tables", "vlog", "manifest")}

    def close(self) -> None:
        """Gives the lock back. Every batch is on disk before it is answered, so nothing is left to flush."""
        if self._files.names() and "LOCK" in self._files.names() and self._files.read("LOCK") == self._token:
            self._files.delete("LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
