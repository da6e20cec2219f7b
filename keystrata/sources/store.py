"""A store of versioned keys in a folder: manifest, write generations, tables.

Layout: ``log/<n>`` (unflushed generations), ``sst/<n>/file=<k>`` (tables, sorted
by key and newest first, a key's versions in one table), ``vlog/<n>`` (separated
values), all Parquet, and MANIFEST.json, which alone says what is live.  Files
are written before the manifest names them; what it no longer names stays for
``grace`` seconds, for readers that opened an earlier manifest.  Only the
writer's maintenance sweeps, and never what is younger than ``grace``; opening a
store deletes nothing.  The manifest is replaced by an atomic rename of the
folder's file system (HDFS or local) and holds the number of the last applied
batch of a stream; there is one writer, readers use the manifest they opened.
"""

import json
import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import compaction, oplog, reads, vsep
from keystrata.plans.workload import log_bytes
from keystrata.sources.logfile import read_logs

EMPTY = {"next_file": 1, "next_seq": 1, "log_floor": 0, "logs": [], "tables": [], "vlogs": [], "rewritten": 0, "epoch": -1, "retired": {}, "counts": {}}
#: Bytes of a table at which the next key starts another; seconds that retired files stay.
MAX_TABLE, GRACE = 64 << 20, 24 * 3600
COUNTERS = ("user_bytes", "log_bytes", "vlog_bytes", "table_bytes", "flushes", "compactions", "collections")
SCHEMA = "user_key {0}, seq long, type int, value {0}, pointer struct<vlog_number:long,offset:long,size:long>"


class Corruption(RuntimeError):
    """A manifest or file that contradicts itself."""


class Store:
    """Open, write, read, snapshot, flush, compact and collect garbage."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", threshold: int | None = None, l0_trigger: int = compaction.L0_TRIGGER, level_base: int = compaction.LEVEL_BASE, gc_size: int = vsep.GC_SIZE, max_table: int = MAX_TABLE, grace: float = GRACE):
        self.spark, self.path, self.kind, self.threshold = spark, path.rstrip("/"), kind, threshold
        self.l0_trigger, self.level_base, self.gc_size, self.max_table, self.grace = l0_trigger, level_base, gc_size, max_table, grace
        self.snapshots: list[int] = []
        jvm = spark.sparkContext._jvm
        self.hadoop = jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest = self.load()
        if self.manifest["vlogs"] and threshold is None:
            raise Corruption("the store has separated values; open it with a threshold")

    # Manifest

    def at(self, *parts) -> str:
        return "/".join([self.path, *map(str, parts)])

    def load(self) -> dict:
        """The checked manifest; a fresh one where there is none."""
        place = self.hadoop.Path(self.at("MANIFEST.json"))
        if not self.fs.exists(place):
            return json.loads(json.dumps(EMPTY))
        text = "".join(r.value for r in self.spark.read.text(self.at("MANIFEST.json"), wholetext=True).collect())
        try:
            m = json.loads(text)
        except ValueError as e:
            raise Corruption("the manifest can't be parsed") from e
        for name, key in (("tables", "file_number"), ("vlogs", None), ("logs", None)):
            numbers = [x[key] if key else x for x in m[name]]
            if sorted(set(numbers)) != sorted(numbers) or any(n >= m["next_file"] for n in numbers):
                raise Corruption(f"the manifest's {name} are not distinct known numbers")
        if any(not 0 <= t["level"] < compaction.LEVELS for t in m["tables"]):
            raise Corruption("the manifest has a level out of range")
        return json.loads(json.dumps(EMPTY)) | m

    def publish(self, **changes) -> None:
        """Write the manifest with changes beside the old one, then rename.

        Names that fall out are retired, with the time.
        """
        after = {**self.manifest, **changes}
        after["retired"] = {k: t for k, t in after["retired"].items() if k not in self.live(after)}
        after["retired"] |= {name: time.time() for name in self.live(self.manifest) - self.live(after)}
        temporary, place = self.hadoop.Path(self.at("MANIFEST.tmp")), self.hadoop.Path(self.at("MANIFEST.json"))
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(json.dumps(after, sort_keys=True).encode()))
        stream.close()
        self.replace(temporary, place)
        self.manifest = after

    def replace(self, source, target) -> None:
        """An atomic rename over what is there."""
        gateway = self.spark.sparkContext._gateway
        kind = getattr(self.hadoop, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf).rename(source, target, options)

    def take_number(self) -> int:
        n = self.manifest["next_file"]
        self.manifest["next_file"] = n + 1
        return n

    @staticmethod
    def live(manifest: dict) -> set[str]:
        """Folders that a manifest names, as kind/number."""
        return {f"sst/{t['folder']}" for t in manifest["tables"]} | {f"vlog/{n}" for n in manifest["vlogs"]} | {f"log/{n}" for n in manifest["logs"]}

    def remove_orphans(self, grace: float | None = None) -> list[str]:
        """Delete folders that the manifest doesn't name, ``grace`` seconds after
        they were retired or, if they never were live, last written; returns their names."""
        grace, live, gone = self.grace if grace is None else grace, self.live(self.manifest), []
        for kind in ("sst", "vlog", "log"):
            folder = self.hadoop.Path(self.at(kind))
            for status in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                name = f"{kind}/{status.getPath().getName()}"
                since = self.manifest["retired"].get(name, status.getModificationTime() / 1000)
                if name not in live and time.time() - since >= grace:
                    self.fs.delete(status.getPath(), True)
                    gone.append(name)
        return gone

    # Writes

    def write(self, ops: DataFrame, epoch: int | None = None) -> None:
        """Apply (user_key, type, value, arrival) rows in order of arrival.

        ``epoch`` numbers a stream's batch: it is published with the batch, and
        a batch that was published is passed over.
        """
        if epoch is not None and epoch <= self.manifest["epoch"]:
            return
        base = self.manifest["next_seq"] - 1
        log = oplog.number(ops.select("user_key", "type", "value", "arrival"), base)
        number = self.take_number()
        changes: dict = {} if epoch is None else {"epoch": epoch}
        if self.threshold is not None:
            vlog = self.take_number()
            log.write.mode("overwrite").parquet(self.at("log", f"{number}.raw"))
            raw = self.spark.read.parquet(self.at("log", f"{number}.raw"))
            log, entries = vsep.split(raw, vlog, self.threshold)
            entries.write.mode("overwrite").parquet(self.at("vlog", vlog))
            changes["vlogs"] = [*self.manifest["vlogs"], vlog]
        else:
            log = log.withColumn("pointer", F.lit(None).cast("struct<vlog_number:long,offset:long,size:long>"))
        log.select("user_key", "seq", "type", "value", "pointer").write.mode("overwrite").parquet(self.at("log", number))
        self.fs.delete(self.hadoop.Path(self.at("log", f"{number}.raw")), True)
        self.publish_log(number, **changes)

    def publish_log(self, number: int, **changes) -> int:
        """Publish a written generation; returns its number of versions."""
        key, value = F.octet_length("user_key"), F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
        apart = F.col("pointer").isNotNull()
        sums = self.spark.read.parquet(self.at("log", number)).agg(
            F.max("seq").alias("top"), F.count("*").alias("n"), F.sum(key + value + F.when(apart, F.col("pointer.size")).otherwise(0)).alias("user_bytes"),
            F.sum(log_bytes(17 + key + value + F.when(apart, vsep.POINTER_BYTES).otherwise(0))).alias("log_bytes"),
            F.sum(F.when(apart, vsep.ENTRY_HEADER + key + F.col("pointer.size")).otherwise(0)).alias("vlog_bytes"),
        ).first()
        counts = self.counted(**{k: sums[k] or 0 for k in ("user_bytes", "log_bytes", "vlog_bytes")})
        self.publish(**changes, counts=counts, logs=[*self.manifest["logs"], number], next_seq=max(self.manifest["next_seq"], (sums.top or 0) + 1))
        return sums.n

    def counted(self, **more: int) -> dict:
        """The counters with something added."""
        return {**self.manifest["counts"], **{k: self.manifest["counts"].get(k, 0) + v for k, v in more.items()}}

    def replay(self, paths: list[str] | str) -> int:
        """Apply what record logs hold beyond the store's last version; returns how many versions."""
        found = read_logs(self.spark, paths).where(F.col("seq") > self.latest_seq())
        number = self.take_number()
        rows = found.select(F.col("user_key").cast(self.kind), "seq", "type", F.col("value").cast(self.kind), F.lit(None).cast("struct<vlog_number:long,offset:long,size:long>").alias("pointer"))
        rows.dropDuplicates(["user_key", "seq", "type"]).write.mode("overwrite").parquet(self.at("log", number))
        return self.publish_log(number)

    def put(self, df: DataFrame, arrival: str = "arrival") -> None:
        self.write(df.select("user_key", F.lit(oplog.VALUE).alias("type"), "value", F.col(arrival).alias("arrival")))

    def delete(self, df: DataFrame, arrival: str = "arrival") -> None:
        self.write(df.select("user_key", F.lit(oplog.TOMBSTONE).alias("type"), F.lit(None).cast(self.kind).alias("value"), F.col(arrival).alias("arrival")))

    # Reads

    def log(self, begin=None, end=None, snapshot: int | None = None) -> DataFrame:
        """All live versions, tables pruned by key range and snapshot."""
        def wanted(t: dict) -> bool:
            return (begin is None or t["largest_key"] is None or t["largest_key"] >= begin) and (end is None or t["smallest_key"] is None or t["smallest_key"] < end) and (snapshot is None or t["smallest_seq"] <= snapshot)

        paths = [self.at("log", n) for n in self.manifest["logs"]] + [self.table_path(t) for t in self.manifest["tables"] if self.kind != "string" or wanted(t)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA.format(self.kind))
        # A sequence number is in one generation or table only, so nothing is to be merged.
        return self.spark.read.schema(SCHEMA.format(self.kind)).parquet(*paths)

    def table_path(self, t: dict) -> str:
        return self.at("sst", t["folder"], f"file={t['part']}")

    def values(self) -> DataFrame:
        """Entries of all live value logs."""
        fields = f"vlog_number long, offset long, user_key {self.kind}, seq long, value {self.kind}, size long, crc long"
        paths = [self.at("vlog", n) for n in self.manifest["vlogs"]]
        return self.spark.read.schema(fields).parquet(*paths) if paths else self.spark.createDataFrame([], fields)

    def resolved(self, rows: DataFrame) -> DataFrame:
        """Winners with their values; separated ones are fetched after ranking."""
        rows = vsep.resolve(rows, self.values()) if self.manifest["vlogs"] else rows.withColumn("status", F.lit("ok"))
        return rows.select("user_key", "seq", "value", "status")

    def get(self, key, snapshot: int | None = None) -> DataFrame:
        return self.resolved(reads.get(self.log(key, None, snapshot), key, snapshot))

    def scan(self, begin, end, snapshot: int | None = None) -> DataFrame:
        return self.resolved(reads.latest(reads.in_range(self.log(begin, end, snapshot), begin, end), snapshot)).orderBy("user_key")

    def lookup(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        """user_key, status (found, deleted, missing, or a corruption) and value of each wanted key.

        Winners are ranked first, then only their values are fetched.
        """
        wanted = keys.select("user_key").distinct()
        top = reads.newest(self.log(snapshot=snapshot).join(wanted, "user_key", "left_semi"), snapshot)
        held = self.resolved(top.where(F.col("type") == oplog.VALUE)).select("user_key", F.when(F.col("status") == "ok", "found").otherwise(F.col("status")).alias("status"), "value")
        dead = top.where(F.col("type") == oplog.TOMBSTONE).select("user_key", F.lit("deleted").alias("status"), F.lit(None).cast(self.kind).alias("value"))
        found = keys.select("user_key").join(held.unionByName(dead), "user_key", "left")
        return found.select("user_key", F.coalesce("status", F.lit("missing")).alias("status"), "value")

    # Snapshots

    def latest_seq(self) -> int:
        return self.manifest["next_seq"] - 1

    def snapshot(self) -> int:
        self.snapshots.append(self.latest_seq())
        return self.snapshots[-1]

    def release(self, snapshot: int) -> None:
        """Unknown snapshots are passed over."""
        if snapshot in self.snapshots:
            self.snapshots.remove(snapshot)

    def floor(self) -> int | None:
        return min(self.snapshots) if self.snapshots else None

    # Maintenance, in order of urgency: flush, compaction, garbage collection

    def write_tables(self, log: DataFrame, level: int) -> list[dict]:
        """Sorted tables of about ``max_table`` bytes and their metadata, written in parallel."""
        folder = self.take_number()
        cut = compaction.split_outputs(log, self.max_table, "file")
        parts = max(1, min(math.ceil(cut.select("file").distinct().count()), 10_000))
        cut.repartition(parts, "file").sortWithinPartitions("file", "user_key", F.desc("seq")).write.mode("overwrite").partitionBy("file").parquet(self.at("sst", folder))
        own = self.spark.read.schema(SCHEMA.format(self.kind) + ", file int").parquet(self.at("sst", folder))
        rows = compaction.file_metadata(own, "file").withColumn("level", F.lit(level)).orderBy("file").collect()
        shown = lambda v: v if isinstance(v, str) else None
        return [{**{k: v for k, v in r.asDict().items() if k != "file"}, "file_number": self.take_number(), "folder": folder, "part": r.file, "smallest_key": shown(r.smallest_key), "largest_key": shown(r.largest_key)} for r in rows]

    def flush(self) -> None:
        """All unflushed generations become one level-0 table, every version kept."""
        logs = self.manifest["logs"]
        if not logs:
            return
        log = self.spark.read.schema(SCHEMA.format(self.kind)).parquet(*(self.at("log", n) for n in logs))
        tables = self.write_tables(log, 0)
        self.publish(tables=[*self.manifest["tables"], *tables], logs=[], log_floor=max(logs) + 1, counts=self.counted(flushes=1, table_bytes=sum(t["file_size"] for t in tables)))

    def compact(self) -> bool:
        """One compaction, if a level is full; whether there was one."""
        tables = self.manifest["tables"]
        by_level = {i: [t for t in tables if t["level"] == i] for i in range(compaction.LEVELS)}
        limit = lambda i: self.level_base * compaction.GROWTH ** (i - 1)
        full = [0] if len(by_level[0]) >= self.l0_trigger else [i for i in range(1, compaction.LEVELS - 1) if sum(t["file_size"] for t in by_level[i]) > limit(i)]
        if not full:
            return False
        source, target = full[0], full[0] + 1
        inputs = by_level[0] if source == 0 else sorted(by_level[source], key=lambda t: t["smallest_key"] or "")[:1]
        picked = self.overlapping(inputs, by_level[target])
        both = inputs + picked
        numbers = {t["file_number"] for t in both}
        log = self.spark.read.schema(SCHEMA.format(self.kind)).parquet(*(self.table_path(t) for t in both))
        kept = compaction.retain(log, self.floor(), bottom=target == compaction.LEVELS - 1)
        outputs = self.write_tables(kept, target)
        self.publish(tables=[t for t in tables if t["file_number"] not in numbers] + outputs, counts=self.counted(compactions=1, table_bytes=sum(t["file_size"] for t in outputs)))
        return True

    def overlapping(self, inputs: list[dict], level: list[dict]) -> list[dict]:
        """Tables of a level that join the inputs, found on the metadata alone."""
        if self.kind != "string" or not level:
            return level
        schema = "file_number long, level int, smallest_key string, largest_key string"
        rows = lambda ts: self.spark.createDataFrame([(t["file_number"], t["level"], t["smallest_key"], t["largest_key"]) for t in ts], schema)
        found = {r.file_number for r in compaction.overlap(rows(level), rows(inputs), level[0]["level"]).collect()}
        return [t for t in level if t["file_number"] in found]

    def collect_garbage(self) -> bool:
        """Rewrite live separated values to a new value log and drop the old ones."""
        if self.threshold is None or not self.manifest["vlogs"]:
            return False
        due = vsep.gc_needed(self.values(), len(self.snapshots), self.gc_size, self.manifest["rewritten"]).first()
        if not due.needed:
            return False
        number = self.take_number()
        pointers, entries = vsep.rewrite(self.log(), self.values(), number, self.latest_seq())
        entries.write.mode("overwrite").parquet(self.at("vlog", number))
        stored = self.spark.read.parquet(self.at("vlog", number))
        pointers = stored.select("user_key", "seq", F.lit(oplog.VALUE).alias("type"), F.lit(None).cast(self.kind).alias("value"), F.struct("vlog_number", "offset", "size").alias("pointer"))
        log_number = self.take_number()
        pointers.write.mode("overwrite").parquet(self.at("log", log_number))
        top, size = stored.agg(F.max("seq"), F.sum(F.col("size") + F.octet_length("user_key") + vsep.ENTRY_HEADER)).first()
        self.publish(logs=[*self.manifest["logs"], log_number], vlogs=[number], next_seq=max(self.manifest["next_seq"], (top or 0) + 1), rewritten=int(size or 0), counts=self.counted(collections=1, vlog_bytes=int(size or 0)))
        return True

    def maintain(self) -> None:
        """Everything that is due."""
        self.flush()
        while self.compact():
            pass
        self.collect_garbage()
        self.remove_orphans()

    def counters(self) -> dict:
        """Files by level, all files, value logs, the last sequence number, bytes by kind and maintenance runs."""
        levels = [sum(t["level"] == i for t in self.manifest["tables"]) for i in range(compaction.LEVELS)]
        return {"level_files": levels, "total_files": sum(levels), "vlogs": len(self.manifest["vlogs"]), "logs": len(self.manifest["logs"]), "latest_seq": self.latest_seq()} | {k: self.manifest["counts"].get(k, 0) for k in COUNTERS}

    def write_amplification(self) -> float | None:
        """Bytes written, value logs included, for each byte of the user."""
        c = self.counters()
        return (c["log_bytes"] + c["table_bytes"] + c["vlog_bytes"]) / c["user_bytes"] if c["user_bytes"] else None
