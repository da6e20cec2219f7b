"""The registered queries: each a thin use of an operator, with DuckDB SQL.

Tables stand for a store's contents: ``events`` and ``orders`` are operation
logs, ``documents`` are values to separate.  Constants are the queries' own.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import bloom, codec, resp
from keystrata.operators import compaction, oplog, reads, vsep
from keystrata.plans import workload
from keystrata.plans.checkpoints import own_folder
from keystrata.sources import logfile
from keystrata.sources.store import Store

SNAPSHOT, SNAPSHOTS, FILE_ROWS = 5000, [1000, 5000, 9000], 1250
BEGIN, END = "user0000000000000000003", "user0000000000000000009"

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return oplog.oplog(e, codec.make_key(F.col("user_id")), F.col("event_id") + 1, F.col("value"), F.coalesce(F.col("event_type") == "error", F.lit(False)))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return oplog.oplog(o, codec.make_key(F.col("o_custkey")), F.col("o_orderkey") + 1, F.col("o_totalprice"), F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return oplog.oplog(d, codec.make_key(F.col("doc_id")), F.col("doc_id") + 1, F.col("text"), F.lit(False))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted keys: the user of every order, with repeats."""
    o = table(spark, sf_dir, "orders")
    return o.select(codec.make_key(F.col("o_custkey")).alias("user_key"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the events log cut into files, dealt over levels 0 to 2."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS))
    return compaction.file_metadata(log).withColumn("level", (F.col("file_number") % 3).cast("int"))


OP = "WITH op AS (SELECT printf('user%019d', user_id) AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"
RANK = "row_number() OVER (PARTITION BY user_key ORDER BY seq DESC)"
WANTED = "wanted AS (SELECT printf('user%019d', o_custkey) AS user_key FROM orders)"
LIVE = f"live AS (SELECT user_key, seq, value FROM (SELECT *, {RANK} AS rn FROM op) WHERE rn = 1 AND type = 1)"
FILES = f"f AS (SELECT (seq - 1) // {FILE_ROWS} AS file_number, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS entry_count, CAST(sum(strlen(user_key) + 8) AS BIGINT) AS file_size, min(user_key) AS smallest_key, max(user_key) AS largest_key, CAST(((seq - 1) // {FILE_ROWS}) % 3 AS INTEGER) AS level FROM op GROUP BY 1, 8)"


@query(f"{OP}, {LIVE} SELECT * FROM live")
def get_latest(spark, sf_dir):
    """The latest value of every live key."""
    return reads.latest(events_log(spark, sf_dir)).select("user_key", "seq", "value")


@query(f"{OP} SELECT user_key, seq, value FROM (SELECT *, {RANK} AS rn FROM op WHERE seq <= {SNAPSHOT}) WHERE rn = 1 AND type = 1")
def get_snapshot(spark, sf_dir):
    """R2: values as of a snapshot."""
    return reads.latest(events_log(spark, sf_dir), SNAPSHOT).select("user_key", "seq", "value")


@query(f"{OP} SELECT user_key, seq, value FROM (SELECT *, {RANK} AS rn FROM op WHERE user_key = '{BEGIN}') WHERE rn = 1 AND type = 1")
def get_point(spark, sf_dir):
    """One key, its equality pushed to the scan's expression."""
    return reads.get(events_log(spark, sf_dir), BEGIN).select("user_key", "seq", "value")


@query(f"{OP}, {WANTED}, top AS (SELECT * FROM (SELECT *, {RANK} AS rn FROM op) WHERE rn = 1) SELECT w.user_key, CASE WHEN t.type IS NULL THEN 'missing' WHEN t.type = 0 THEN 'deleted' ELSE 'found' END AS status, t.value FROM wanted w LEFT JOIN top t USING (user_key)")
def lookup_tristate(spark, sf_dir):
    """Found, deleted or missing for each wanted key."""
    return reads.lookup(events_log(spark, sf_dir), wanted(spark, sf_dir))


@query(f"{OP}, {LIVE}, {WANTED} SELECT count(*) AS n FROM wanted WHERE user_key IN (SELECT user_key FROM live)")
def exists_count(spark, sf_dir):
    """Arguments that exist, repeats counted."""
    return reads.exists_count(events_log(spark, sf_dir), wanted(spark, sf_dir))


@query(f"{OP}, {LIVE}, {WANTED} SELECT count(DISTINCT user_key) AS n FROM wanted WHERE user_key IN (SELECT user_key FROM live)")
def del_count(spark, sf_dir):
    """Keys that a delete of all arguments removes."""
    return reads.delete_count(events_log(spark, sf_dir), wanted(spark, sf_dir))


@query(f"{OP}, {WANTED} SELECT DISTINCT user_key FROM wanted WHERE user_key IN (SELECT user_key FROM op)")
def contains(spark, sf_dir):
    """Ordered-set membership."""
    return wanted(spark, sf_dir).distinct().join(events_log(spark, sf_dir), "user_key", "left_semi")


@query(f"{OP}, {LIVE} SELECT * FROM live WHERE user_key >= '{BEGIN}' AND user_key < '{END}'")
def scan_range(spark, sf_dir):
    """The half-open range scan."""
    return reads.scan(events_log(spark, sf_dir), BEGIN, END).select("user_key", "seq", "value")


@query(f"{OP} SELECT user_key, seq, value FROM (SELECT *, {RANK} AS rn FROM op WHERE seq <= {SNAPSHOT}) WHERE rn = 1 AND type = 1 AND user_key >= '{BEGIN}' AND user_key < '{END}'")
def scan_snapshot(spark, sf_dir):
    """The range scan at a snapshot."""
    return reads.scan(events_log(spark, sf_dir), BEGIN, END, SNAPSHOT).select("user_key", "seq", "value")


@query(f"{OP} SELECT user_key, seq, type, value FROM op")
def merge_sources(spark, sf_dir):
    """S3: a merge of overlapping sources in internal-key order."""
    log = events_log(spark, sf_dir)
    return oplog.ordered(oplog.merge(log.where("seq > 4000"), log.where("seq <= 6000")))


@query(f"{OP} SELECT user_key, seq, type, value FROM (SELECT *, {RANK} AS rn FROM op) WHERE rn = 1")
def source_priority(spark, sf_dir):
    """Newest source first gives the newest version, tombstones included."""
    log = events_log(spark, sf_dir)
    return reads.by_source_rank([log.where("seq > 8000"), log.where("seq > 4000 and seq <= 8000"), log.where("seq <= 4000")])


@query(f"{OP} SELECT user_key, seq, type, value, {RANK} AS version FROM op")
def version_history(spark, sf_dir):
    """Every version with its rank by age."""
    return reads.history(events_log(spark, sf_dir))


@query(f"{OP}, {LIVE} SELECT * FROM live WHERE user_key >= 'user0000000000000000042x' ORDER BY user_key LIMIT 1")
def seek_successor(spark, sf_dir):
    """The first live key at or after a target."""
    return reads.seek(events_log(spark, sf_dir), "user0000000000000000042x").select("user_key", "seq", "value")


@query(f"{OP}, {LIVE}, r AS (SELECT o_orderkey AS op_id, o_custkey % 150 AS first, 1 + o_orderkey % 20 AS length FROM orders) SELECT op_id, count(user_key) AS n FROM r LEFT JOIN live ON CAST(substr(user_key, 5) AS BIGINT) >= first AND CAST(substr(user_key, 5) AS BIGINT) < first + length GROUP BY op_id")
def scan_counts(spark, sf_dir):
    """Live keys in many ranges at once."""
    o = table(spark, sf_dir, "orders")
    ranges = o.select(F.col("o_orderkey").alias("op_id"), (F.col("o_custkey") % 150).alias("first"), (1 + F.col("o_orderkey") % 20).alias("length"))
    return reads.range_counts(events_log(spark, sf_dir), ranges, F.substring("user_key", 5, 19))


@query(f"{OP}, s AS (SELECT unnest({SNAPSHOTS}) AS snapshot) SELECT CAST(snapshot AS BIGINT) AS snapshot, user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, user_key ORDER BY seq DESC) AS rn FROM s JOIN op ON seq <= snapshot) WHERE rn = 1 AND type = 1")
def multi_snapshot_asof(spark, sf_dir):
    """M4: live keys as of several snapshots, from validity intervals."""
    return reads.multi_snapshot(events_log(spark, sf_dir), SNAPSHOTS)


@query("SELECT CAST(coalesce(min(event_id + 1), 9223372036854775807) AS BIGINT) AS floor FROM events WHERE event_type = 'purchase'")
def snapshot_floor(spark, sf_dir):
    """M3: the smallest live snapshot."""
    return reads.snapshot_floor(table(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("event_id") + 1).alias("seq")))


@query("SELECT greatest((SELECT max(event_id + 1) FROM events), (SELECT max(o_orderkey + 1) FROM orders)) + 1 AS next_seq")
def next_seq(spark, sf_dir):
    """One past the largest sequence number of all sources."""
    return oplog.next_seq(events_log(spark, sf_dir), orders_log(spark, sf_dir))


def _retained(floor: int | None, bottom: bool) -> str:
    at_most = f"seq <= {floor}" if floor is not None else "true"
    drop = " AND type = 1" if bottom else ""
    return f"{OP}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key, {at_most} ORDER BY seq DESC) AS rn, NOT ({at_most}) AS above FROM op) SELECT user_key, seq, type, value FROM r WHERE above OR (rn = 1{drop})"


@query(_retained(None, False))
def retain_nofloor(spark, sf_dir):
    """C5 without a snapshot, above the bottom level."""
    return compaction.retain(events_log(spark, sf_dir))


@query(_retained(SNAPSHOT, False))
def retain_floor(spark, sf_dir):
    """C5 with a snapshot."""
    return compaction.retain(events_log(spark, sf_dir), SNAPSHOT)


@query(_retained(None, True))
def retain_bottom(spark, sf_dir):
    """C5 into the bottom level."""
    return compaction.retain(events_log(spark, sf_dir), None, True)


@query(_retained(SNAPSHOT, True))
def retain_floor_bottom(spark, sf_dir):
    """C5 with a snapshot into the bottom level."""
    return compaction.retain(events_log(spark, sf_dir), SNAPSHOT, True)


@query(f"{OP}, f AS (SELECT (seq - 1) // {FILE_ROWS} AS file_number, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS entry_count, CAST(sum(strlen(user_key)) AS BIGINT) AS key_bytes, min(user_key) AS smallest_key, max(user_key) AS largest_key FROM op GROUP BY 1) SELECT * FROM f")
def file_meta(spark, sf_dir):
    """Bounds, entries and key bytes of each file."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS)).withColumn("value", F.lit(None).cast("string"))
    return compaction.file_metadata(log).withColumnRenamed("file_size", "key_bytes")


def meta(spark, sf_dir):
    """File metadata with eight bytes for a value, as the SQL counts them."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS)).withColumn("value", F.lit("eight by"))
    return compaction.file_metadata(log).withColumn("level", (F.col("file_number") % 3).cast("int"))


@query(f"{OP}, {FILES}, s AS (SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CASE WHEN level BETWEEN 1 AND 5 THEN CAST(30000 * 10 ** (level - 1) AS BIGINT) END AS \"limit\" FROM f GROUP BY level) SELECT *, CASE WHEN level = 0 THEN files >= 3 ELSE bytes > \"limit\" END AS needs_compaction FROM s")
def level_sizes(spark, sf_dir):
    """Bytes, limits and need for compaction by level."""
    return compaction.level_sizes(meta(spark, sf_dir), l0_trigger=3, base=30_000)


@query(f"{OP}, {FILES} SELECT level, count(*) AS files FROM f GROUP BY level")
def level_file_count(spark, sf_dir):
    """Files by level."""
    return compaction.level_file_count(meta(spark, sf_dir))


ORDER_FILES = "f AS (SELECT o_custkey // 10 AS file_number, CAST(1 + (o_custkey // 10) % 2 AS INTEGER) AS level, min(printf('user%019d', o_custkey * 7 % 997)) AS smallest_key, max(printf('user%019d', o_custkey * 7 % 997)) AS largest_key FROM orders GROUP BY 1, 2)"


def order_files(spark, sf_dir):
    """Files with key ranges of all kinds, over levels 1 and 2."""
    key = codec.make_key(F.col("o_custkey") * 7 % 997)
    number = F.floor(F.col("o_custkey") / 10)
    o = table(spark, sf_dir, "orders").select(number.alias("file_number"), (1 + number % 2).cast("int").alias("level"), key.alias("k"))
    return o.groupBy("file_number", "level").agg(F.min("k").alias("smallest_key"), F.max("k").alias("largest_key"))


@query(f"WITH RECURSIVE {ORDER_FILES}, a AS (SELECT * FROM f WHERE level = 1 ORDER BY smallest_key, file_number LIMIT 1), p AS (SELECT b.file_number, b.level, b.smallest_key, b.largest_key FROM f b, a WHERE b.level = 2 AND b.largest_key >= a.smallest_key AND b.smallest_key <= a.largest_key UNION SELECT b.file_number, b.level, b.smallest_key, b.largest_key FROM f b, p WHERE b.level = 2 AND b.largest_key >= p.smallest_key AND b.smallest_key <= p.largest_key) SELECT * FROM p")
def overlap_files(spark, sf_dir):
    """C4: the files that a compaction of level 1's first file draws in."""
    f = order_files(spark, sf_dir)
    first = f.where("level = 1").orderBy("smallest_key", "file_number").limit(1)
    return compaction.overlap(f, first, 2)


@query(f"{OP}, {FILES} SELECT file_number, level, smallest_key, largest_key FROM f WHERE largest_key >= '{BEGIN}' AND smallest_key < '{END}' AND smallest_seq <= {SNAPSHOT}")
def range_pruned_files(spark, sf_dir):
    """Files that a scan at a snapshot has to open."""
    return compaction.prune(meta(spark, sf_dir), BEGIN, END, SNAPSHOT).select("file_number", "level", "smallest_key", "largest_key")


LISTING = "listing AS (SELECT printf('%06d.sst', file_number) AS name FROM f UNION ALL SELECT printf('%06d.log', file_number) FROM f UNION ALL SELECT 'MANIFEST.tmp')"


@query(f"{OP}, {FILES}, {LISTING} SELECT name FROM listing WHERE (name LIKE '%.sst' AND name NOT IN (SELECT printf('%06d.sst', file_number) FROM f WHERE level < 2)) OR (name LIKE '%.log' AND CAST(split_part(name, '.', 1) AS BIGINT) < 3) OR name = 'MANIFEST.tmp'")
def orphans(spark, sf_dir):
    """files that no manifest names."""
    f = meta(spark, sf_dir)
    listing = f.select(codec.file_name(F.col("file_number"), "sst").alias("name")).unionByName(f.select(codec.file_name(F.col("file_number"), "log").alias("name")))
    listing = listing.unionByName(spark.range(1).select(F.lit("MANIFEST.tmp").alias("name")))
    live = f.where("level < 2").select(codec.file_name(F.col("file_number"), "sst").alias("name"))
    return compaction.orphans(listing, live, 3)


@query(f"{OP}, {FILES}, inputs AS (SELECT file_number FROM f WHERE level = 0) SELECT file_number, level FROM f WHERE file_number NOT IN (SELECT file_number FROM inputs) UNION ALL SELECT 1000, 1")
def install_version(spark, sf_dir):
    """The next version after a compaction of level 0."""
    f = meta(spark, sf_dir).select("file_number", "level")
    outputs = spark.range(1).select(F.lit(1000).cast("long").alias("file_number"), F.lit(1).alias("level"))
    return compaction.install(f, f.where("level = 0"), outputs)


DOCS = "WITH d AS (SELECT printf('user%019d', doc_id) AS user_key, doc_id + 1 AS seq, text AS value FROM documents WHERE text IS NOT NULL)"
VLOG = f"{DOCS}, v AS (SELECT *, strlen(value) AS size, CAST(coalesce(sum(12 + strlen(user_key) + strlen(value)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d WHERE strlen(value) >= 1024)"


@query(f"{DOCS} SELECT strlen(value) >= 1024 AS separated, count(*) AS n, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM d GROUP BY 1")
def vsep_split(spark, sf_dir):
    """V1: values that go to the value log."""
    log = documents_log(spark, sf_dir)
    return log.groupBy(vsep.is_separated(F.col("value")).alias("separated")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@query(f"{VLOG} SELECT user_key, seq, \"offset\", size FROM v")
def vlog_offsets(spark, sf_dir):
    """V3: offsets of value log entries."""
    _, entries = vsep.split(documents_log(spark, sf_dir), 1)
    return entries.select("user_key", "seq", "offset", "size")


@query(f"{DOCS} SELECT user_key, seq, md5(value) AS value_md5, 'ok' AS status FROM d")
def resolve_pointers(spark, sf_dir):
    """V5: values fetched through pointers after ranking."""
    log, entries = vsep.split(documents_log(spark, sf_dir), 1)
    return vsep.resolve(reads.latest(log), entries).select("user_key", "seq", F.md5("value").alias("value_md5"), "status")


@query(f"{VLOG} SELECT \"offset\", CASE WHEN seq % 3 = 0 THEN 'corruption' WHEN seq % 3 = 1 THEN 'ok' ELSE 'not found' END AS status FROM (SELECT seq, CASE WHEN seq % 3 = 2 THEN \"offset\" + 1 ELSE \"offset\" END AS \"offset\" FROM v)")
def read_status(spark, sf_dir):
    """V4: reads by offset: intact, of wrong size, between entries."""
    _, entries = vsep.split(documents_log(spark, sf_dir), 1)
    wanted = entries.select("vlog_number", F.when(F.col("seq") % 3 == 2, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"), F.when(F.col("seq") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("expected_size"))
    return vsep.read_entries(entries, wanted).select("offset", "status")


@query(f"{VLOG} SELECT seq, \"offset\" FROM v WHERE \"offset\" < (SELECT min(\"offset\") FROM v WHERE seq % 100 = 99)")
def sequential_scan(spark, sf_dir):
    """V6: a value log read up to its first bad entry."""
    _, entries = vsep.split(documents_log(spark, sf_dir), 1)
    return vsep.sequential(entries, F.col("seq") % 100 != 99).select("seq", "offset")


def _pointed(spark, sf_dir):
    """The events log with every value in a value log."""
    log = events_log(spark, sf_dir)
    place = F.struct(F.lit(1).cast("long").alias("vlog_number"), (F.col("seq") * 43).alias("offset"))
    pointed = log.withColumn("pointer", F.when(F.col("type") == 1, place))
    return pointed, log.where("type = 1").select(F.lit(1).cast("long").alias("vlog_number"), (F.col("seq") * 43).alias("offset"), "user_key", F.col("value").cast("string").alias("value"))


@query(f"{OP}, {LIVE} SELECT user_key, seq * 43 AS \"offset\" FROM live")
def gc_live(spark, sf_dir):
    """V7: entries that the latest version of their key points to."""
    return vsep.live_entries(*_pointed(spark, sf_dir)).select("user_key", "offset")


@query(f"{OP}, {LIVE} SELECT user_key, seq * 43 AS \"offset\" FROM op WHERE type = 1 AND seq NOT IN (SELECT seq FROM live)")
def gc_garbage(spark, sf_dir):
    """V7: entries that nothing points to."""
    return vsep.live_entries(*_pointed(spark, sf_dir), live=False).select("user_key", "offset")


@query(f"{VLOG} SELECT CAST(1 AS BIGINT) AS generations, CAST(sum(12 + strlen(user_key) + strlen(value)) AS BIGINT) AS bytes, sum(12 + strlen(user_key) + strlen(value)) >= 1000000 AS needed FROM v")
def gc_needed(spark, sf_dir):
    """V9: whether a garbage collection is due."""
    _, entries = vsep.split(documents_log(spark, sf_dir), 1)
    return vsep.gc_needed(entries, 0, 1_000_000)


@query(f"{OP}, {LIVE}, r AS (SELECT user_key, row_number() OVER (ORDER BY seq) + 20000000 AS seq FROM live) SELECT * FROM r")
def gc_rewrite(spark, sf_dir):
    """V8: live values rewritten under fresh sequence numbers."""
    return vsep.rewrite(*_pointed(spark, sf_dir), 2, 20_000_000)[0].select("user_key", "seq")


@query(f"{OP} SELECT user_key, seq, type FROM op")
def dup_reject(spark, sf_dir):
    """Equal internal keys are taken once."""
    log = events_log(spark, sf_dir)
    return oplog.merge(log, log.where("seq % 2 = 0")).select("user_key", "seq", "type")


@query(f"{DOCS} SELECT count(*) AS entries, CAST(sum(36 + strlen(user_key) + strlen(value)) AS BIGINT) AS bytes FROM d")
def memtable_size(spark, sf_dir):
    """Entries and estimated size."""
    return oplog.memtable_size(documents_log(spark, sf_dir))


@query("SELECT printf('user%019d', o_custkey) AS user_key, 100 + row_number() OVER (ORDER BY o_orderkey) AS seq, 1 AS type, o_totalprice AS value FROM orders")
def put_batch(spark, sf_dir):
    """A batch of puts with sequence numbers in order of arrival."""
    o = table(spark, sf_dir, "orders").select(codec.make_key(F.col("o_custkey")).alias("k"), "o_totalprice", "o_orderkey")
    return oplog.put(o, "k", "o_totalprice", "o_orderkey", 100)


@query("SELECT printf('user%019d', o_custkey) AS user_key, row_number() OVER (ORDER BY o_orderkey) AS seq, 0 AS type FROM orders WHERE o_orderstatus = 'F'")
def delete_batch(spark, sf_dir):
    """Unconditional tombstones."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(codec.make_key(F.col("o_custkey")).alias("k"), "o_orderkey")
    return oplog.delete(o, "k", "o_orderkey", 0).select("user_key", "seq", "type")


@query(f"{OP}, {LIVE}, u AS (SELECT printf('user%019d', o_custkey) AS user_key, count(*) AS n FROM orders GROUP BY 1) SELECT user_key, round(coalesce(value, 0) + n, 6) AS value FROM u LEFT JOIN live USING (user_key)")
def read_modify_write(spark, sf_dir):
    """New values from the latest ones, in one join."""
    u = table(spark, sf_dir, "orders").groupBy(codec.make_key(F.col("o_custkey")).alias("user_key")).agg(F.count("*").alias("n"))
    live = reads.latest(events_log(spark, sf_dir)).select("user_key", "value")
    return u.join(live, "user_key", "left").select("user_key", F.round(F.coalesce("value", F.lit(0.0)) + F.col("n"), 6).alias("value"))


@query(f"{DOCS}, s AS (SELECT CAST(sum(CASE WHEN strlen(value) >= 1024 THEN 12 + strlen(user_key) + strlen(value) ELSE 0 END) AS BIGINT) AS vlog_bytes, CAST(sum(9 + 17 + strlen(user_key) + CASE WHEN strlen(value) >= 1024 THEN 21 ELSE strlen(value) END) AS BIGINT) AS log_bytes, CAST(sum(8 + strlen(user_key) + CASE WHEN strlen(value) >= 1024 THEN 21 ELSE strlen(value) END) AS BIGINT) AS table_bytes, CAST(sum(strlen(user_key) + strlen(value)) AS BIGINT) AS user_bytes FROM d) SELECT *, round((vlog_bytes + log_bytes + table_bytes) / user_bytes, 9) AS write_amp FROM s")
def write_amp(spark, sf_dir):
    """A2, A3: bytes by kind and write amplification, value logs and one flush included."""
    d = documents_log(spark, sf_dir)
    key, value = F.octet_length("user_key"), F.octet_length("value")
    big = vsep.is_separated(F.col("value"))
    sums = d.agg(
        F.sum(F.when(big, vsep.ENTRY_HEADER + key + value).otherwise(0)).cast("long").alias("vlog_bytes"),
        F.sum(workload.log_bytes(17 + key + F.when(big, vsep.POINTER_BYTES).otherwise(value))).cast("long").alias("log_bytes"),
        F.sum(compaction.ENTRY_BYTES + key + F.when(big, vsep.POINTER_BYTES).otherwise(value)).cast("long").alias("table_bytes"),
        F.sum(key + value).cast("long").alias("user_bytes"),
    )
    return sums.withColumn("write_amp", F.round(workload.write_amplification(F.col("log_bytes"), F.col("table_bytes"), F.col("vlog_bytes"), F.col("user_bytes")), 9))


@query(f"{OP} SELECT seq, type, seq * 256 + type AS tag FROM op")
def tag_pack(spark, sf_dir):
    """Packed tags."""
    return events_log(spark, sf_dir).select("seq", "type", codec.pack_tag(F.col("seq"), F.col("type")).alias("tag"))


@query(f"{OP} SELECT seq, type FROM op")
def tag_unpack(spark, sf_dir):
    """Tags unpacked again."""
    seq, kind = codec.unpack_tag(F.col("tag"))
    return tag_pack(spark, sf_dir).select(seq.alias("seq"), kind.cast("int").alias("type"))


@query(f"{OP} SELECT seq, seq * 256 + 255 AS tag FROM op")
def snapshot_tags(spark, sf_dir):
    """The tag to seek for a snapshot."""
    return events_log(spark, sf_dir).select("seq", codec.snapshot_tag(F.col("seq")).alias("tag"))


@query(f"{OP} SELECT seq, printf('%06d.sst', seq) AS name, CAST(seq AS BIGINT) AS number FROM op")
def file_names(spark, sf_dir):
    """File names made and parsed."""
    named = events_log(spark, sf_dir).select("seq", codec.file_name(F.col("seq"), "sst").alias("name"))
    return named.withColumn("number", codec.file_number(F.col("name"), "sst").cast("long"))


@query("SELECT user_id, printf('user%019d', user_id) AS user_key FROM events GROUP BY 1")
def make_key(spark, sf_dir):
    """Keys of item numbers."""
    return table(spark, sf_dir, "events").select("user_id").distinct().withColumn("user_key", codec.make_key(F.col("user_id")))


@query("SELECT doc_id, '$' || strlen(text) || chr(13) || chr(10) || text || chr(13) || chr(10) AS reply FROM documents")
def resp_reply(spark, sf_dir):
    """Bulk replies, lengths in bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", codec.bulk(F.col("text")).alias("reply"))


@query("SELECT c_custkey, '-' || replace(replace(c_name, chr(13), ' '), chr(10), ' ') || chr(13) || chr(10) AS error, ':' || c_custkey || chr(13) || chr(10) AS number, '+' || c_mktsegment || chr(13) || chr(10) AS simple, '*' || c_custkey || chr(13) || chr(10) AS header FROM customer")
def resp_encoders(spark, sf_dir):
    """Error, integer, simple and array replies."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", codec.error(F.col("c_name")).alias("error"), codec.integer(F.col("c_custkey")).alias("number"), codec.simple(F.col("c_mktsegment")).alias("simple"), codec.array_header(F.col("c_custkey")).alias("header"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(p_type, '[0-9]+') THEN TRY_CAST(p_type AS BIGINT) END AS word, CAST(p_size AS BIGINT) AS size, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower, CASE WHEN p_size % 2 = 0 THEN 'OK' ELSE 'NotFound: ' || p_brand END AS status FROM part")
def scalar_text(spark, sf_dir):
    """ASCII lower case, statuses, strict digits."""
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") % 2 == 0, "OK").otherwise("NotFound")
    return p.select("p_partkey", codec.parse_digits(F.col("p_type")).alias("word"), codec.parse_digits(F.col("p_size").cast("string")).alias("size"), codec.lower_ascii(F.col("p_name")).alias("lower"), codec.status_text(code, F.col("p_brand")).alias("status"))


@query("SELECT o_orderkey, CASE WHEN ns >= 1000000 THEN printf('%d.%dms', ((ns + 50000) // 100000) // 10, ((ns + 50000) // 100000) % 10) WHEN ns >= 1000 THEN printf('%d.%dus', ((ns + 50) // 100) // 10, ((ns + 50) // 100) % 10) ELSE printf('%dns', ns) END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS ns FROM orders)")
def format_ns(spark, sf_dir):
    """Durations, rounded half up."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", codec.format_ns(F.col("o_orderkey") * F.col("o_orderkey")).alias("shown"))


@query("SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def op_counts(spark, sf_dir):
    """Operations by type."""
    return workload.op_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "op"))


PERCENTS = [50.0, 95.0, 99.0, 99.9]


@query(f"WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p AS (SELECT unnest({PERCENTS})::DOUBLE AS p) SELECT p, value FROM p JOIN r ON rn = least(n - 1, CAST(floor(p / 100.0 * n) AS BIGINT))")
def percentiles(spark, sf_dir):
    """A4: exact percentiles by rank."""
    return workload.percentiles(table(spark, sf_dir, "events"), "value", PERCENTS)


@query("SELECT count(o_totalprice) AS n, max(o_totalprice) AS most, round(sum(o_totalprice), 2) AS total FROM orders")
def latency_summary(spark, sf_dir):
    """Count, largest and total."""
    return workload.latency(table(spark, sf_dir, "orders"), "o_totalprice").select("n", "most", F.round("total", 2).alias("total"))


@query("WITH i AS (SELECT DISTINCT user_id AS item FROM events), s AS (SELECT item, sum((item + 1.0) ** -0.99) OVER (ORDER BY item) AS part, sum((item + 1.0) ** -0.99) OVER () AS whole, max(item) OVER () AS last FROM i) SELECT item, round(CASE WHEN item = last THEN 1.0 ELSE part / whole END, 9) AS cdf FROM s")
def zipf_cdf(spark, sf_dir):
    """The distribution over items."""
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("item")).distinct()
    return workload.zipf_cdf(items).select("item", F.round("cdf", 9).alias("cdf"))


@query("SELECT event_id, CASE WHEN roll < 50 THEN 'read' ELSE 'update' END AS a, CASE WHEN roll < 95 THEN 'read' ELSE 'insert' END AS d, CASE WHEN roll < 5 THEN 'insert' ELSE 'scan' END AS e FROM (SELECT event_id, event_id % 100 AS roll FROM events)")
def mix_rolls(spark, sf_dir):
    """Y2: operations of rolls under three mixes."""
    roll = F.col("event_id") % 100
    return table(spark, sf_dir, "events").select("event_id", *(workload.operation(roll, w.upper()).alias(w) for w in "ade"))


@query("SELECT i AS item, printf('user%019d', i) AS user_key FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS i)")
def load_phase(spark, sf_dir):
    """Keys of the load phase, as many as there are orders."""
    return workload.load(spark, table(spark, sf_dir, "orders").count())


@query(f"{OP} SELECT user_key, seq, type, value FROM (SELECT *, {RANK} AS rn FROM op) WHERE rn = 1")
def streaming_shape(spark, sf_dir):
    """The state of the streaming form: each key's newest version (batch run of the plan)."""
    from keystrata.streaming.ingest import latest_by_key

    return latest_by_key(events_log(spark, sf_dir))


SPLIT = f"k AS (SELECT user_key, sum(strlen(user_key) + 8) AS bytes FROM op GROUP BY 1), a AS (SELECT user_key, CAST(coalesce(sum(bytes) OVER (ORDER BY user_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 20000 AS raw FROM k), s AS (SELECT user_key, dense_rank() OVER (ORDER BY raw) - 1 AS file FROM a), o AS (SELECT CAST(file AS INTEGER) AS file, min(op.user_key) AS smallest_key, max(op.user_key) AS largest_key, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS entry_count FROM op JOIN s USING (user_key) GROUP BY 1)"


def outputs(spark, sf_dir):
    """Metadata of the events log cut into files of 20,000 bytes between keys."""
    log = events_log(spark, sf_dir).withColumn("value", F.lit(None).cast("string"))
    return compaction.file_metadata(compaction.split_outputs(log, 20_000), "file").drop("file_size")


@query(f"{OP}, {SPLIT} SELECT * FROM o")
def split_outputs(spark, sf_dir):
    """A compaction's output cut by size, never inside a key."""
    return outputs(spark, sf_dir)


@query(f"{OP}, {SPLIT}, {WANTED} SELECT w.user_key, CAST(o.file AS BIGINT) AS file_number FROM (SELECT DISTINCT user_key FROM wanted) w LEFT JOIN o ON w.user_key >= o.smallest_key AND w.user_key <= o.largest_key")
def locate_keys(spark, sf_dir):
    """C11: the file of a sorted level that can hold each key."""
    level = outputs(spark, sf_dir).select(F.col("file").cast("long").alias("file_number"), F.lit(1).alias("level"), "smallest_key", "largest_key")
    return compaction.locate(level, wanted(spark, sf_dir).distinct(), 1)


def written_entries(spark, sf_dir):
    """The events log in files, in key order in even ones, otherwise as they came."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS))
    place = Window.partitionBy("file_number").orderBy("user_key", F.desc("seq"))
    return log.withColumn("position", F.when(F.col("file_number") % 2 == 0, F.row_number().over(place)).otherwise(F.col("seq")).cast("long"))


@query(f"{OP}, w AS (SELECT *, (seq - 1) // {FILE_ROWS} AS file_number FROM op), p AS (SELECT *, CASE WHEN file_number % 2 = 0 THEN row_number() OVER (PARTITION BY file_number ORDER BY user_key, seq DESC) ELSE seq END AS position FROM w) SELECT file_number, CAST(count(*) FILTER (WHERE user_key < k OR (user_key = k AND seq >= s)) AS BIGINT) AS violations FROM (SELECT *, lag(user_key) OVER o AS k, lag(seq) OVER o AS s FROM p WINDOW o AS (PARTITION BY file_number ORDER BY position)) GROUP BY 1")
def order_violations(spark, sf_dir):
    """Entries out of internal-key order, by file."""
    return compaction.order_violations(written_entries(spark, sf_dir), "position")


@query(f"{OP}, w AS (SELECT *, (seq - 1) // {FILE_ROWS} AS file_number FROM op), n AS (SELECT file_number FROM w GROUP BY 1) SELECT file_number, CASE WHEN file_number % 2 = 1 THEN 'order' WHEN file_number % 4 = 2 THEN 'bounds' ELSE 'ok' END AS status FROM n WHERE file_number > 0 UNION ALL SELECT 0, 'unknown' UNION ALL SELECT 100000, 'missing'")
def verify_tables(spark, sf_dir):
    """F8: files against their metadata, some of which is wrong."""
    entries = written_entries(spark, sf_dir)
    files = compaction.file_metadata(entries.drop("position"))
    wrong = files.where("file_number > 0").withColumn("entry_count", F.when(F.col("file_number") % 4 == 2, F.col("entry_count") + 1).otherwise(F.col("entry_count")))
    extra = files.where("file_number = 0").withColumn("file_number", F.lit(100_000).cast("long"))
    return compaction.verify(entries, wrong.unionByName(extra), "position")


@query(f"{OP}, w AS (SELECT *, (seq - 1) // {FILE_ROWS} AS file_number FROM op), p AS (SELECT file_number, user_key, lag(user_key) OVER o AS k, (row_number() OVER o - 1) % 16 AS pos FROM w WINDOW o AS (PARTITION BY file_number ORDER BY user_key, seq DESC)) SELECT file_number, count(*) AS entries, CAST(sum(strlen(user_key)) AS BIGINT) AS key_bytes, CAST(sum(CASE WHEN pos > 0 AND k IS NOT NULL THEN len(list_filter(range(1, least(length(k), length(user_key)) + 1), lambda i: left(k, i) = left(user_key, i))) ELSE 0 END) AS BIGINT) AS saved FROM p GROUP BY 1")
def block_prefixes(spark, sf_dir):
    """what prefix coding with restarts saves, by file."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS))
    return compaction.shared_prefixes(log)


FOLD = f"{DOCS}, c AS (SELECT seq, 36 + strlen(user_key) + strlen(value) AS size FROM d), b AS (SELECT seq, size, CAST(coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c), g AS (SELECT CAST(0 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS low UNION ALL SELECT generation + 1, (SELECT min(before) FROM b WHERE before >= g.low + 65536) FROM g WHERE EXISTS (SELECT 1 FROM b WHERE before >= g.low + 65536)), e AS (SELECT generation, low, lead(low) OVER (ORDER BY generation) AS high FROM g), r AS (SELECT generation, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM b JOIN e ON before >= low AND (high IS NULL OR before < high) GROUP BY 1)".replace("WITH d", "WITH RECURSIVE d")


@query(f"{FOLD} SELECT * FROM r")
def write_generations(spark, sf_dir):
    """Generations of a memtable of 64 KiB."""
    return oplog.generations(documents_log(spark, sf_dir), 1 << 16).groupBy("generation").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"{FOLD} SELECT 'always' AS policy, CAST(sum(n) AS BIGINT) AS syncs FROM r UNION ALL SELECT 'periodic', count(*) FROM r WHERE bytes >= 65536 UNION ALL SELECT 'never', 0")
def sync_counts(spark, sf_dir):
    """Syncs under each policy."""
    return oplog.sync_counts(documents_log(spark, sf_dir), 1 << 16)


@query("SELECT event_id + 1 AS seq, printf('user%019d', user_id) AS user_key, (event_id + 1) * 256 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS tag, event_id + 1 AS \"offset\", event_id + 1 AS payload_seq, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events")
def codec_round_trip(spark, sf_dir):
    """Keys, pointers and payloads encoded and decoded."""
    e = table(spark, sf_dir, "events")
    log = oplog.oplog(e, codec.make_key(F.col("user_id")), F.col("event_id") + 1, F.col("event_type"), F.coalesce(F.col("event_type") == "error", F.lit(False)))
    user, tag = codec.split_internal_key(codec.internal_key(F.col("user_key"), F.col("seq"), F.col("type")))
    pointer = codec.read_pointer(codec.value_pointer(F.lit(42), F.col("seq"), F.lit(9999)))
    payload = codec.parse_payload(codec.log_payload(F.col("seq"), F.col("type"), F.col("user_key"), F.col("value")))
    return log.select("seq", user.cast("string").alias("user_key"), tag.cast("long").alias("tag"), pointer["offset"].cast("long").alias("offset"), payload["seq"].cast("long").alias("payload_seq"), payload["value"].cast("string").alias("value"))


@query("WITH c AS (SELECT event_id AS request, user_id, event_type, event_id % 5 AS kind FROM events), s AS (SELECT *, last_value(CASE WHEN kind = 0 THEN event_type WHEN kind = 3 THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c), v AS (SELECT *, coalesce(held, '') <> '' AS live FROM s) SELECT request, CASE kind WHEN 0 THEN '+OK' WHEN 1 THEN CASE WHEN live THEN '$' || strlen(held) || chr(13) || chr(10) || held ELSE '$-1' END WHEN 2 THEN CASE WHEN live THEN ':2' ELSE ':0' END WHEN 3 THEN CASE WHEN live THEN ':1' ELSE ':0' END ELSE '+PONG' END || chr(13) || chr(10) AS reply FROM v")
def command_replay(spark, sf_dir):
    """P5: replies to a history of commands."""
    e = table(spark, sf_dir, "events")
    key = codec.make_key(F.col("user_id"))
    kind = F.col("event_id") % 5
    args = F.when(kind == 0, F.array(F.lit("SET"), key, F.col("event_type"))).when(kind == 1, F.array(F.lit("get"), key)).when(kind == 2, F.array(F.lit("EXISTS"), key, key)).when(kind == 3, F.array(F.lit("DEL"), key, key)).otherwise(F.array(F.lit("PING")))
    return resp.replay(e.select(F.col("event_id").alias("request"), args.alias("args")))


def _mixed(name: str) -> str:
    """SQL: the operation of a roll under a workload's mix."""
    reach, out = 0, []
    for op, share in zip(workload.OPS, workload.WORKLOADS[name]):
        reach += share
        out.append(f"WHEN roll < {reach} THEN '{op}'")
    return "CASE " + " ".join(out) + " END"


RUNS = " UNION ALL ".join(f"SELECT '{w}' AS workload, op_id, item, user_key, length, {_mixed(w)} AS op FROM q" for w in workload.WORKLOADS)


@query(f"{OP}, {LIVE}, q AS (SELECT o_orderkey AS op_id, o_custkey AS item, printf('user%019d', o_custkey) AS user_key, 1 + o_orderkey % 100 AS length, o_orderkey * 7919 % 100 AS roll FROM orders), r AS ({RUNS}), top AS (SELECT user_key, type FROM (SELECT *, {RANK} AS rn FROM op) WHERE rn = 1), num AS (SELECT list(CAST(substr(user_key, 5) AS BIGINT)) AS nums FROM live), a AS (SELECT workload, op, CASE WHEN op IN ('update', 'insert') THEN 'written' WHEN op = 'scan' THEN NULL WHEN type IS NULL THEN 'missing' WHEN type = 0 THEN 'deleted' ELSE 'found' END AS status, CASE WHEN op = 'scan' THEN least(length, len(list_filter(nums, lambda x: x >= item))) END AS n FROM r LEFT JOIN top USING (user_key), num) SELECT workload, op, status, count(*) AS ops, CAST(sum(n) AS BIGINT) AS records FROM a GROUP BY 1, 2, 3")
def workload_runs(spark, sf_dir):
    """One batch of each workload, executed on the events log."""
    o = table(spark, sf_dir, "orders")
    drawn = o.select(F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("item"), codec.make_key(F.col("o_custkey")).alias("user_key"), (1 + F.col("o_orderkey") % 100).alias("length"), (F.col("o_orderkey") * 7919 % 100).alias("roll"))
    out = None
    for name in workload.WORKLOADS:
        ops = drawn.withColumn("op", workload.operation(F.col("roll"), name)).withColumn("value", F.lit(1.0))
        answers = workload.run_batch(events_log(spark, sf_dir), ops)[0].groupBy("op", "status").agg(F.count("*").alias("ops"), F.sum("n").alias("records")).withColumn("workload", F.lit(name))
        out = answers if out is None else out.unionByName(answers)
    return out


@query("SELECT printf('user%019d', user_id) AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS type, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events")
def log_replay(spark, sf_dir):
    """The events as record logs, written and read back."""
    e = table(spark, sf_dir, "events")
    log = oplog.oplog(e, codec.make_key(F.col("user_id")), F.col("event_id") + 1, F.col("event_type"), F.coalesce(F.col("event_type") == "error", F.lit(False)))
    paths = logfile.write_logs(log, f"{own_folder(spark)}/logs-{uuid.uuid4().hex}")
    found = logfile.read_logs(spark, paths)
    return found.select(F.col("user_key").cast("string").alias("user_key"), "seq", "type", F.col("value").cast("string").alias("value"))


def stored(spark, sf_dir) -> Store:
    """Documents in a store: 400 keys, every seventh deleted, through flush, compaction and collection."""
    store = Store(spark, f"{own_folder(spark)}/store-{uuid.uuid4().hex}", threshold=1024, l0_trigger=1, gc_size=1, max_table=100_000)
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("k", F.col("doc_id") % 400)
    for half in (0, 1):
        store.put(d.where(F.col("doc_id") % 2 == half).select(codec.make_key(F.col("k")).alias("user_key"), F.col("text").alias("value"), F.col("doc_id").alias("arrival")))
        store.flush()
    store.delete(d.where("k % 7 = 0").select("k").distinct().select(codec.make_key(F.col("k")).alias("user_key"), F.col("k").alias("arrival")))
    store.maintain()
    return store


HELD = "WITH d AS (SELECT doc_id % 400 AS k, doc_id, text FROM documents WHERE text IS NOT NULL), h AS (SELECT k, arg_max(text, (doc_id % 2) * 1000000000000 + doc_id) AS value FROM d WHERE k % 7 <> 0 GROUP BY 1)"


@query(f"{HELD} SELECT printf('user%019d', k) AS user_key, md5(value) AS value_md5, 'ok' AS status FROM h")
def store_scan(spark, sf_dir):
    """All live keys of a store after maintenance, values fetched through pointers."""
    return stored(spark, sf_dir).scan("", "v").select("user_key", F.md5("value").alias("value_md5"), "status")


@query(f"{HELD}, w AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT DISTINCT k FROM d) SELECT printf('user%019d', w.k) AS user_key, CASE WHEN h.k IS NOT NULL THEN 'found' WHEN a.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status, md5(value) AS value_md5 FROM w LEFT JOIN h USING (k) LEFT JOIN a USING (k)")
def store_lookup(spark, sf_dir):
    """A batch of keys looked up in a store, values fetched through pointers."""
    found = stored(spark, sf_dir).lookup(wanted(spark, sf_dir).distinct())
    # What isn't live has been compacted away or is a tombstone.
    held = table(spark, sf_dir, "documents").where("text is not null").select(codec.make_key(F.col("doc_id") % 400).alias("user_key")).distinct().withColumn("written", F.lit(True))
    status = F.when((F.col("status") != "found") & F.col("written"), "deleted").otherwise(F.col("status"))
    return found.join(held, "user_key", "left").select("user_key", status.alias("status"), F.md5("value").alias("value_md5"))


# Without a SQL form: tested against independent models.


@query()
def crc32_values(spark, sf_dir):
    """Checksums of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", codec.crc32(F.encode("text", "utf-8")).alias("crc"))


@query()
def bloom_probe(spark, sf_dir):
    """filters of each file, probed with present and absent keys."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS))
    filters = bloom.build_filters(log, "file_number")
    wanted = log.select("file_number", "user_key").distinct()
    both = wanted.withColumn("present", F.lit(True)).unionByName(wanted.select("file_number", F.concat("user_key", F.lit("x")).alias("user_key"), F.lit(False).alias("present")))
    hit = both.join(filters, "file_number").withColumn("hit", bloom.probe(F.col("filter"), F.col("user_key")))
    return hit.groupBy("file_number", "present").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query()
def make_value(spark, sf_dir):
    """Pseudo-random values, one an event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.hex(workload.make_value(F.col("event_id"), 64)).alias("value"))


@query()
def resp_parse(spark, sf_dir):
    """Requests out of chunks cut at arbitrary places."""
    e = table(spark, sf_dir, "events")
    command = F.concat(codec.array_header(F.lit(3)), codec.bulk(F.lit("SET")), codec.bulk(codec.make_key(F.col("user_id"))), codec.bulk(F.col("event_type")))
    wire = e.groupBy((F.col("event_id") % 20).alias("connection")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", command.alias("c")))), lambda x: x["c"]), "").alias("wire"))
    chunks = wire.select("connection", F.posexplode(F.regexp_extract_all("wire", F.lit("(?s).{1,7}"), F.lit(0))).alias("chunk_no", "data"))
    return resp.parse_chunks(chunks).select("connection", "request", F.transform("args", lambda a: a.cast("string")).alias("args"), "error")


@query()
def ycsb_operations(spark, sf_dir):
    """A generated run of each mix, counted."""
    records, count = table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "events").count()
    runs = [workload.operations(spark, w, records, count).select(F.lit(w).alias("workload"), "op", "item", "length") for w in "ABCDEF"]
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return both.groupBy("workload", "op").agg(F.count("*").alias("n"), F.min("item").alias("low"), F.max("item").alias("high"), F.max("length").alias("longest"))


@query()
def bloom_blocks(spark, sf_dir):
    """a filter for each block of 64 entries of a file, probed with its own and with absent keys."""
    log = events_log(spark, sf_dir).withColumn("file_number", F.floor((F.col("seq") - 1) / FILE_ROWS))
    place = Window.partitionBy("file_number").orderBy("user_key", F.desc("seq"))
    blocks = log.withColumn("block", F.concat_ws(":", "file_number", F.floor((F.row_number().over(place) - 1) / 64)))
    filters = bloom.build_filters(blocks, "block")
    keys = blocks.select("block", "user_key").distinct()
    both = keys.withColumn("present", F.lit(True)).unionByName(keys.select("block", F.concat("user_key", F.lit("x")).alias("user_key"), F.lit(False).alias("present")))
    hit = both.join(filters, "block").withColumn("hit", bloom.probe(F.col("filter"), F.col("user_key")))
    return hit.groupBy("block", "present").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query()
def lru_cache(spark, sf_dir):
    """Hits and misses of a sharded cache over the events' keys."""
    e = table(spark, sf_dir, "events")
    return workload.lru(e.select(F.col("event_id").alias("place"), F.col("user_id").alias("key"), (1 + F.col("user_id") % 3).alias("weight")), 16, 160)
