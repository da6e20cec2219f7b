"""Value separation: large values live in value logs, the log keeps pointers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.oplog import VALUE
from keystrata.operators.reads import latest
from keystrata.plans.checkpoints import running_sum

THRESHOLD, LEAST_THRESHOLD, ENTRY_HEADER = 1024, 64, 12
POINTER_BYTES, POINTER_TAG = 21, "FF"
GC_SIZE, LEAST_GC_SIZE = 64 << 20, 64 << 10


def is_separated(value: Column, threshold: int = THRESHOLD) -> Column:
    """Whether a value goes to the value log: long, or shaped like a pointer."""
    shaped = (F.octet_length(value) == POINTER_BYTES) & (F.substring(F.hex(value), 1, 2) == POINTER_TAG)
    return (F.octet_length(value) >= max(threshold, LEAST_THRESHOLD)) | shaped


def split(log: DataFrame, vlog_number: int, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(log with pointers, value log entries) of a batch.

    An entry takes 12 bytes, its key and its value; its offset is the size of
    all entries before it.
    """
    entries = offsets(log.where((F.col("type") == VALUE) & is_separated(F.col("value"), threshold)), vlog_number)
    places = entries.select("user_key", "seq", F.struct("vlog_number", "offset", "size").alias("pointer"))
    kept = log.join(places, ["user_key", "seq"], "left")
    return kept.withColumn("value", F.when(F.col("pointer").isNull(), F.col("value"))), entries


def offsets(entries: DataFrame, vlog_number: int = 1) -> DataFrame:
    """Entries of one value log with offset and value size, in seq order.

    Running sums go by ranges of sequence numbers; of the ranges only the totals
    meet.
    """
    taken = F.octet_length("user_key") + F.octet_length("value") + ENTRY_HEADER
    placed = running_sum(entries.withColumn("taken", taken.cast("long")), "seq", "taken", "offset")
    return placed.select(F.lit(vlog_number).cast("long").alias("vlog_number"), F.col("offset").cast("long").alias("offset"), "user_key", "seq", "value", F.octet_length("value").cast("long").alias("size"), F.crc32(F.encode(F.col("value").cast("string"), "utf-8")).alias("crc"))


def resolve(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Rows with pointers replaced by values, and a status.

    Meant for rows that were ranked before: only winners fetch their values.
    """
    stored = values.select(F.struct(F.col("vlog_number"), F.col("offset"), F.col("size")).alias("pointer"), F.col("value").alias("stored"), F.col("crc"))
    joined = rows.join(stored, "pointer", "left")
    intact = F.crc32(F.encode(F.col("stored").cast("string"), "utf-8")) == F.col("crc")
    status = F.when(F.col("pointer").isNull(), "ok").when(F.col("stored").isNull(), "corruption: missing").when(~intact, "corruption: checksum").otherwise("ok")
    return joined.withColumn("status", status).withColumn("value", F.coalesce("value", F.when(status == "ok", F.col("stored")))).drop("stored", "crc")


def read_entries(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status of reads by (vlog_number, offset, expected_size)."""
    joined = wanted.join(values.select("vlog_number", "offset", "size", "value"), ["vlog_number", "offset"], "left")
    status = F.when(F.col("size").isNull(), "not found").when(F.col("size") != F.col("expected_size"), "corruption").otherwise("ok")
    return joined.select("vlog_number", "offset", status.alias("status"), F.when(status == "ok", F.col("value")).alias("value"))


def sequential(values: DataFrame, ok: Column) -> DataFrame:
    """Entries of each value log before its first bad one."""
    bad = values.withColumn("ok", ok).groupBy("vlog_number").agg(F.min(F.when(~F.col("ok"), F.col("offset"))).alias("stop"))
    return values.join(bad, "vlog_number").where(F.col("stop").isNull() | (F.col("offset") < F.col("stop"))).drop("stop")


def live_entries(log: DataFrame, values: DataFrame, live: bool = True) -> DataFrame:
    """Value log entries that the latest version of their key points to, or the others."""
    current = latest(log).where("pointer is not null").select("user_key", "pointer.vlog_number", "pointer.offset")
    return values.join(current, ["user_key", "vlog_number", "offset"], "left_semi" if live else "left_anti")


def gc_needed(values: DataFrame, snapshots: int, gc_size: int = GC_SIZE, rewritten: int = 0) -> DataFrame:
    """Whether a collection is due: never with a snapshot, always with an older
    generation, else by size (at least twice what the last one rewrote)."""
    taken = F.octet_length("user_key") + F.octet_length("value") + ENTRY_HEADER
    sums = values.agg(F.count_distinct("vlog_number").alias("generations"), F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("bytes"))
    trigger = max(gc_size, LEAST_GC_SIZE, 2 * rewritten)
    due = F.lit(snapshots == 0) & ((F.col("generations") > 1) | ((F.col("generations") > 0) & (F.col("bytes") >= trigger)))
    return sums.withColumn("needed", due)


def rewrite(log: DataFrame, values: DataFrame, vlog_number: int, base: int) -> tuple[DataFrame, DataFrame]:
    """(pointer versions under fresh sequence numbers, entries of the new value log)."""
    from keystrata.operators.oplog import number

    live = live_entries(log, values).select("user_key", F.lit(VALUE).alias("type"), "value", F.struct("vlog_number", "offset").alias("arrival"))
    entries = offsets(number(live, base), vlog_number)
    pointers = entries.select("user_key", "seq", F.lit(VALUE).alias("type"), F.lit(None).cast("string").alias("value"), F.struct("vlog_number", "offset", "size").alias("pointer"))
    return pointers, entries
