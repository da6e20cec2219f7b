"""Retention, levels, file metadata and the choice of compactions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.oplog import TOMBSTONE
from keystrata.operators.reads import newest
from keystrata.plans.checkpoints import dealt_by_range, running_sum

#: Bytes of an entry beside its key and value.
ENTRY_BYTES = 8
LEVELS, L0_TRIGGER, LEVEL_BASE, GROWTH = 7, 4, 10 << 20, 10


def retain(log: DataFrame, floor: int | None = None, bottom: bool = False) -> DataFrame:
    """What a compaction keeps.

    Versions above the floor (the smallest snapshot) stay; of those at or below
    it the newest of each key stays, unless it is a tombstone and the output is
    the bottom level.  Without a snapshot all versions are ranked.  Versions
    above the floor pass through; the others keep one row a key and task before
    the shuffle, however many a key has.
    """
    below = newest(log, floor)
    below = below.where(F.col("type") != TOMBSTONE) if bottom else below
    return below if floor is None else log.where(F.col("seq") > F.lit(floor)).unionByName(below)


def split_outputs(log: DataFrame, max_bytes: int, name: str = "file") -> DataFrame:
    """``log`` with the number of the output file of each entry (int, from 0).

    Keys go to files in order: a key belongs to the file that its bytes, counted
    from the first key, start in, so a key's versions share a file and a file
    exceeds ``max_bytes`` by its last key at most.  Only sums of keys are put in
    order, in ranges; of the ranges only the totals meet.
    """
    size = (F.octet_length(F.col("user_key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + ENTRY_BYTES).cast("long")
    sums = log.groupBy("user_key").agg(F.sum(size).alias("bytes"))
    placed = running_sum(sums, "user_key", "bytes", "before")
    files = placed.select("user_key", F.floor(F.col("before") / F.lit(max_bytes)).cast("int").alias(name))
    # Numbers without a gap: a file that one large key fills leaves none behind.
    dense = files.select(name).distinct().select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("dense"))
    return log.join(files.join(dense, name).select("user_key", F.col("dense").cast("int").alias(name)), "user_key")


def file_metadata(entries: DataFrame, *by: str) -> DataFrame:
    """Sequence and key bounds, entries and payload bytes of each file."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    return entries.groupBy(*(by or ("file_number",))).agg(
        F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.count("*").alias("entry_count"),
        F.sum(size).cast("long").alias("file_size"), F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key"),
    )


def level_sizes(files: DataFrame, l0_trigger: int = L0_TRIGGER, base: int = LEVEL_BASE) -> DataFrame:
    """Files, bytes, limit and need for compaction of each level that has files.

    Level 0 is full at ``l0_trigger`` files or more, levels 1 to 5 above
    ``base * 10 ** (level - 1)`` bytes, the last never.
    """
    stats = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    limit = F.when(F.col("level").between(1, LEVELS - 2), F.lit(base) * F.pow(F.lit(GROWTH), F.col("level") - 1)).cast("long")
    full = F.when(F.col("level") == 0, F.col("files") >= l0_trigger).otherwise(F.coalesce(F.col("bytes") > F.col("limit"), F.lit(False)))
    return stats.withColumn("limit", limit).withColumn("needs_compaction", full)


def level_file_count(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"))


def prune(files: DataFrame, begin, end, snapshot: int | None = None) -> DataFrame:
    """Files that can hold a key of [begin, end) visible at the snapshot."""
    kept = files.where((F.col("largest_key") >= F.lit(begin)) & (F.col("smallest_key") < F.lit(end)))
    return kept if snapshot is None else kept.where(F.col("smallest_seq") <= F.lit(snapshot))


def islands(files: DataFrame) -> DataFrame:
    """``files`` of one level with the number of their run of overlapping keys.

    The transitive overlap of a key range is a whole run, so picking needs no
    loop.  The window sorts one level's metadata, one row a file.
    """
    order = Window.partitionBy("level").orderBy("smallest_key", "largest_key", "file_number")
    reach = F.max("largest_key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = (reach.isNull() | (F.col("smallest_key") > reach)).cast("int")
    return files.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order)).drop("starts")


def overlap(files: DataFrame, inputs: DataFrame, target: int) -> DataFrame:
    """Files of the target level that join a compaction of ``inputs``.

    A picked file widens the key range, which can pull in more files.
    """
    own = inputs.agg(F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"))
    probe = own.select(F.lit(-1).cast("long").alias("file_number"), F.lit(target).cast("int").alias("level"), "smallest_key", "largest_key")
    level = files.where(F.col("level") == target).select("file_number", "level", "smallest_key", "largest_key")
    runs = islands(level.unionByName(probe))
    probe_run = runs.where("file_number = -1").select("island")
    return runs.where("file_number <> -1").join(F.broadcast(probe_run), "island", "left_semi").drop("island")


def pick(files: DataFrame, l0_trigger: int = L0_TRIGGER, base: int = LEVEL_BASE):
    """(inputs, overlapping files, target level) of the next compaction, or None.

    Level 0 goes whole; of another full level its first file goes.
    """
    full = sorted(r.level for r in level_sizes(files, l0_trigger, base).where("needs_compaction").collect())
    if not full:
        return None
    source = full[0]
    inputs = files.where(F.col("level") == source)
    if source:
        inputs = inputs.orderBy("smallest_key").limit(1)
    target = max(1, source + 1)
    return inputs, overlap(files, inputs, target), target


def install(files: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The next version: the files without the inputs, and the outputs."""
    return files.join(inputs.select("file_number"), "file_number", "left_anti").unionByName(outputs)


def locate(files: DataFrame, keys: DataFrame, level: int) -> DataFrame:
    """user_key and the file of a sorted, disjoint level that can hold it.

    Keys and files are put in order together, in ranges: a key belongs to the
    last file that starts at or before it, in its range or, failing that, in the
    ranges before it, unless it lies in the gap after that file.
    """
    starts = files.where(F.col("level") == level).select(F.col("smallest_key").alias("at"), F.lit(0).alias("kind"), F.struct("file_number", "largest_key").alias("f"), F.lit(None).cast("string").alias("user_key"))
    wanted = keys.select(F.col("user_key").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<file_number:bigint,largest_key:string>").alias("f"), F.col("user_key").cast("string").alias("user_key"))
    dealt = dealt_by_range(starts.unionByName(wanted), "at")
    order = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # The last file of the ranges before: one row a range.
    ends = dealt.where("kind = 0").groupBy("part").agg(F.max_by("f", "at").alias("last"))
    parts = dealt.select("part").distinct().join(ends, "part", "left")
    earlier = F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found = dealt.withColumn("own", F.last("f", ignorenulls=True).over(order)).where("kind = 1").join(F.broadcast(parts.select("part", earlier.alias("earlier"))), "part")
    file = F.coalesce("own", "earlier")
    return found.select("user_key", F.when(F.col("user_key") <= file["largest_key"], file["file_number"]).alias("file_number"))


def orphans(listing: DataFrame, live: DataFrame, log_floor: int) -> DataFrame:
    """Files of a folder that no manifest names: (name) rows to delete."""
    parts = F.regexp_extract("name", r"^([0-9]+)\.(sst|log|vlog)$", 1), F.regexp_extract("name", r"^([0-9]+)\.(sst|log|vlog)$", 2)
    known = listing.select("name", parts[0].alias("number"), parts[1].alias("kind"))
    stale_log = (F.col("kind") == "log") & (F.expr("try_cast(number as long)") < F.lit(log_floor))
    unnamed = known.where(F.col("kind").isin("sst", "vlog")).join(live, "name", "left_anti")
    temporary = known.where(F.col("name") == "MANIFEST.tmp")
    return unnamed.unionByName(known.where(stale_log)).unionByName(temporary).select("name")


def order_violations(entries: DataFrame, position: str, *by: str) -> DataFrame:
    """How many entries of each file, in order of ``position``, don't come after the one before.

    Internal-key order: key ascending, then newest first.
    """
    by = by or ("file_number",)
    place = Window.partitionBy(*by).orderBy(position)
    last_key, last_seq = F.lag("user_key").over(place), F.lag("seq").over(place)
    bad = (F.col("user_key") < last_key) | ((F.col("user_key") == last_key) & (F.col("seq") >= last_seq))
    return entries.withColumn("bad", F.coalesce(bad, F.lit(False))).groupBy(*by).agg(F.sum(F.col("bad").cast("long")).alias("violations"))


def verify(entries: DataFrame, files: DataFrame, position: str) -> DataFrame:
    """file_number and status of every file that is named or has entries.

    ok, missing (no entries), unknown (not named), order, or bounds (keys,
    sequence numbers or number of entries differ from the metadata).
    """
    own = entries.groupBy("file_number").agg(F.min("user_key").alias("k0"), F.max("user_key").alias("k1"), F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.count("*").alias("n"))
    both = files.withColumn("named", F.lit(True)).join(own.join(order_violations(entries, position), "file_number"), "file_number", "full")
    same = (F.col("k0") == F.col("smallest_key")) & (F.col("k1") == F.col("largest_key")) & (F.col("s0") == F.col("smallest_seq")) & (F.col("s1") == F.col("largest_seq")) & (F.col("n") == F.col("entry_count"))
    status = F.when(F.col("named").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("violations") > 0, "order").when(~same, "bounds").otherwise("ok")
    return both.select("file_number", status.alias("status"))


def shared_prefixes(entries: DataFrame, restart: int = 16) -> DataFrame:
    """Entries, key bytes and bytes saved by prefix coding of each file.

    In internal-key order each key leaves out what it shares with the one
    before, but for every ``restart``-th entry, which is whole.
    """
    place = Window.partitionBy("file_number").orderBy("user_key", F.desc("seq"), F.desc("type"))
    placed = entries.select("file_number", "user_key", F.lag("user_key").over(place).alias("before"), ((F.row_number().over(place) - 1) % restart).alias("at"))
    most = F.least(F.length("user_key"), F.length("before"))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (F.left("user_key", k) == F.left("before", k)) & (most >= k)))
    return placed.groupBy("file_number").agg(
        F.count("*").alias("entries"), F.sum(F.octet_length("user_key")).cast("long").alias("key_bytes"),
        F.sum(F.when((F.col("at") > 0) & F.col("before").isNotNull(), shared).otherwise(0)).cast("long").alias("saved"),
    )
