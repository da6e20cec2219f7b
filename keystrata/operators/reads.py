"""Point reads, range scans and snapshots.

Every read is the newest visible version of a key: the snapshot bound is
applied before the ranking, the tombstone filter after it.  The ranking is a
row_number() = 1, which Spark turns into a per-task top-1 before the shuffle,
so a key with very many versions costs one row a task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.oplog import TOMBSTONE, VALUE
from keystrata.plans.checkpoints import running_sum


def by_age():
    """The versions of each key, newest first."""
    return Window.partitionBy("user_key").orderBy(F.col("seq").desc(), F.col("type").desc())


def visible(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= F.lit(snapshot))


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of every key, tombstones included."""
    return visible(log, snapshot).withColumn("rn", F.row_number().over(by_age())).where("rn = 1").drop("rn")


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live keys and values."""
    return newest(log, snapshot).where(F.col("type") == VALUE)


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The value of one key; no row if absent or deleted."""
    own = visible(log.where(F.col("user_key") == F.lit(key)), snapshot)
    return own.orderBy(F.col("seq").desc(), F.col("type").desc()).limit(1).where(F.col("type") == VALUE)


def lookup(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """user_key, status (found, deleted, missing) and value of each wanted key.

    Only versions of wanted keys are ranked.
    """
    wanted = keys.select("user_key").distinct()
    top = newest(log.join(wanted, "user_key", "left_semi"), snapshot)
    status = F.when(F.col("type").isNull(), "missing").when(F.col("type") == TOMBSTONE, "deleted").otherwise("found")
    return keys.join(top, "user_key", "left").select("user_key", status.alias("status"), "value")


def exists_count(log: DataFrame, keys: DataFrame) -> DataFrame:
    """How many arguments are live; repeated arguments count repeatedly."""
    return keys.join(latest(log).select("user_key"), "user_key", "left_semi").agg(F.count("*").alias("n"))


def delete_count(log: DataFrame, keys: DataFrame) -> DataFrame:
    """How many keys a delete of all arguments removes; repeated ones count once."""
    return keys.join(latest(log).select("user_key"), "user_key", "left_semi").agg(F.count_distinct("user_key").alias("n"))


def in_range(log: DataFrame, begin, end, column: str = "user_key") -> DataFrame:
    """Rows with a key in the half-open [begin, end); an empty end gives none."""
    return log.where((F.col(column) >= F.lit(begin)) & (F.col(column) < F.lit(end)))


def scan(log: DataFrame, begin, end, snapshot: int | None = None) -> DataFrame:
    """Live keys of [begin, end) in key order."""
    return latest(in_range(log, begin, end), snapshot).orderBy("user_key")


def seek(log: DataFrame, target) -> DataFrame:
    """The first live key at or after ``target``."""
    return latest(log.where(F.col("user_key") >= F.lit(target))).orderBy("user_key").limit(1)


def range_counts(log: DataFrame, ranges: DataFrame, key_number: Column) -> DataFrame:
    """op_id and number of live keys in each [first, first + length).

    Both ends of a range are put in order with the keys; the keys before the end
    less those before the start are the range's.  The cost doesn't depend on the
    length of ranges.
    """
    keys = latest(log).select(key_number.cast("long").alias("num"), F.lit(1).alias("live"), F.lit(None).cast("long").alias("op_id"), F.lit(0).alias("sign"))
    ends = ranges.select("op_id", F.explode(F.array(
        F.struct(F.col("first").cast("long").alias("num"), F.lit(-1).alias("sign")), F.struct((F.col("first") + F.greatest("length", F.lit(0))).cast("long").alias("num"), F.lit(1).alias("sign")),
    )).alias("e")).select("e.num", F.lit(0).alias("live"), F.col("op_id").cast("long").alias("op_id"), "e.sign")
    both = keys.unionByName(ends).withColumn("place", F.struct("num", "live", "op_id", "sign"))
    counted = running_sum(both, "place", "live", "before").where("sign <> 0")
    return counted.groupBy("op_id").agg(F.sum(F.col("before") * F.col("sign")).alias("n"))


def history(log: DataFrame) -> DataFrame:
    """Every version with its age rank in its key (1: newest)."""
    return log.withColumn("version", F.row_number().over(by_age()).cast("long"))


def by_source_rank(sources: list[DataFrame]) -> DataFrame:
    """Newest versions by source priority: the first source with a version wins.

    Equals ``newest`` where sources are ordered from newer to older.
    """
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more)
    first = Window.partitionBy("user_key").orderBy("source_rank", F.col("seq").desc())
    return both.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "source_rank")


def intervals(log: DataFrame) -> DataFrame:
    """Versions with the sequence number that replaces them (null: current)."""
    return log.withColumn("until", F.lead("seq").over(Window.partitionBy("user_key").orderBy("seq", "type")))


def multi_snapshot(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """Live keys as of each of the (few, registered) snapshots.

    Validity intervals are unrolled against the list of snapshots: one pass,
    no range join.
    """
    points = F.array(*(F.lit(s).cast("long") for s in sorted(set(snapshots)))) if snapshots else F.array().cast("array<long>")
    seen = F.filter(points, lambda s: (s >= F.col("seq")) & (F.col("until").isNull() | (s < F.col("until"))))
    return intervals(log).where(F.col("type") == VALUE).select(F.explode(seen).alias("snapshot"), "user_key", "seq", "value")


def snapshot_floor(snapshots: DataFrame) -> DataFrame:
    """The smallest live snapshot, or the largest long."""
    return snapshots.agg(F.coalesce(F.min("seq"), F.lit(2**63 - 1)).alias("floor"))
