"""The operation log and its builders.

Columns: user_key (string or binary), seq (long, unique), type (int: 1 value,
0 tombstone), value (null only for tombstones).  A tombstone is not a null and
an empty value is not a tombstone.
"""

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.plans.checkpoints import dealt_by_range, running_sum

VALUE, TOMBSTONE = 1, 0
COLUMNS = ("user_key", "seq", "type", "value")


def oplog(df: DataFrame, key: Column, seq: Column, value: Column, deleted: Column) -> DataFrame:
    """A log from any table: ``deleted`` rows become tombstones without value."""
    kind = F.when(deleted, TOMBSTONE).otherwise(VALUE)
    return df.select(key.alias("user_key"), seq.cast("long").alias("seq"), kind.alias("type"), F.when(kind == VALUE, value).alias("value"))


def put(df: DataFrame, key: str, value: str, arrival: str, base: int) -> DataFrame:
    """Values in arrival order, numbered from ``base`` + 1."""
    return number(df.select(F.col(key).alias("user_key"), F.lit(VALUE).alias("type"), F.col(value).alias("value"), F.col(arrival).alias("arrival")), base)


def delete(df: DataFrame, key: str, arrival: str, base: int, value_type: str = "string") -> DataFrame:
    """Unconditional tombstones, also for keys that were never written."""
    return number(df.select(F.col(key).alias("user_key"), F.lit(TOMBSTONE).alias("type"), F.lit(None).cast(value_type).alias("value"), F.col(arrival).alias("arrival")), base)


def number(df: DataFrame, base: int) -> DataFrame:
    """Sequence numbers by (unique) ``arrival``, without one task for all rows.

    Rows are dealt by ranges of arrival; each range starts after the rows of
    the ranges before it, whose counts are one number a partition.
    """
    dealt = dealt_by_range(df, "arrival")
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    offsets = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0))), initial=base))
    row = F.row_number().over(Window.partitionBy("part").orderBy("arrival"))
    seq = F.element_at(F.array(*(F.lit(o).cast("long") for o in offsets)), F.col("part") + 1) + row
    return dealt.select("user_key", seq.cast("long").alias("seq"), "type", "value")


def merge(*sources: DataFrame) -> DataFrame:
    """All versions of all sources; versions found twice count once."""
    return reduce(DataFrame.unionByName, sources).dropDuplicates(["user_key", "seq", "type"])


def ordered(log: DataFrame) -> DataFrame:
    """Internal-key order: key ascending, newest first."""
    return log.orderBy(F.col("user_key").asc(), F.col("seq").desc(), F.col("type").desc())


def next_seq(*sources: DataFrame) -> DataFrame:
    """One past the largest sequence number of all sources (1 if there is none)."""
    tops = reduce(DataFrame.unionByName, [s.select("seq") for s in sources])
    return tops.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def memtable_size(log: DataFrame) -> DataFrame:
    """Number of entries and the size estimate: key, value and 36 bytes each."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 36
    return log.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def generations(log: DataFrame, write_buffer_size: int) -> DataFrame:
    """``log`` with the size and write generation of each entry.

    A generation is closed by the first entry that finds it full, so where one
    starts depends on where the one before did.  Bytes before each entry are a
    distributed sum; only the search for the starts goes in order, range by
    range, over packed numbers (16 bytes an entry, one range in memory), and
    jumps from start to start.  Entries get their generation by a distributed
    count of the starts up to them.
    """
    size = (F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 36).cast("long")
    placed = running_sum(log.withColumn("size", size), "seq", "size", "before").checkpoint()

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            seq, before = (batch.column(k).to_numpy() for k in (0, 1))
            order = np.argsort(seq)
            yield pa.RecordBatch.from_arrays([pa.array([int(seq.min())]), pa.array([seq[order].tobytes()], pa.binary()), pa.array([before[order].tobytes()], pa.binary())], ["first", "seqs", "befores"])

    packed = dealt_by_range(placed.select("seq", "before"), "seq").sortWithinPartitions("seq").select("seq", "before").mapInArrow(pack, "first long, seqs binary, befores binary").checkpoint()
    starts = generation_starts(((r.seqs, r.befores) for r in packed.orderBy("first").toLocalIterator()), write_buffer_size)
    marks = log.sparkSession.createDataFrame([(s, 1) for s in starts], "seq long, start long")
    flagged = placed.drop("before").join(marks, "seq", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    counted = running_sum(flagged, "seq", "start", "earlier")
    return counted.withColumn("generation", F.col("earlier") + F.col("start") - 1).drop("earlier", "start")


def generation_starts(blocks, write_buffer_size: int) -> list[int]:
    """Sequence numbers of the first entries, from (seqs, bytes before) blocks in order."""
    import numpy as np

    starts, due = [], 0
    for seqs, befores in blocks:
        seq, before, at = np.frombuffer(seqs, np.int64), np.frombuffer(befores, np.int64), 0
        while (at := int(np.searchsorted(before, due))) < len(seq):
            starts.append(int(seq[at]))
            due = int(before[at]) + write_buffer_size
    return starts


def sync_counts(log: DataFrame, threshold: int) -> DataFrame:
    """Syncs of a log under each policy: after every write, after each
    ``threshold`` unsynced bytes (the write that reaches them is synced too), never."""
    closed = generations(log, threshold).groupBy("generation").agg(F.sum("size").alias("bytes"))
    sums = closed.agg(F.sum((F.col("bytes") >= threshold).cast("long")).alias("periodic"))
    both = log.agg(F.count("*").alias("always")).crossJoin(sums)
    kinds = [("always", F.col("always")), ("periodic", F.coalesce("periodic", F.lit(0))), ("never", F.lit(0))]
    return both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), n.cast("long").alias("syncs")) for k, n in kinds))).alias("s")).select("s.*")
