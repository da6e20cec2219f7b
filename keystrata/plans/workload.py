"""Workload generation and the harness's metrics.

Draws come from a seeded hash of the operation number: they follow the stated
distributions and repeat exactly, whatever the partitioning.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.codec import make_key
from keystrata.plans.checkpoints import dealt_by_range, running_sum

#: Percent of reads, updates, inserts, scans, read-modify-writes.
WORKLOADS = {"A": (50, 50, 0, 0, 0), "B": (95, 5, 0, 0, 0), "C": (100, 0, 0, 0, 0), "D": (95, 0, 5, 0, 0), "E": (0, 0, 5, 95, 0), "F": (0, 0, 0, 0, 100)}
LATEST_READS = frozenset("D")
OPS = ("read", "update", "insert", "scan", "rmw")
THETA, SCAN_LENGTH, SEED = 0.99, 100, 42


def find_workload(name: str) -> tuple[int, ...] | None:
    return WORKLOADS.get(name)


def load(spark: SparkSession, records: int) -> DataFrame:
    """The load phase: keys 0 to records - 1 in order."""
    return spark.range(records).select(F.col("id").alias("item"), make_key(F.col("id")).alias("user_key"))


def zipf_cdf(items: DataFrame, theta: float = THETA) -> DataFrame:
    """Cumulative probability of each ``item`` (0, 1, ...), the last exactly 1.

    Sums run in ranges of items; only range totals meet.
    """
    weighed = items.select("item", F.pow((F.col("item") + 1).cast("double"), F.lit(-theta)).alias("p"))
    placed = running_sum(weighed, "item", "p", "before")
    whole = placed.agg(F.sum("p").alias("whole"), F.max("item").alias("last"))
    out = placed.crossJoin(F.broadcast(whole))  # one row
    return out.select("item", F.when(F.col("item") == F.col("last"), 1.0).otherwise((F.col("before") + F.col("p")) / F.col("whole")).alias("cdf"))


def uniform(seed: int, *columns) -> Column:
    """A repeatable draw in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def zipf_draw(u: Column, items: int, theta: float = THETA, table: int = 1 << 20) -> Column:
    """Items by inverse of the distribution, for draws in [0, 1).

    The first ``table`` items are looked up in a sorted table (a fixed bound);
    beyond it the sum is continued by its integral, which is exact to 1e-6.
    """
    head = np.cumsum(np.arange(1, min(items, table) + 1, dtype=np.float64) ** -theta)
    n = len(head)

    def area(i):
        return ((i + 0.5) ** (1 - theta) - (n + 0.5) ** (1 - theta)) / (1 - theta) if theta != 1 else np.log((i + 0.5) / (n + 0.5))

    whole = head[-1] + (area(items) if items > n else 0.0)

    @F.pandas_udf("long")
    def draw(u: pd.Series) -> pd.Series:
        at = u.to_numpy() * whole
        out = np.searchsorted(head, at, side="left")
        far = out >= n
        if items > n and far.any():
            rest = at[far] - head[-1]
            edge = ((n + 0.5) ** (1 - theta) + rest * (1 - theta)) ** (1 / (1 - theta)) if theta != 1 else (n + 0.5) * np.exp(rest)
            out[far] = np.ceil(edge - 0.5).astype(np.int64) - 1
        return pd.Series(np.clip(out, 0, items - 1))

    return draw(u)


def operation(roll: Column, workload: str) -> Column:
    """The operation of a roll in 0..99 under a workload's mix."""
    out, reach = F, 0
    for op, share in zip(OPS[:-1], WORKLOADS[workload]):
        reach += share
        out = out.when(roll < reach, op)
    return out.otherwise(OPS[-1])


def scan_length(u: Column, most: int = SCAN_LENGTH) -> Column:
    """1 + (a draw of 1 .. 2 * most - 1) mod most."""
    return (1 + (1 + F.floor(u * (2 * most - 1))) % most).cast("long")


def operations(spark: SparkSession, workload: str, records: int, count: int, seed: int = SEED, theta: float = THETA, scan: int = SCAN_LENGTH) -> DataFrame:
    """op_id, op, item, user_key and scan length of a run.

    Inserts extend the key space in order of op_id; "latest" reads are Zipf
    draws over its newest tenth.
    """
    parts = max(1, min(count // 100_000 + 1, 10_000))
    ops = spark.range(0, count, 1, parts).select(F.col("id").alias("op_id"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(100)).alias("roll"), uniform(seed, "id").alias("u"), uniform(seed + 3, "id").alias("v"))
    ops = ops.withColumn("op", operation(F.col("roll"), workload))
    if "insert" in (o for o, share in zip(OPS, WORKLOADS[workload]) if share):
        ops = running_sum(ops.withColumn("one", (F.col("op") == "insert").cast("long")), "op_id", "one", "before")
    else:
        ops = ops.withColumn("before", F.lit(0).cast("long"))
    ops = ops.withColumn("frontier", F.lit(records) + F.col("before"))
    if workload in LATEST_READS:
        newest = F.greatest(F.floor(F.col("frontier") / 10), F.lit(1))
        drawn = F.col("frontier") - newest + zipf_draw(F.col("u"), records // 10 + 1, theta) % newest
    else:
        drawn = zipf_draw(F.col("u"), records, theta)
    item = F.when(F.col("op") == "insert", F.col("frontier")).otherwise(drawn).cast("long")
    return ops.withColumn("item", item).select("op_id", "op", "item", make_key(F.col("item")).alias("user_key"), F.when(F.col("op") == "scan", scan_length(F.col("v"), scan)).alias("length"))


def make_value(n: Column, size: int) -> Column:
    """``size`` pseudo-random bytes for a number, as a shift-register stream."""

    @F.pandas_udf("binary")
    def run(n: pd.Series) -> pd.Series:
        x = np.uint64(0x9E3779B97F4A7C15) ^ (n.to_numpy().astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
        out = np.empty((len(x), size), np.uint8)
        for k in range(size):
            x ^= x << np.uint64(13)
            x ^= x >> np.uint64(7)
            x ^= x << np.uint64(17)
            out[:, k] = (x & np.uint64(255)).astype(np.uint8)
        return pd.Series([row.tobytes() for row in out])

    return run(n)


def op_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def percentiles(samples: DataFrame, column: str, points: list[float], block: int = 1 << 16) -> DataFrame:
    """(p, value): the element number min(n - 1, floor(p / 100 * n)) in order.

    Values are counted first, so what is ranked is a row for each value, in
    ranges: counts before a range are sums, not a single sorted task.
    """
    counts = samples.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = dealt_by_range(counts, "value")
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"), F.sum("total").over(Window.partitionBy(F.lit(0))).alias("whole"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(F.broadcast(starts), "part").withColumn("low", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def point(p):
        rank = F.least(F.col("whole") - 1, F.floor(F.lit(p) / 100.0 * F.col("whole")))
        return ranked.where((F.col("low") <= rank) & (rank < F.col("low") + F.col("n"))).select(F.lit(float(p)).alias("p"), "value")

    return reduce(DataFrame.unionByName, [point(p) for p in points])


def latency(samples: DataFrame, column: str = "ns") -> DataFrame:
    return samples.agg(F.count(column).alias("n"), F.max(column).alias("most"), F.sum(column).alias("total"), (F.count(column) * 1e9 / F.sum(column)).alias("per_second"))


def write_amplification(log_bytes: Column, table_bytes: Column, vlog_bytes: Column, user_bytes: Column) -> Column:
    """Physical bytes, value logs included, for each byte of the user."""
    return F.try_divide((log_bytes + table_bytes + vlog_bytes).cast("double"), user_bytes)


def log_bytes(payload: Column, header: int = 9) -> Column:
    """Bytes of a log record with one header; fragments at block ends add more."""
    return payload + header


def run_batch(log: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, written versions) of a batch of operations on a log.

    A batch reads the snapshot it began with; its writes become visible together,
    in order of op_id.  Answers: op_id, op, status of the key that is read or
    read and modified, and the number of records a scan returns: live keys from
    its item on, by key number, ``length`` of them at most.
    """
    from keystrata.operators import oplog
    from keystrata.operators.reads import lookup, range_counts

    wanted = ops.where(F.col("op").isin("read", "rmw")).select("op_id", "op", "user_key")
    status = lookup(log, wanted.select("user_key").distinct()).select("user_key", "status")
    answered = wanted.join(status, "user_key").select("op_id", "op", "status", F.lit(None).cast("long").alias("n"))
    # Records from an item on: all live keys there, cut at the length.
    scans = ops.where(F.col("op") == "scan")
    ranges = scans.select("op_id", F.col("item").alias("first"), (F.lit(2**62) - F.col("item")).alias("length"))
    counted = range_counts(log, ranges, F.substring("user_key", 5, 19))
    scanned = scans.join(counted, "op_id").select("op_id", "op", F.lit(None).cast("string").alias("status"), F.least("n", "length").alias("n"))
    writes = ops.where(F.col("op").isin("update", "insert", "rmw"))
    done = writes.where(F.col("op") != "rmw").select("op_id", "op", F.lit("written").alias("status"), F.lit(None).cast("long").alias("n"))
    put = writes.select("user_key", F.lit(oplog.VALUE).alias("type"), "value", F.col("op_id").alias("arrival"))
    return answered.unionByName(scanned).unionByName(done), put


def lru(accesses: DataFrame, shards: int, capacity: int) -> DataFrame:
    """shard, hits and misses of a sharded cache that drops the least recently used.

    ``accesses``: place (order), key, weight.  A missed key is put in; one that
    is heavier than the whole cache isn't; a shard drops entries until it is
    within its share.  Shards run apart; within one, accesses go in order, so a shard
    is one task that holds its accesses: deal a long trace over many shards.
    """
    import pyarrow as pa

    share = max(capacity // shards, 1)

    def run(key, batches):
        held: dict = {}
        weight = hits = misses = 0
        for batch in batches:
            for k, w in zip(batch.column("key").to_pylist(), batch.column("weight").to_pylist()):
                if k in held:
                    hits += 1
                    held[k] = held.pop(k)
                    continue
                misses += 1
                if w > capacity:
                    continue
                held[k], weight = w, weight + w
                while weight > share and held:
                    weight -= held.pop(next(iter(held)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([hits]), pa.array([misses])], ["shard", "hits", "misses"])

    dealt = accesses.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "place", "key", F.col("weight").cast("long").alias("weight"))

    def grouped(table: pa.Table) -> pa.Table:
        rows = run((table.column("shard")[0],), table.sort_by("place").to_batches())
        return pa.Table.from_batches(list(rows))

    return dealt.groupBy("shard").applyInArrow(grouped, "shard int, hits long, misses long")
