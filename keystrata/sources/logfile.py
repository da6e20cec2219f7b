"""Log files: 32 KiB blocks of checked, fragmented records.

A record's header is length (4), checksum (4) and kind (1).  Records that don't
fit a block are cut into first, middle and last fragments; a block's tail too
small for a header is zero.  A reader returns the good prefix: it stops at the
first torn or corrupt record and reports where the last good one ended.
"""

import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import log_payload, parse_payload
from keystrata.plans.checkpoints import dealt_by_range

BLOCK, HEADER = 32768, 9
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def encode(payloads: Iterable[bytes], offset: int = 0) -> bytes:
    """The bytes of records appended at a file offset."""
    out, at = [], offset
    for payload in payloads:
        rest, begun = memoryview(payload), False
        while True:
            room = BLOCK - at % BLOCK
            if room < HEADER:
                out.append(bytes(room))
                at += room
                room = BLOCK
            part, rest = rest[: room - HEADER], rest[room - HEADER :]
            kind = (MIDDLE if rest else LAST) if begun else (FIRST if rest else FULL)
            body = bytes([kind]) + part
            out.append(len(part).to_bytes(4, "little") + zlib.crc32(body).to_bytes(4, "little") + body)
            at += HEADER + len(part)
            begun = True
            if not rest:
                break
    return b"".join(out)


def decode(data: bytes) -> tuple[list[bytes], int, bool]:
    """(records, end of the last good record, whether the file ended cleanly)."""
    out, good, at, held = [], 0, 0, None
    while at < len(data):
        room = BLOCK - at % BLOCK
        if room < HEADER:
            at += room
            continue
        if at + HEADER > len(data):
            return out, good, False
        size, kind = int.from_bytes(data[at : at + 4], "little"), data[at + 8]
        if kind == 0 and size == 0:
            at += room
            continue
        end = at + HEADER + size
        if size > room - HEADER or end > len(data) or zlib.crc32(data[at + 8 : end]) != int.from_bytes(data[at + 4 : at + 8], "little"):
            return out, good, False
        part = data[at + HEADER : end]
        if kind in (FULL, FIRST) and held is None:
            held = part
        elif kind in (MIDDLE, LAST) and held is not None:
            held += part
        else:
            return out, good, False
        at = end
        if kind in (FULL, LAST):
            out.append(held)
            held, good = None, at
    return out, good, held is None


def read_logs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, seq, type, user_key, value) of the good prefix of each log file.

    Files are the unit of work, as each is an ordered chain of blocks.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(path, i, p) for i, p in enumerate(decode(content)[0])]
            path, no, payload = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(no, pa.int64()), pa.array(payload, pa.binary())], ["path", "record", "payload"])

    raw = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, record long, payload binary")
    parsed = raw.withColumn("p", parse_payload(F.col("payload")))
    # A payload that can't be parsed ends its log, like a torn tail.
    stop = parsed.groupBy("path").agg(F.min(F.when(F.col("p").isNull(), F.col("record"))).alias("stop"))
    kept = parsed.join(stop, "path").where(F.col("stop").isNull() | (F.col("record") < F.col("stop")))
    return kept.select("path", F.col("p.seq").cast("long").alias("seq"), "p.type", "p.user_key", "p.value")


def payloads(log: DataFrame) -> DataFrame:
    """(seq, payload) of a log, for writing with ``encode``."""
    return log.select("seq", log_payload(F.col("seq"), F.col("type"), F.col("user_key"), F.col("value")).alias("payload"))


def write_logs(log: DataFrame, folder: str) -> list[str]:
    """A log as record files ``<n>.log`` in order of seq; returns their paths.

    Executors make the bytes of a file from a range of sequence numbers; the
    driver, as the one writer, appends them file by file: each is written beside
    its place and renamed, so readers see whole files.
    """

    def run(table: pa.Table) -> pa.Table:
        content = encode(table.sort_by("seq").column("payload").to_pylist())
        return pa.table([table.column("part").slice(0, 1).cast(pa.int32()), pa.array([content], pa.binary())], names=["part", "content"])

    ranges = dealt_by_range(payloads(log), "seq").groupBy("part").applyInArrow(run, "part int, content binary").orderBy("part")
    sc, paths = log.sparkSession.sparkContext, []
    place = sc._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    for n, row in enumerate(ranges.toLocalIterator(), 1):
        path = f"{folder.rstrip('/')}/{n:06}.log"
        stream = fs.create(place(path + ".tmp"), True)
        stream.write(row.content)
        stream.close()
        fs.rename(place(path + ".tmp"), place(path))
        paths.append(path)
    return paths
