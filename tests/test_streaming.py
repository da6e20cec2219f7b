"""Streams: ingest, state by key, and the request parser as keyed state."""

from keystrata.sources.store import Store
from keystrata.streaming import ingest

OPS = "user_key string, type int, value string, arrival long"


def drain(df, mode, **sink):
    writer = df.writeStream.outputMode(mode)
    q = (writer.foreachBatch(sink["each"]) if "each" in sink else writer.format("memory").queryName(sink["name"])).start()
    q.processAllAvailable()
    q.stop()


def test_ingest(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([("a", 1, str(i), 2 * i), ("b", i % 2, "x" if i % 2 else None, 2 * i + 1)], OPS).coalesce(1).write.parquet(str(source / str(i)))
    store = Store(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(OPS).option("recursiveFileLookup", "true").parquet(str(source))
    drain(stream, "append", each=ingest.append_to(store))
    assert {r.user_key: r.value for r in store.scan("", "~").collect()} == {"a": "2"}


def test_latest_by_key(spark, tmp_path):
    schema = "user_key string, seq long, type int, value string"
    for i, rows in enumerate([[("a", 5, 1, "new"), ("b", 1, 1, "x")], [("a", 2, 1, "old"), ("b", 3, 0, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(ingest.latest_by_key(stream), "complete", name="latest")
    assert {(r.user_key, r.seq, r.value) for r in spark.table("latest").collect()} == {("a", 5, "new"), ("b", 3, None)}


def test_parse_stream(spark, tmp_path):
    schema = "connection long, chunk_no long, data binary"
    wire = b"*2\r\n$3\r\nGET\r\n$1\r\na\r\nPING\r\n"
    for i in range(0, len(wire), 9):
        spark.createDataFrame([(1, i, wire[i : i + 9]), (2, i, b"*x\r\n")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(ingest.parse_stream(stream), "append", name="requests")
    rows = spark.table("requests").orderBy("connection", "request").collect()
    assert [([bytes(a) for a in r.args] if r.args else None, bool(r.error)) for r in rows] == [([b"GET", b"a"], False), ([b"PING"], False), (None, True)]
