"""Codecs, log files, filters, the request parser and the command replay."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.functions import bloom, codec
from keystrata.functions.resp import Parser, ProtocolError, replay
from keystrata.plans import workload
from keystrata.sources import logfile


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_fixed_and_pointer(spark):
    r = one(spark, a=codec.fixed32(F.lit(0x01F2C3D4)), b=codec.fixed64(F.lit(-2)), c=codec.value_pointer(F.lit(42), F.lit(0xDEADBEEFCAFE), F.lit(9999)))
    assert bytes(r.a) == (0x01F2C3D4).to_bytes(4, "little") and bytes(r.b) == (2**64 - 2).to_bytes(8, "little")
    p = one(spark, p=codec.read_pointer(F.lit(bytes(r.c))), short=codec.read_pointer(F.lit(bytes(r.c)[:20])), wrong=codec.read_pointer(F.lit(b"\0" + bytes(r.c)[1:])))
    assert (p.p.vlog, p.p.offset, p.p.size) == (42, 0xDEADBEEFCAFE, 9999) and p.short is None and p.wrong is None


def test_scalars(spark):
    r = one(
        spark, crc=codec.crc32(F.lit("123456789").cast("binary")), name=codec.file_name(F.lit(1234567), "sst"), number=codec.file_number(F.lit("000042.log"), "log"),
        other=codec.file_number(F.lit("x42.log"), "log"), big=codec.file_number(F.lit("18446744073709551616.log"), "log"), ns=codec.format_ns(F.lit(1500)), tag=codec.snapshot_tag(F.lit(None).cast("long")),
        error=codec.error(F.lit("a\r\nb")), bulk=codec.bulk(F.lit("é")), null=codec.bulk(F.lit(None).cast("string")), digits=codec.parse_digits(F.lit("+5")),
    )
    assert r.crc == 0xCBF43926 and r.name == "1234567.sst" and r.number == 42 and r.other is None and r.big is None
    assert r.ns == "1.5us" and r.tag == -1 and r.error == "-a  b\r\n" and r.bulk == "$2\r\né\r\n" and r.null == "$-1\r\n" and r.digits is None


@pytest.mark.parametrize("cut", [0, 1, 5, 12, 13])
def test_bad_payloads(spark, cut):
    good = (7).to_bytes(8, "little") + b"\1" + (1).to_bytes(4, "little") + b"k" + (2).to_bytes(4, "little") + b"vv"
    r = one(spark, good=codec.parse_payload(F.lit(good)), bad=codec.parse_payload(F.lit(good[:cut])), more=codec.parse_payload(F.lit(good + b"x")))
    assert (r.good.seq, bytes(r.good.value)) == (7, b"vv") and r.bad is None and r.more is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=90_000), max_size=5), st.integers(0, 70_000))
def test_log_round_trip(payloads, offset):
    data = b"\0" * 0 + logfile.encode(payloads)
    assert logfile.decode(data) == (payloads, len(data) if payloads else 0, True)
    if payloads and len(data) > 9:
        torn, good, _ = logfile.decode(data[: max(0, len(data) - 1 - offset % 9)])
        assert torn == payloads[: len(torn)] and len(torn) < len(payloads) and good <= len(data)


def test_log_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "x" * 70_000), ("b", 2, 0, None)], "user_key string, seq long, type int, value string")
    payloads = [bytes(r.payload) for r in logfile.payloads(rows).orderBy("seq").collect()]
    data = logfile.encode(payloads)
    (tmp_path / "000001.log").write_bytes(data)
    (tmp_path / "000002.log").write_bytes(data[:-3])
    flipped = bytearray(data)
    flipped[20] ^= 1
    (tmp_path / "000003.log").write_bytes(bytes(flipped))
    got = {}
    for r in logfile.read_logs(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-10:], []).append((r.seq, r.type))
    assert {k: sorted(v) for k, v in got.items()} == {"000001.log": [(1, 1), (2, 0)], "000002.log": [(1, 1)]}


def test_bloom_has_no_false_negatives():
    keys = [f"key{i}".encode() for i in range(2000)]
    data = bloom.build(keys)
    assert all(bloom.may_match(data, k) for k in keys)
    assert sum(bloom.may_match(data, f"no{i}".encode()) for i in range(5000)) < 150
    assert data[-1] == 6 and bloom.may_match(b"", b"x") and bloom.may_match(None, b"x")
    assert bloom.positions(b"a", 80, 1) == [zlib.crc32(b"a", 0xBC9F1D34) % 80]


WIRE = b"*2\r\n$3\r\nGET\r\n$1\r\na\r\n" + b"PING  hi\tthere\r\n" + b"*0\r\n" + b"*1\r\n$0\r\n\r\n" + b"\r\n\nECHO x\n"
REQUESTS = [[b"GET", b"a"], [b"PING", b"hi", b"there"], [b""], [b"ECHO", b"x"]]


@pytest.mark.parametrize("seed", range(8))
def test_any_fragmentation(seed):
    rng, parser, got, at = random.Random(seed), Parser(), [], 0
    while at < len(WIRE):
        n = rng.randrange(1, 8)
        got += parser.feed(WIRE[at : at + n])
        at += n
    assert got == REQUESTS and parser.pending() == 0


@pytest.mark.parametrize("wire", [b"*-1\r\n", b"*x\r\n", b"*1\r\n+3\r\n", b"*1\r\n$1\r\nabc\r\n", b"*1\r\n$-1\r\n", b"*1048577\r\n", b"*" + b"1" * 40, b"a" * 65_537])
def test_protocol_errors(wire):
    with pytest.raises(ProtocolError):
        Parser().feed(wire)


def test_replay(spark):
    script = [["PING"], ["ping", "x"], ["SET", "a", "1"], ["GET", "a"], ["EXISTS", "a", "a", "b"], ["DEL", "a", "a"], ["GET", "a"], ["SET", "a"], ["BOGUS"], ["ECHO", "é"], ["DEL", "b"], []]
    df = spark.createDataFrame(list(enumerate(script)), "request long, args array<string>")
    got = [r.reply for r in replay(df).orderBy("request").collect()]
    assert got == ["+PONG\r\n", "$1\r\nx\r\n", "+OK\r\n", "$1\r\n1\r\n", ":2\r\n", ":1\r\n", "$-1\r\n", "-ERR wrong number of arguments for 'set' command\r\n", "-ERR unknown command 'bogus'\r\n", "$2\r\né\r\n", ":0\r\n", "-ERR empty command\r\n"]


def test_workloads(spark):
    assert workload.find_workload("F") == (0, 0, 0, 0, 100) and workload.find_workload("Z") is None
    ops = workload.operations(spark, "D", 1000, 4000).collect()
    inserts = [r.item for r in sorted(ops, key=lambda r: r.op_id) if r.op == "insert"]
    assert inserts == list(range(1000, 1000 + len(inserts))) and 100 < len(inserts) < 320
    assert all(r.item >= 900 for r in ops)
    first = spark.range(20_000).select(workload.zipf_draw(workload.uniform(1, "id"), 100).alias("i")).groupBy("i").count().collect()
    counts = {r.i: r["count"] for r in first}
    whole = sum((k + 1) ** -0.99 for k in range(100))
    assert abs(counts[0] / 20_000 - 1 / whole) < 0.02 and set(counts) <= set(range(100))


def test_make_value(spark):
    def model(i, size):
        x, out, m = 0x9E3779B97F4A7C15 ^ (i * 0xFF51AFD7ED558CCD & (1 << 64) - 1), [], (1 << 64) - 1
        for _ in range(size):
            x ^= x << 13 & m
            x ^= x >> 7
            x ^= x << 17 & m
            out.append(x & 255)
        return bytes(out)

    rows = spark.range(5).select("id", workload.make_value(F.col("id"), 33).alias("v")).collect()
    assert all(bytes(r.v) == model(r.id, 33) for r in rows)
