"""Transport streams written by hand, packet by packet, against the reader; and the writer against a plain parser."""

import struct

import pytest

from keystrata.llm import media_ts


def crc(data):
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def table(table_id, number, body, part=0, last=0):
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, part, last) + body
    return head + struct.pack(">I", crc(head))


def packets(pid, data, counter=0, first=True):
    """Sections over as many packets as they take."""
    out, data = [], b"\0" + data
    while data:
        out.append(struct.pack(">BHB", 0x47, (0x4000 if not out and first else 0) | pid, 0x10 | (counter + len(out)) % 16) + data[:184].ljust(184, b"\xff"))
        data = data[184:]
    return out


def pes_packet(pid, counter, body, start=True, flags=0):
    room = 184 - len(body) - 2
    return struct.pack(">BHBBB", 0x47, (0x4000 if start else 0) | pid, 0x30 | counter % 16, room + 1, flags) + b"\xff" * room + body


PES = b"\0\0\1\xe0" + struct.pack(">H", 8 + 4) + b"\x80\x80\5" + bytes([0x21, 0, 1, 0x1C, 0x21]) + b"abcd"


def stream(pmt_streams, rest):
    pat = table(0, 1, struct.pack(">HH", 7, 0xE000 | 0x30))
    body = struct.pack(">HH", 0xE101, 0xF000) + b"".join(struct.pack(">BHH", kind, 0xE000 | pid, 0xF000) for kind, pid in pmt_streams)
    return b"".join(packets(0, pat) + packets(0x30, table(2, 7, body)) + rest)


def test_known_fixture():
    got = media_ts.demux(stream([(0x1B, 0x101)], [pes_packet(0x101, 0, PES, flags=0x40), pes_packet(0x101, 1, PES)]))
    assert got["ok"] and got["programs"] == [{"number": 7, "pmt_pid": 0x30, "streams": [{"type": 0x1B, "pid": 0x101}]}]
    pts = (0 << 30) | (0 << 22) | (0 << 15) | (0x1C << 7) | (0x21 >> 1)
    assert got["units"] == [{"pid": 0x101, "pts": pts, "n_bytes": 4, "random_access": a} for a in (True, False)] and got["payloads"] == [b"abcd"] * 2


def test_tables_over_many_packets():
    streams = [(6, 0x200 + i) for i in range(90)]
    got = media_ts.demux(stream([*streams, (6, 0x101)], [pes_packet(0x101, 3, PES)]))
    assert got["ok"] and len(got["programs"][0]["streams"]) == 91 and got["payloads"] == [b"abcd"]


def test_two_tables_of_a_program():
    more = packets(0x30, table(2, 7, struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", 6, 0xE102, 0xF000)), counter=1)
    got = media_ts.demux(stream([(6, 0x101)], [pes_packet(0x101, 0, PES), *more, pes_packet(0x102, 0, PES)]))
    assert got["ok"] and got["payloads"] == [b"abcd"] * 2 and [s["pid"] for s in got["programs"][0]["streams"]] == [0x101, 0x102]


@pytest.mark.parametrize(
    ("counters", "flags", "errors"),
    [((0, 1, 2), (0, 0, 0), 0), ((0, 2, 3), (0, 0, 0), 1), ((0, 0, 1), (0, 0, 0), 0), ((0, 0, 0), (0, 0, 0), 1), ((0, 9, 10), (0, 0x80, 0), 0), ((15, 0, 1), (0, 0, 0), 0)],
)
def test_continuity(counters, flags, errors):
    got = media_ts.demux(stream([(6, 0x101)], [pes_packet(0x101, c, PES, flags=f) for c, f in zip(counters, flags)]))
    assert got["continuity_errors"] == errors


def test_damaged_tables():
    good = stream([(6, 0x101)], [pes_packet(0x101, 0, PES)])
    assert media_ts.demux(good[:20] + b"\x55" + good[21:])["table_errors"] >= 1
    cut = packets(0x30, table(2, 7, struct.pack(">HH", 0xE101, 0xF000) + bytes(300)))[:1]
    assert media_ts.demux(b"".join(packets(0, table(0, 1, struct.pack(">HH", 7, 0xE030))) + cut))["table_errors"] == 1


def test_writer_against_a_plain_parser():
    """Payload of the written packets by their header fields alone."""
    payload = bytes(range(256)) * 130
    media, body, seen = media_ts.mux(payload), b"", []
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        pid, begin = int.from_bytes(p[1:3], "big") & 0x1FFF, 4 + (p[4] + 1 if p[3] & 0x20 else 0)
        if pid == 0x101:
            seen.append(p[3] & 15)
            body += p[begin:]
        elif p[1] & 0x40:
            n = 3 + (int.from_bytes(p[6:8], "big") & 0xFFF)
            assert crc(p[5 : 5 + n]) == 0
    assert [(a + 1) % 16 for a in seen[:-1]] == seen[1:]
    out = b""
    while body:
        assert body[:3] == b"\0\0\1"
        n = 6 + int.from_bytes(body[4:6], "big")
        out, body = out + body[9 + body[8] : n], body[n:]
    assert out == payload


def test_columns(spark):
    r = media_ts.text_features(spark.createDataFrame([(1, "x" * 40_000)], "doc_id long, text string")).first()
    assert r.timestamps == [0, 3600, 7200, 10800, 14400] and r.access_points == [0, 14400]
