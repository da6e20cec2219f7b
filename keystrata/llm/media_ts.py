"""Media columns: MPEG transport streams.

``mux`` stores a payload of 8-bit samples losslessly: access units become PES
packets with presentation times, cut into 188-byte packets behind a program
association and a program map table; every ``gop`` units start with a
random-access point.  ``demux`` is an independent reader: it parses tables of
any number of packets, checks continuity counters (a packet may be repeated
once, and an announced jump is none), reassembles the PES packets of each stream
and lists timestamps with their random-access points.  ``parse_streams`` applies
the reader to a binary column; ``text_features`` round-trips whole texts.
All run on Arrow batches, row by row, without a shuffle.

Null text counts as empty; an empty payload is padded to 64 zero bytes; null or
foreign bytes give a stream with ``ok`` false; repeated rows give equal values;
an empty table gives an empty result; further columns are ignored.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.textkernel import released, small_batches

#: Fixed values of ISO/IEC 13818-1.
SYNC, PACKET, PAT_PID, NULL_PID = 0x47, 188, 0x0000, 0x1FFF
PMT_PID, DATA_PID, PRIVATE_STREAM, PRIVATE_TYPE = 0x0100, 0x0101, 0xBD, 0x06

UNIT_BYTES, GOP, TICKS = 8192, 4, 3600
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<long>"
PARSED = "ok boolean, n_packets long, programs array<struct<number:int,pmt_pid:int,streams:array<struct<type:int,pid:int>>>>, continuity_errors long, table_errors long, units array<struct<pid:int,pts:long,n_bytes:long,random_access:boolean>>"


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a section."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    """A complete one-section table."""
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + data).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(0, 1, b"\0\1" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
)


def pts_field(pts: int) -> bytes:
    """The five bytes of a presentation time."""
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 255, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 255, 1 | (pts << 1) & 0xFE])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, gop: int = GOP, ticks: int = TICKS) -> bytes:
    """A single-program transport stream of the payload's access units."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit_bytes)):
        unit = payload[at : at + unit_bytes]
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + pts_field(k * ticks & (1 << 33) - 1) + unit
        packets, counter = packetise(pes, counter, k % gop == 0)
        out.append(packets)
    return b"".join(out)


def packetise(pes: bytes, counter: int, random_access: bool) -> tuple[bytes, int]:
    """188-byte packets of one PES packet, padded by an adaptation field."""
    lead = b"\1\x40" if random_access else b""  # adaptation field: its length, random_access_indicator
    n = -(-(len(pes) + len(lead)) // 184)
    grid = np.zeros((n, PACKET), np.uint8)
    grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    grid[0, 1] |= 0x40
    grid[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    spare = n * 184 - len(pes)
    lone = n == 1
    body = np.frombuffer(pes, np.uint8)
    first = 184 - (spare if lone else len(lead))
    pad = spare if lone else len(lead)
    if pad:
        adapt(grid[0], pad, random_access)
    grid[0, PACKET - first :] = body[:first]
    if not lone:
        tail = spare - len(lead)
        full = (n - 2) * 184
        grid[1 : n - 1, 4:] = body[first : first + full].reshape(-1, 184)
        if tail:
            adapt(grid[n - 1], tail, False)
        grid[n - 1, 4 + tail :] = body[first + full :]
    return grid.tobytes(), counter + n


def adapt(packet: np.ndarray, size: int, random_access: bool) -> None:
    """An adaptation field of ``size`` bytes, its length byte included."""
    packet[3] |= 0x20
    packet[4] = size - 1
    if size > 1:
        packet[5] = 0x40 if random_access else 0
        packet[6 : 4 + size] = 0xFF


def demux(data: bytes) -> dict:
    """Tables, continuity errors and reassembled units of a transport stream."""
    out = {"ok": False, "n_packets": len(data) // PACKET, "programs": [], "continuity_errors": 0, "table_errors": 0, "units": [], "payloads": []}
    if not data or len(data) % PACKET:
        return out
    grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        return out
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    control, counter = grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    skip = np.where(control & 2, grid[:, 4].astype(np.int32) + 1, 0)
    begin = np.where(control & 1, 4 + skip, PACKET)
    starts = (grid[:, 1] & 0x40) > 0
    broken = (grid[:, 1] & 0x80) > 0
    access = (control & 2 > 0) & (grid[:, 4] > 0) & (grid[:, 5] & 0x40 > 0)
    if (begin > PACKET).any():
        return out
    jump = (control & 2 > 0) & (grid[:, 4] > 0) & (grid[:, 5] & 0x80 > 0)
    pmts: dict[int, int] = {}
    for body in out_of(out, read_sections(grid, begin, starts, np.flatnonzero(pid == PAT_PID), 0)):
        for k in range(0, len(body), 4):
            number, at = int.from_bytes(body[k : k + 2], "big"), int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
            if number:
                pmts[at] = number
    for at, number in pmts.items():
        streams: list[dict] = []
        for body in out_of(out, read_sections(grid, begin, starts, np.flatnonzero(pid == at), 2)):
            k = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF) if len(body) >= 4 else 4
            while k + 5 <= len(body):
                streams.append({"type": body[k], "pid": int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF})
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0xFFF)
        if streams:
            out["programs"].append({"number": number, "pmt_pid": at, "streams": [s for i, s in enumerate(streams) if s not in streams[:i]]})
    for stream in (s for p in out["programs"] for s in p["streams"]):
        rows = np.flatnonzero((pid == stream["pid"]) & (control & 1 > 0))
        if not len(rows):
            continue
        rows = rows[~repeated(grid, begin, counter, rows)]
        step = np.diff(counter[rows].astype(np.int16)) & 15
        out["continuity_errors"] += int(((step != 1) & ~jump[rows[1:]]).sum()) + int(broken[rows].sum())
        cuts = np.flatnonzero(starts[rows]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            own = rows[a:b]
            pes = reassemble(grid, begin, own)
            unit = read_pes(pes)
            if unit is None:
                out["table_errors"] += 1
                continue
            pts, body = unit
            out["units"].append({"pid": stream["pid"], "pts": pts, "n_bytes": len(body), "random_access": bool(access[own[0]])})
            out["payloads"].append(body)
    out["ok"] = bool(out["programs"]) and not out["continuity_errors"] and not out["table_errors"]
    return out


def reassemble(grid: np.ndarray, begin: np.ndarray, own: np.ndarray) -> bytes:
    """Payload bytes of the given packets, in order."""
    inner = own[1:-1]
    if len(inner) and own[-1] - own[0] == len(own) - 1 and (begin[inner] == 4).all():
        parts = [grid[own[0], begin[own[0]] :], grid[inner[0] : inner[-1] + 1, 4:], grid[own[-1], begin[own[-1]] :]]
    else:
        parts = [grid[i, begin[i] :] for i in own]
    return b"".join(p.tobytes() for p in parts)


def repeated(grid: np.ndarray, begin: np.ndarray, counter: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which packets of a stream repeat the one before, as a sender may do once."""
    out = np.zeros(len(rows), np.bool_)
    for k in (np.flatnonzero(counter[rows[1:]] == counter[rows[:-1]]) + 1).tolist():
        a, b = rows[k - 1], rows[k]
        out[k] = not out[k - 1] and begin[a] == begin[b] and (grid[a, begin[a] :] == grid[b, begin[b] :]).all()
    return out


def out_of(out: dict, read: tuple[list[bytes], int]) -> list[bytes]:
    """The bodies of sections; faulty ones are counted."""
    out["table_errors"] += read[1]
    return read[0]


def read_sections(grid: np.ndarray, begin: np.ndarray, starts: np.ndarray, rows: np.ndarray, table_id: int) -> tuple[list[bytes], int]:
    """(bodies of the distinct checked sections of a table's packets, number of faulty ones).

    A section may go over several packets and several may share one; a packet
    in which one starts says where.
    """
    bodies, faults, held = [], 0, b""

    def take(data: bytes, whole: bool) -> bytes:
        """Read the complete sections; ``whole``: nothing follows, so a rest is a fault."""
        nonlocal faults
        while data and data[0] != 0xFF:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF) if len(data) >= 3 else 3
            if len(data) < size:
                faults += whole
                return b"" if whole else data
            body = checked(data[:size], table_id)
            if body is None:
                faults += 1
            elif body not in bodies:
                bodies.append(body)
            data = data[size:]
        return b""

    for i in rows.tolist():
        raw = grid[i, begin[i] :].tobytes()
        if not raw:
            continue
        if starts[i]:
            point = 1 + raw[0]
            take(held + raw[1:point] if held else b"", True)
            held = take(raw[point:], False)
        elif held:
            held = take(held + raw, False)
    take(held, True)
    return bodies, faults


def checked(raw: bytes, table_id: int) -> bytes | None:
    """The body of a section of the table whose checksum is right."""
    if len(raw) < 12 or raw[0] != table_id:
        return None
    known = CHECKED.get(raw)
    if known is None:
        known = crc32_mpeg(raw[:-4]) == int.from_bytes(raw[-4:], "big")
        if len(CHECKED) < 1000:
            CHECKED[raw] = known
    return raw[8:-4] if known else None


#: Sections that were checked before, a thousand at most.
CHECKED: dict[bytes, bool] = {}


def read_pes(pes: bytes) -> tuple[int | None, bytes] | None:
    """(presentation time, payload) of a PES packet."""
    if len(pes) < 9 or pes[:3] != b"\0\0\1":
        return None
    size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
    end = 6 + size if size else len(pes)
    if end > len(pes) or head > end:
        return None
    p = pes[9:14]
    pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 else None
    return pts, pes[head:end]


def feature(parsed: dict, payload: bytes) -> str:
    """A short description of a stream that was read back."""
    samples = np.frombuffer(payload, np.uint8)
    level = np.bincount(samples >> 5, minlength=8)
    points = [u["pts"] for u in parsed["units"] if u["random_access"]]
    return f"packets={parsed['n_packets']};units={len(parsed['units'])};access={len(points)};last_pts={parsed['units'][-1]['pts']};errors={parsed['continuity_errors'] + parsed['table_errors']};sum={int(samples.sum(dtype=np.int64))};levels={','.join(map(str, level.tolist()))}"


def text_features(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a transport stream, read back and described."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                media = mux(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
                parsed = demux(media)
                if not parsed["ok"]:
                    raise ValueError("a stream that was just written can't be read back")
                payload = b"".join(parsed["payloads"])
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed, payload), [u["pts"] for u in parsed["units"]], [u["pts"] for u in parsed["units"] if u["random_access"]]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(released(run), SCHEMA)


def mux_column(df: DataFrame, payload: str, to: str = "media") -> DataFrame:
    """``df`` with the transport stream of a binary column appended."""
    kept = df.drop(to)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches):
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(payload)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if r is None else mux(r) for r in raw], pa.binary())], [*batch.schema.names, to])

    return small_batches(kept).mapInArrow(released(run), f"{fields}, `{to}` binary")


def parse_streams(df: DataFrame, media: str, key: str) -> DataFrame:
    """``key`` and what ``demux`` finds in the binary column ``media``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        schema = None
        for batch in batches:
            parsed = [demux(m or b"") for m in batch.column(1).to_pylist()]
            cols = {n: [p[n] for p in parsed] for n in ("ok", "n_packets", "programs", "continuity_errors", "table_errors", "units")}
            stream = pa.struct([("type", pa.int32()), ("pid", pa.int32())])
            kinds = [pa.bool_(), pa.int64(), pa.list_(pa.struct([("number", pa.int32()), ("pmt_pid", pa.int32()), ("streams", pa.list_(stream))])), pa.int64(), pa.int64(), pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("n_bytes", pa.int64()), ("random_access", pa.bool_())]))]
            schema = schema or [batch.schema.names[0], *cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(cols.values(), kinds))], schema)

    return small_batches(df.select(key, media)).mapInArrow(released(run), f"`{key}` {kind}, {PARSED}")
