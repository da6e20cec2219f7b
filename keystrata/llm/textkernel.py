"""Vectorised word kernel shared by the Arrow-side text operators.

A word is a maximal run of bytes outside space and 0x09-0x0D.  Because every
separator is ASCII, UTF-8 bytes can be scanned directly and no text is decoded.
All hashes are 64 bit and wrap silently (numpy uint64).
"""

import sys
import types

import numpy as np
import pyarrow as pa

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
GOLD = np.uint64(0x9E3779B97F4A7C15)
S33 = np.uint64(33)
S29 = np.uint64(29)
#: Words longer than this many 8-byte blocks are hashed one at a time.
LONG_BLOCKS = 16
#: What Python gets of a table at a time.
BATCH_BYTES = 4 << 20


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process.

    Functions are pickled by value, so module globals are rebuilt for every
    task; a synthetic module in ``sys.modules`` is not.
    """
    mod = sys.modules.setdefault("_keystrata_worker_cache", types.ModuleType("_keystrata_worker_cache"))
    return mod.__dict__.setdefault("store", {})


def mix64(x: np.ndarray) -> np.ndarray:
    """In-place finaliser; x must be an owned uint64 array."""
    x ^= x >> S33
    x *= M1
    x ^= x >> S29
    x *= M2
    x ^= x >> S33
    return x


def small_batches(df):
    """``df``, whose session will hand Python 4 MB of rows at a time, or less.

    Bounds the memory of workers and of the executors' Arrow buffers, whatever
    the length of texts.  Spark has this only as a setting of the session, so it
    stays; a smaller one of the caller is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def few(keys, limit: int):
    """``keys``, marked for broadcast if there are no more than ``limit`` of them."""
    from pyspark.sql import functions as F

    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def fields_of(schema) -> str:
    """The DDL of a schema's fields."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def released(run):
    """``run`` over a task's batches, giving memory back to the system as it goes.

    Workers live on from stage to stage, and what one has freed but not given
    back counts against the executor.
    """

    def give_back():
        import ctypes

        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)

    def wrapped(batches):
        try:
            for n, out in enumerate(run(batches)):
                yield out
                if n % 8 == 7:
                    give_back()
        finally:
            give_back()

    return wrapped


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Zero-copy row slices of a batch with about max_bytes of text each."""
    arr = batch.column(batch.schema.get_field_index(column))
    _, off = text_buffers(arr)
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(off, off[row] + max_bytes, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield batch.slice(row, end - row)
        row = end


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first-word index of every document plus the total)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = (buf != 32) & ((buf < 9) | (buf > 13))
    edge = np.ones(n + 1, np.bool_)
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    edge[off] = True
    cuts = np.flatnonzero(edge)
    inside = word[cuts[:-1]]
    starts, ends = cuts[:-1][inside], cuts[1:][inside]
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, from 8-byte blocks."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    size = (ends - starts).astype(np.int64)
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
    h = blocks[starts] & keep[np.minimum(size, 8)]
    h ^= size.astype(np.uint64) * GOLD
    mix64(h)
    todo = np.flatnonzero(size > 8)
    block = 1
    while len(todo) and block < LONG_BLOCKS:
        at = starts[todo] + 8 * block
        left = np.minimum(ends[todo] - at, 8)
        part = h[todo] * GOLD
        part ^= blocks[at] & keep[left]
        h[todo] = mix64(part)
        block += 1
        todo = todo[size[todo] > 8 * block]
    for i in todo.tolist():
        h[i] = long_hash(buf[starts[i] : ends[i]], int(h[i]))
    return h


def long_hash(part: np.ndarray, seed: int) -> int:
    """Hash of one very long word."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes; callers mask document ends."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for k in range(1, width):
        acc *= GOLD
        acc += h[k : k + n]
        if k % 4 == 0:
            acc ^= acc >> S29
    return mix64(acc)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s+c) for each pair."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(total)


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def put_varints(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """LEB128 bytes of uint64 values, cut before each value number in ``cuts``."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    rest = v >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    todo = np.arange(len(v))
    k = 0
    while len(todo):
        more = size[todo] > k + 1
        out[at[todo] + k] = ((v[todo] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        todo = todo[more]
        k += 1
    raw, bounds = out.tobytes(), at[np.append(cuts, len(v))].tolist()
    return [raw[i:j] for i, j in zip(bounds, bounds[1:])]


def get_varints(raw: bytes) -> np.ndarray:
    """The uint64 values of LEB128 bytes."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    size = ends - starts + 1
    todo, k = np.arange(len(ends)), 0
    while len(todo):
        out[todo] |= (b[starts[todo] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
        k += 1
        todo = todo[size[todo] > k]
    return out


def put_places(doc: np.ndarray, pos: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(document, position) pairs as differences, one pair of blobs per cut.

    Small where neighbours share a document or have near ones.
    """
    first = np.zeros(len(doc), np.bool_)
    first[cuts[cuts < len(doc)]] = True
    step = np.diff(doc, prepend=np.int64(0))
    step[first] = doc[first]
    same = ~first & (step == 0)
    away = np.where(same, np.diff(pos, prepend=np.int64(0)), pos)
    zigzag = lambda x: ((x << 1) ^ (x >> 63)).view(np.uint64)
    return put_varints(zigzag(step.astype(np.int64)), cuts), put_varints(zigzag(away.astype(np.int64)), cuts)


def get_places(docs: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Undo ``put_places`` for one pair of blobs."""
    zagzig = lambda x: (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)
    step, away = zagzig(get_varints(docs)), zagzig(get_varints(pos))
    if len(step) == 0:
        return step, away
    same = step == 0
    same[0] = False
    total = np.cumsum(away)
    lead = np.flatnonzero(~same)
    before = np.concatenate([[0], total])[lead]
    return np.cumsum(step), total - np.repeat(before, np.diff(np.append(lead, len(step))))
