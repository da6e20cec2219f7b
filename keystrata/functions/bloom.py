"""Bloom filters of 10 bits a key: no false negatives, malformed ones say maybe.

Built and probed in Arrow batches; one filter per file or block of keys.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, BITS_PER_KEY = 0xBC9F1D34, 10


def hashes(keys) -> np.ndarray:
    """Seeded checksums of keys."""
    return np.fromiter((zlib.crc32(k, SEED) for k in keys), np.uint64)


def spread(h: np.ndarray, bits: np.ndarray | int, probes: int) -> np.ndarray:
    """Bit positions (a row a key): the checksum stepped by its rotation, in 32 bits."""
    step = (h >> np.uint64(17) | h << np.uint64(15)) & np.uint64(0xFFFFFFFF)
    at = (h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return (at % np.asarray(bits, np.uint64).reshape(-1, 1)).astype(np.int64)


def positions(key: bytes, bits: int, probes: int) -> list[int]:
    """Bit positions of a key."""
    return spread(hashes([key]), bits, probes)[0].tolist()


def build(keys: list[bytes], bits_per_key: int = BITS_PER_KEY) -> bytes:
    """The filter of some keys: a bit array and the number of probes."""
    if not keys:
        return b""
    size = (max(64, len(keys) * bits_per_key) + 7) // 8
    probes = min(30, max(1, int(bits_per_key * 0.69)))
    array = np.zeros(size * 8, np.uint8)
    array[spread(hashes(keys), size * 8, probes).ravel()] = 1
    return np.packbits(array, bitorder="little").tobytes() + bytes([probes])


def may_match(data: bytes | None, key: bytes) -> bool:
    if not data or len(data) < 2:
        return True
    return all(data[p >> 3] >> (p & 7) & 1 for p in positions(key, (len(data) - 1) * 8, data[-1]))


def build_filters(entries: DataFrame, group: str, key: str = "user_key", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(group, filter) over the distinct keys of each file or block."""
    kind = entries.schema[group].dataType.simpleString()

    def make(table: pa.Table) -> pa.Table:
        keys = [k for k in table.column("k").to_pylist() if k is not None]
        return pa.table([table.column(group).slice(0, 1), pa.array([build(keys, bits_per_key)], pa.binary())], names=[group, "filter"])

    keys = entries.select(group, F.col(key).cast("binary").alias("k")).distinct()
    return keys.groupBy(group).applyInArrow(make, f"`{group}` {kind}, filter binary")


def probe(data: Column, key: Column) -> Column:
    """Whether a filter column may hold a key column."""

    @F.pandas_udf("boolean")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        out = np.ones(len(data), np.bool_)
        # Rows of one filter are probed together.
        for d, rows in data.groupby(data, sort=False).indices.items():
            if len(d) >= 2:
                bits = np.unpackbits(np.frombuffer(d, np.uint8, len(d) - 1), bitorder="little")
                out[rows] = bits[spread(hashes(k or b"" for k in key.iloc[rows]), len(bits), d[-1])].all(axis=1)
        return pd.Series(out)

    return run(data, key.cast("binary"))
