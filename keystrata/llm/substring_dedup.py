"""Substring dedup: prefix-partitioned suffix trees over words.

Every document is the word sequence of its text; a suffix starts at each word.
1. A census of all documents finds prefixes that begin more than a
   ``1/heavy_share`` part of all suffixes (each task reports what is heavy in
   its own rows, so at most ``2 * heavy_share`` prefixes a length are kept: a
   fixed bound, whatever the corpus).
2. Each suffix goes to the group of its shortest prefix that is not heavy, so
   prefixes have variable length and groups fit in memory.  A suffix travels as
   the 64-bit fingerprint of its path down to depth ``width`` with document and
   position; task by task, equal paths are merged first, so a passage that a
   third of all documents share costs a group one leaf a task.
3. A group sorts its leaves, which gives its subtree; an internal node of depth
   ``width`` or more joins leaves of equal path.  Leaves whose node has a
   smaller document are repeats; they go back to their documents in blobs.
4. Repeats that overlap merge into maximal spans, which are cut from the texts.

Groups are pieces of the whole word set: none is capped or sampled.  doc_id is
taken as the key: rows that repeat a doc_id with the same text get the same
result, and their windows never count against each other.  Null text has no
words; rows with a null doc_id neither lose words nor cost others any; texts
with fewer than ``width`` words stay whole; an empty table gives an empty
result; further columns are ignored.
"""

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.textkernel import get_places, mix64, put_places, ranges, released, slices, small_batches, text_buffers, window_hashes, word_hashes, word_spans

WIDTH = 13
#: Prefix lengths tried in turn; a prefix that is heavy at the last is taken whole.
PREFIXES = (1, 2, 4, 8)
HEAVY_SHARE = 2048
UNIT_BYTES = 12 << 20

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


def suffixes(part: pa.RecordBatch, width: int):
    """(word hashes, window starts, document and position of each window)."""
    ids = part.column(0)
    known = np.asarray(ids.is_valid())
    doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, off = text_buffers(part.column(1))
    starts, ends, first = word_spans(buf, off)
    counts = np.where(known, np.maximum(np.diff(first) - width + 1, 0), 0)
    at = ranges(first[:-1], counts)
    return word_hashes(buf, starts, ends), at, np.repeat(doc_ids, counts), at - np.repeat(first[:-1], counts)


def local_heavy(h: np.ndarray, at: np.ndarray, share: int):
    """(length, prefix hash, count) of prefixes that are heavy in these rows."""
    least = max(2, len(at) / (2 * share))
    for length in PREFIXES:
        key = window_hashes(h, length)[at]
        # Counts by 16 bits first: only full cells can hold a heavy prefix.
        cell = (key >> np.uint64(48)).astype(np.int64)
        maybe = np.bincount(cell, minlength=1 << 16)[cell] >= least
        at, key = at[maybe], key[maybe]
        if len(at) == 0:
            return
        found, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        heavy = n >= least
        yield length, found[heavy], n[heavy]
        at = at[heavy[inverse]]


def census(docs: DataFrame, width: int, share: int) -> tuple[int, dict[int, np.ndarray]]:
    """(number of suffixes, sorted heavy prefixes of each length)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                h, at, _, _ = suffixes(part, width)
                level, key, n = [np.zeros(1, np.int32)], [np.zeros(1, np.uint64)], [np.array([len(at)])]
                for length, found, count in local_heavy(h, at, share) if len(at) else ():
                    level.append(np.full(len(found), length, np.int32))
                    key.append(found)
                    n.append(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(level)), pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(n).astype(np.int64))], ["level", "prefix", "n"])

    counts = docs.mapInArrow(released(run), "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "level").limit(2 * share * len(PREFIXES) + 1).collect()
    total = sum(r.n for r in rows if r.level == 0)
    heavy = {length: np.sort(np.array([r.prefix for r in rows if r.level == length and r.n >= total / (2 * share)], np.int64).view(np.uint64)) for length in PREFIXES}
    return total, heavy


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), np.bool_)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def group_of(h: np.ndarray, at: np.ndarray, path: np.ndarray, heavy: dict[int, np.ndarray], groups: int) -> np.ndarray:
    """The group of each suffix: by its shortest prefix that is not heavy."""
    out = np.zeros(len(at), np.uint64)
    todo = np.arange(len(at))
    for length in PREFIXES:
        key = window_hashes(h, length)[at[todo]]
        is_heavy = member(heavy[length], key)
        out[todo[~is_heavy]] = key[~is_heavy]
        todo = todo[is_heavy]
        if len(todo) == 0:
            break
    out[todo] = path[todo]
    return (mix64(out ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(groups)).astype(np.int32)


def blobs(key: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Distinct keys in order, their rows' places as blobs, and the row order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    docs, places = put_places(doc[order], pos[order], cuts)
    return key[cuts], docs, places, order, cuts


def repeats(docs: DataFrame, width: int, share: int, dests: int | None = None) -> tuple[DataFrame, int]:
    """(dest, docs, pos) blobs of every repeated window, and how many dests."""
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    total, heavy = census(docs, width, share)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * parts, math.ceil(total / 500_000))
    dests = dests or max(parts, math.ceil(total / 3_000_000))

    def scatter(batches):
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                h, at, doc, pos = suffixes(part, width)
                if len(at) == 0:
                    continue
                path = window_hashes(h, width)[at]
                least = node_minimum(path, doc)
                own = np.flatnonzero(doc == least)
                key, docs_, places, order, cuts = blobs(group_of(h, at[own], path[own], heavy, groups), doc[own], pos[own])
                raw, bounds = path[own][order].tobytes(), (8 * np.append(cuts, len(own))).tolist()
                paths = [raw[i:j] for i, j in zip(bounds, bounds[1:])]
                # What this task knows to be a repeat passes through any group.
                known = np.flatnonzero(doc > least)
                if len(known):
                    _, more, spots, _, _ = blobs(np.zeros(len(known), np.int32), doc[known], pos[known])
                    key, docs_, places, paths = np.append(key, dest_of(doc[:1], groups)), docs_ + more, places + spots, [*paths, None]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(paths, pa.binary()), pa.array(docs_, pa.binary()), pa.array(places, pa.binary())], ["grp", "paths", "docs", "pos"])

    def subtree(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("paths").to_pylist(), table.column("docs").to_pylist(), table.column("pos").to_pylist()))
        leaves = [(np.frombuffer(p, np.uint64), *get_places(d, s)) for p, d, s in rows if p is not None]
        known = [get_places(d, s) for p, d, s in rows if p is None]
        if leaves:
            path, doc, pos = (np.concatenate(x) for x in zip(*leaves))
            hit = doc > node_minimum(path, doc)
            known.append((doc[hit], pos[hit]))
        doc, pos = (np.concatenate(x) for x in zip(*known))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        key, docs_, places, _, _ = blobs(dest_of(doc, dests), doc, pos)
        return pa.table([pa.array(key, pa.int32()), pa.array(docs_, pa.binary()), pa.array(places, pa.binary())], names=["dest", "docs", "pos"])

    leaves = docs.mapInArrow(released(scatter), "grp int, paths binary, docs binary, pos binary")
    return leaves.groupBy("grp").applyInArrow(subtree, "dest int, docs binary, pos binary"), dests


def node_minimum(path: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each leaf, the least document under its node of full depth."""
    order = np.argsort(path)
    ordered = path[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(doc[order], cuts)
    out = np.empty(len(path), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(cuts, len(path))))
    return out


def dest_of(doc: np.ndarray, dests: int) -> np.ndarray:
    """The part of the documents that a document is in, however ids are spaced."""
    return (mix64(doc.astype(np.int64).view(np.uint64) ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(dests)).astype(np.int32)


def cut_repeats(docs: DataFrame, emit, schema: str, width: int, share: int) -> DataFrame:
    """``emit(doc_id, words, removed mask or None)`` rows for every document."""
    found, dests = repeats(docs, width, share)
    names = [c.split()[0] for c in schema.replace(", ", ",").split(",") if " " in c]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pack(batches):
        """Rows of a batch for each dest as one compressed blob: half the bytes of a shuffle of texts."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            ids, known = batch.column(0), np.asarray(batch.column(0).is_valid())
            # Rows without a doc_id lose nothing, so any place will do.
            to = np.where(known, dest_of(ids.fill_null(0).to_numpy(zero_copy_only=False), dests), np.arange(len(ids), dtype=np.int32) % dests)
            order = np.argsort(to, kind="stable")
            keys, first = np.unique(to[order], return_index=True)
            out = []
            for rows in np.split(order, first[1:]) if len(order) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.take(pa.array(rows)))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())], ["dest", "rows"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = [get_places(d, s) for d, s in zip(right.column("docs").to_pylist(), right.column("pos").to_pylist())]
        doc, pos = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        left = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in left.column("rows").to_pylist()]) if left.num_rows else None
        ids = left.column(0).to_pylist() if left else []
        keys = np.array([0 if i is None else i for i in ids], np.int64)
        low, high = np.searchsorted(doc, keys).tolist(), np.searchsorted(doc, keys, side="right").tolist()
        rows = []
        for i, text, a, b in zip(ids, left.column(1).to_pylist() if left else [], low, high):
            words = (text or "").encode().split()
            gone = None
            if b > a and i is not None and len(words) >= width:
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, pos[a:b], 1)
                np.add.at(edge, np.minimum(pos[a:b] + width, len(words)), -1)
                gone = np.cumsum(edge[:-1]) > 0
            rows.append(emit(i, words, gone))
        return pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=ARROW[schema])

    packed = texts.mapInArrow(released(pack), "dest int, rows binary")
    return packed.groupBy("dest").cogroup(found.groupBy("dest")).applyInArrow(cut, schema)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ARROW = {
    DIGEST: pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]),
    RESULT: pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]),
}


def keep(words: list[bytes], gone) -> bytes:
    return b" ".join(words if gone is None else compress(words, ~gone))


def digests(docs: DataFrame, width: int = WIDTH, share: int = HEAVY_SHARE) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return cut_repeats(docs, lambda i, words, gone: (i, len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(keep(words, gone)).hexdigest()), DIGEST, width, share)


def remove_repeats(docs: DataFrame, width: int = WIDTH, share: int = HEAVY_SHARE) -> DataFrame:
    """doc_id, word counts, the kept text and the maximal spans that were cut."""

    def row(i, words, gone):
        edge = [] if gone is None else np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
        return i, len(words), 0 if gone is None else int(gone.sum()), keep(words, gone).decode(), [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]

    return cut_repeats(docs, row, RESULT, width, share)
